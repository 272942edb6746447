"""Classifiers over token or named features, their tuning, and the bootstrapping loop."""

from __future__ import annotations

import itertools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import evaluation

#: name -> builder; parameters as keyword arguments.
CLASSIFIERS = {
    "random_forest": lambda **p: RandomForestClassifier(**({"numTrees": 50} | p)),
    "naive_bayes": lambda **p: NaiveBayes(**({"modelType": "bernoulli"} | p)),
    "boosted_trees": lambda **p: GBTClassifier(**({"maxIter": 20} | p)),
    "linear_svm": lambda **p: LinearSVC(**p),
    "logistic_regression": lambda **p: LogisticRegression(**({"regParam": 0.01} | p)),
    "elastic_net": lambda **p: LogisticRegression(**({"regParam": 0.001, "elasticNetParam": 0.5} | p)),
    "perceptron": lambda **p: MultilayerPerceptronClassifier(**p),
}


def pipeline(kind: str, *, features: str = "tokens", size: int = 1 << 14, centred: bool = False, **params) -> Pipeline:
    """Hashed presence of an array of feature names, then the classifier over (features, label)."""
    stages = [HashingTF(inputCol=features, outputCol="hashed" if centred else "features", numFeatures=size, binary=True)]
    if centred:
        stages.append(StandardScaler(inputCol="hashed", outputCol="features", withMean=True, withStd=False))
    return Pipeline(stages=[*stages, CLASSIFIERS[kind](**params)])


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, in place of an older one."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scores(model: PipelineModel, rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and metrics of label 1."""
    done = model.transform(rows)
    return evaluation.metrics(evaluation.confusion(done, F.col("label") == 1, F.col("prediction") == 1, *by))


def grid(params: dict[str, list]) -> list[dict]:
    return [dict(zip(params, values)) for values in itertools.product(*params.values())]


def held_out_search(train: DataFrame, tune: DataFrame, kind: str, params: dict[str, list], **fixed) -> tuple[dict, PipelineModel, float]:
    """The parameters, model and F1 of the best point of a grid on held-out rows."""
    best = None
    for point in grid(params):
        model = pipeline(kind, **fixed, **point).fit(train)
        f1 = scores(model, tune).first()["f1"]
        if best is None or f1 > best[2]:
            best = point, model, f1
    return best


def cross_validated(rows: DataFrame, kind: str, fold: str = "fold", **params) -> DataFrame:
    """Metrics by fold, each model trained on the other folds."""
    out = None
    for k in sorted(r[fold] for r in rows.select(fold).distinct().collect()):
        one = scores(pipeline(kind, **params).fit(rows.where(F.col(fold) != k)), rows.where(F.col(fold) == k)).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def ablation(rows: DataFrame, test: DataFrame, kind: str, groups: dict[str, str], **params) -> DataFrame:
    """F1 without each named group of features (a pattern over the names in ``tokens``)."""
    out = None
    for name, pattern in {"full": None, **groups}.items():
        cut = (lambda d: d) if pattern is None else (lambda d, p=pattern: d.withColumn("tokens", F.expr(f"filter(tokens, t -> not t rlike '{p}')")))
        one = scores(pipeline(kind, **params).fit(cut(rows)), cut(test)).withColumn("without", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def bootstrapped(train: DataFrame, unlabelled: DataFrame, kind: str, *, rounds: int = 2, k: int = 50, **params) -> DataFrame:
    """train grown by the k surest rows of each class of ``unlabelled`` (id, tokens) a round; each
    round's rows are checkpointed, so lineage doesn't grow with the rounds."""
    from parlance.operators.datasets import most_confident

    for _ in range(rounds):
        model = pipeline(kind, **params).fit(train)
        guess = model.transform(unlabelled.join(train.select("id"), "id", "left_anti"))
        sure = guess.select("id", "tokens", F.col("prediction").cast("int").alias("label"), F.abs(vector_to_array("rawPrediction")[1]).alias("conf"))
        new = most_confident(sure, "label", "conf", "id", k).select("id", "tokens", "label")
        train = train.select("id", "tokens", "label").unionByName(new).checkpoint()
    return train


def components(rows: DataFrame, k: int, *, vector: str = "embedding") -> DataFrame:
    """(rank, direction, variance): the k principal directions of the rows' vectors and their
    shares of the variance."""
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(data)
    pc = model.pc.toArray()
    out = [(i + 1, [float(x) for x in pc[:, i]], float(model.explainedVariance[i])) for i in range(k)]
    return rows.sparkSession.createDataFrame(out, "rank int, direction array<double>, variance double")
