"""Sentence units of two sides, candidate pairs within a group, their scores and one-to-one matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed, few
from parlance.functions.text import content_word, harmonic, sentences, tokens


def units(rows: DataFrame, *, pairs: bool = False) -> DataFrame:
    """(group, side, idx, n, multi, text): the sentences of rows (group, side, ord, text) in the
    order of ord, numbered from 0 within a side; with ``pairs`` also each two neighbours, numbered
    n + i as a unit of their own.  Null texts have no sentences."""
    split = rows.select("group", "side", "ord", F.posexplode(sentences(F.col("text"))).alias("at", "text"))
    side = Window.partitionBy("group", "side")
    order = side.orderBy("ord", "at")
    single = split.withColumns({"idx": F.row_number().over(order) - 1, "n": F.count("*").over(side).cast("int"), "after": F.lead("text").over(order)})
    one = single.select("group", "side", "idx", "n", F.lit(False).alias("multi"), "text")
    if not pairs:
        return one
    both = F.array(F.struct(F.col("idx").alias("i"), F.lit(False).alias("m"), F.col("text").alias("t")), F.struct((F.col("idx") + F.col("n")).alias("i"), F.lit(True).alias("m"), F.concat_ws(" ", "text", "after").alias("t")))
    kept = F.filter(both, lambda u: ~u["m"] | F.col("after").isNotNull())
    return single.select("group", "side", "n", F.explode(kept).alias("u")).select("group", "side", F.col("u.i").alias("idx"), "n", F.col("u.m").alias("multi"), F.col("u.t").alias("text"))


def candidates(u: DataFrame) -> DataFrame:
    """(group, i, j, n0, n1, multi0, multi1): all pairs of units of side 0 and 1 of a group but two
    by two.  A group is an article or conversation; its pairs are what the operator is for."""
    a = u.where("side = 0").select("group", F.col("idx").alias("i"), F.col("n").alias("n0"), F.col("multi").alias("multi0"))
    b = u.where("side = 1").select("group", F.col("idx").alias("j"), F.col("n").alias("n1"), F.col("multi").alias("multi1"))
    return a.join(b, "group").where(~(F.col("multi0") & F.col("multi1")))


def flat_index(pairs: DataFrame) -> DataFrame:
    """pairs of candidates() with their place in the group's matrix of (2 n0 - 1) x (2 n1 - 1)."""
    return pairs.withColumn("flat", F.col("i").cast("bigint") * (2 * F.col("n1") - 1) + F.col("j"))


def group_starts(u: DataFrame) -> DataFrame:
    """(group, size, start): matrix sizes and their running sums in the order of the groups."""
    n = u.where("not multi").groupBy("group").agg(*(F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1))).where("n0 > 0 and n1 > 0")
    size = ((2 * F.col("n0") - 1) * (2 * F.col("n1") - 1)).cast("bigint")
    sized = n.select("group", size.alias("size"))
    # running sums over ranges of groups, so that no task holds them all
    spark = u.sparkSession
    ranged = checkpointed(sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("size").alias("s"))
    before = sums.select("__part", F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("__part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__run", run).join(F.broadcast(before), "__part").select("group", "size", (F.col("__run") + F.col("__before")).alias("start"))


def length_differences(pairs: DataFrame, u: DataFrame) -> DataFrame:
    """pairs (group, i, j) with the absolute and squared difference of their units' token counts."""
    size = u.select("group", "side", "idx", F.size(tokens(F.col("text"))).alias("len"))
    a = size.where("side = 0").select("group", F.col("idx").alias("i"), F.col("len").alias("a"))
    b = size.where("side = 1").select("group", F.col("idx").alias("j"), F.col("len").alias("b"))
    diff = F.abs(F.col("a") - F.col("b")).cast("bigint")
    return pairs.join(a, ["group", "i"]).join(b, ["group", "j"]).withColumns({"diff": diff, "diff2": diff * diff}).drop("a", "b")


def smoothed_idf(rows: DataFrame, *, group: str = "group", text: str = "text") -> DataFrame:
    """(token, df, idf) with ln((1 + groups) / (1 + df)) + 1, over groups with any text."""
    seen = rows.select(group, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).distinct()
    total = rows.select(group).distinct().agg(F.count("*").alias("groups"))
    df = seen.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("token", "df", (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def lexical_scores(u: DataFrame, idf: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(group, i, j, score, matched, unmatched) of pairs that share anything: the weights of i's
    distinct content words, each times its best match in j (1 for the same word, a synonym's
    score otherwise), over the sum of the weights.

    An inverted index on (group, word): only words that occur on both sides meet."""
    words = u.select("group", "side", "idx", F.explode(F.array_distinct(F.filter(tokens(F.col("text")), content_word))).alias("token"))
    a = words.where("side = 0").join(idf.select("token", "idf"), "token").select("group", F.col("idx").alias("i"), "token", "idf")
    b = words.where("side = 1").select("group", F.col("idx").alias("j"), F.col("token").alias("other"))
    norm = a.groupBy("group", "i").agg(F.sum("idf").alias("z"), F.count("*").alias("na"))
    count_b = b.groupBy("group", "j").agg(F.count("*").alias("nb"))
    if synonyms is None:
        met = a.join(b, (a.group == b.group) & (a.token == b.other)).select(a.group, "i", "j", "token", "idf", F.lit(1.0).alias("s"))
    else:
        both = synonyms.select("w1", "w2", "score", F.lit(0).alias("back")).unionByName(synonyms.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "score", F.lit(1).alias("back")))
        best = both.where("w1 != w2").groupBy("w1", "w2").agg(F.min_by("score", "back").alias("s"))
        same = a.select("group", "i", "token", "idf", F.col("token").alias("w2"), F.lit(1.0).alias("s"))
        wide = same.unionByName(a.join(best, a.token == best.w1).select("group", "i", "token", "idf", "w2", "s"))
        met = wide.join(b, (wide.group == b.group) & (wide.w2 == b.other)).select(wide.group, "i", "j", "token", "idf", "s").groupBy("group", "i", "j", "token", "idf").agg(F.max("s").alias("s"))
    total = met.groupBy("group", "i", "j").agg(F.sum(F.col("idf") * F.col("s")).alias("sum"), F.count("*").alias("matched"))
    scored = total.join(norm, ["group", "i"]).join(count_b, ["group", "j"])
    return scored.select("group", "i", "j", (F.col("sum") / F.nullif(F.col("z"), F.lit(0.0))).alias("score"), "sum", "z", "matched", (F.col("na") + F.col("nb") - 2 * F.col("matched")).alias("unmatched"))


def penalised(scores: DataFrame, penalty: float = 0.1) -> DataFrame:
    """scores of lexical_scores() with ``numeric`` ((sum - penalty * unmatched) / z), ``only``
    (unmatched over unmatched and matched of both sides) and ``both`` (unmatched over z)."""
    z = F.nullif(F.col("z"), F.lit(0.0))
    return scores.withColumns({"numeric": F.coalesce((F.col("sum") - penalty * F.col("unmatched")) / z, F.lit(0.0)), "only": F.col("unmatched") / (F.col("unmatched") + 2 * F.col("matched")), "both": F.coalesce(F.col("unmatched") / z, F.lit(0.0))})


def cosine(a: Column, b: Column) -> Column:
    """Of arrays, in double; null if either has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


#: Queries that meet rows at a time; what a task is sent.
QUERIES_AT_ONCE = 2000
#: Cosines that a task holds at a time, whatever the size of its batches.
CELLS = 500_000
#: Rows that a block of many queries meets in one task.
MET_IN_A_TASK = 200_000


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", at_once: int = QUERIES_AT_ONCE, met: int = MET_IN_A_TASK) -> DataFrame:
    """(query, neighbour, cosine, rank): the k nearest rows of each query, itself left out, equal
    ones (to six places) by key.  Null vectors and keys, and vectors of length 0, are near nothing.

    Up to ``at_once`` queries are collected and sent to the tasks, which meet them with their rows
    by matrix products.  More, as when all rows are queries, are cut in blocks of about ``at_once``
    that stay in the cluster: each meets the rows, about ``met`` of them in a task.  Either way a
    task returns at most k rows a query, so no pairs are shuffled but those."""
    kind = dict(rows.dtypes)[key]
    whole = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    held, asked = whole(rows), whole(queries)
    count = asked.count()
    if count <= at_once:
        own = asked.select("key", F.col("v").cast("array<double>").alias("v")).collect()
        best = _near_block(held, [r["key"] for r in own], np.array([r["v"] for r in own], dtype=np.float64), k, kind)
    else:
        n = held.count()
        best = _near_blocks(_blocks(asked, -(-count // at_once)), _blocks(held, max(1, -(-n // (4 * at_once))), max(1, -(-n // met))), k, kind)
    rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(rank).cast("bigint")).where(F.col("rank") <= k)


class _Best:
    """The k best rows met so far of each of some queries."""

    def __init__(self, names: list, asked: np.ndarray, k: int):
        self.names, self.k = np.asarray(names), k
        self.unit = _units(asked)
        self.small = self.unit.astype(np.float32)
        self.floor = np.where(np.isnan(self.unit).any(1), np.inf, -np.inf)  # what a row must reach to be among a query's k
        self.kept = (np.zeros(0, np.int64), np.zeros(0), self.names[:0])  # query, cosine, key
        self.more: list[tuple] = []  # the same, not sorted in yet

    def meet(self, keys: np.ndarray, x: np.ndarray) -> None:
        """Products in single precision tell what may reach the floors; cosines are of doubles."""
        slack = 1e-6 + (x.shape[1] + 4) * 2.0**-23  # rounding to six places, and twice the products' error
        step = max(1, CELLS // len(self.names))
        for at in range(0, len(x), step):
            own, unit = keys[at : at + step], _units(x[at : at + step])
            product = self.small @ unit.astype(np.float32).T
            least = self.floor - slack
            if len(own) > self.k + 1 and np.isneginf(least).any():  # as many as k without the query itself
                product[np.isnan(product)] = -np.inf
                least = np.maximum(least, np.partition(product, -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2 * slack)
            q, j = np.divmod(np.flatnonzero(product >= least.astype(np.float32)[:, None]), len(own))
            fine = np.isfinite(product[q, j]) & (own[j] != self.names[q])
            q, j = q[fine], j[fine]
            self.more.append((q, np.round((self.unit[q] * unit[j]).sum(1), 6), own[j]))
            if sum(len(m[0]) for m in self.more) > len(self.names) * self.k // 2:
                self._sort()

    def _sort(self) -> None:
        q, cosine, key = map(np.concatenate, zip(self.kept, *self.more))
        order = np.lexsort((key, -cosine, q))
        q, cosine, key = q[order], cosine[order], key[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.floor[q[place == self.k - 1]] = cosine[place == self.k - 1]
        self.kept, self.more = tuple(x[place < self.k] for x in (q, cosine, key)), []

    def found(self) -> list[pa.RecordBatch]:
        self._sort()
        q, cosine, key = self.kept
        return [pa.RecordBatch.from_arrays([pa.array(self.names[q]), pa.array(key), pa.array(cosine)], names=["query", "neighbour", "cosine"])] if len(q) else []


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 become NaN, which is near nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _read(keys: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.asarray(keys.to_pylist()), x.reshape(len(keys), -1)


def _near_block(held: DataFrame, names: list, asked: np.ndarray, k: int, kind: str) -> DataFrame:
    sent = held.sparkSession.sparkContext.broadcast((names, asked))

    def run(batches):
        names, asked = sent.value
        best = _Best(names, asked, k) if names else None
        for b in batches:
            if best and b.num_rows:
                best.meet(*_read(b.column("key"), b.column("v")))
        if best:
            yield from best.found()

    return held.mapInArrow(run, f"query {kind}, neighbour {kind}, cosine double")


def _blocks(held: DataFrame, blocks: int, parts: int | None = None) -> DataFrame:
    """(block, rows): the rows dealt evenly to ``blocks`` arrays, in ``parts`` partitions at most, or
    about one each."""
    dealt = held.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    own = (dealt if parts else dealt.repartition(blocks, "block")).groupBy("block").agg(F.collect_list(F.struct("key", "v")).alias("rows"))
    return checkpointed(own.coalesce(parts) if parts else own)  # read by many tasks


def _near_blocks(asked: DataFrame, held: DataFrame, k: int, kind: str) -> DataFrame:
    """Each block of queries with each of rows; a task has the blocks of one partition of either side."""
    own = asked.select("block", F.col("rows").alias("asked"))
    both = own.crossJoin(held.select("rows").hint("shuffle_replicate_nl"))

    def run(batches):
        best: dict[int, _Best] = {}
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                side = lambda name: b.column(name).slice(i, 1).flatten()
                of = lambda rows: _read(rows.field("key"), rows.field("v"))
                if block not in best:
                    best[block] = _Best(*of(side("asked")), k)
                best[block].meet(*of(side("rows")))
        for one in best.values():
            yield from one.found()

    return both.mapInArrow(run, f"query {kind}, neighbour {kind}, cosine double")


def fused(scores: DataFrame, a: str, b: str, least_a: float, least_b: float) -> DataFrame:
    """scores with both at least their minimum, and ``fused``, their harmonic mean."""
    return scores.where((F.col(a) >= least_a) & (F.col(b) >= least_b)).withColumn("fused", harmonic(F.col(a), F.col(b)))


#: Pairs of a group from which on its matches are found in rounds instead of a fold in one task.
FOLDED = 50_000


def greedy(scores: DataFrame, *, score: str = "score", most: int = FOLDED) -> DataFrame:
    """One-to-one matches of scores (group, i, j, score) with the sentence sets ``left`` and
    ``right`` (or i and j themselves): the best pair first, equal ones by i and j, and none that
    uses a sentence again.  Filter by score before.

    Groups of up to ``most`` pairs are folded, each in one task; larger ones are matched in rounds
    over all tasks (``in_rounds``), with the same result."""
    own = scores
    if "left" not in scores.columns:
        own = scores.withColumns({"left": F.array("i"), "right": F.array("j")})
    own = checkpointed(own.select("group", "i", "j", F.col(score).cast("double").alias("score"), "left", "right"))
    large = few(own.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most).select("group"))
    if large.isEmpty():
        return folded(own)
    return folded(own.join(large, "group", "left_anti")).unionByName(in_rounds(own.join(large, "group", "left_semi")))


def folded(own: DataFrame) -> DataFrame:
    """Greedy matches of (group, i, j, score, left, right): a fold over each group's sorted pairs."""
    listed = own.groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "i", "j", "left", "right"))).alias("pairs"))
    start = F.expr("named_struct('l', cast(array() as array<int>), 'r', cast(array() as array<int>), 'kept', cast(array() as array<struct<i:int,j:int,score:double>>))")

    def take(acc: Column, p: Column) -> Column:
        free = ~F.arrays_overlap(acc["l"], p["left"]) & ~F.arrays_overlap(acc["r"], p["right"])
        more = F.struct(F.concat(acc["l"], p["left"]).alias("l"), F.concat(acc["r"], p["right"]).alias("r"), F.concat(acc["kept"], F.array(F.struct(p["i"].alias("i"), p["j"].alias("j"), (F.lit(0.0) - p["neg"]).alias("score")))).alias("kept"))
        return F.when(free, more).otherwise(acc)

    return listed.select("group", F.inline(F.aggregate("pairs", start, take)["kept"]))


def in_rounds(own: DataFrame) -> DataFrame:
    """The same matches, by rounds of locally best pairs.

    A pair is taken if it is the best one left at each of its sentences: nothing that the greedy
    order takes before it can touch them.  Its sentences' other pairs go, and the next round begins.
    The best of a sentence is a minimum that tasks combine before the shuffle, so neither a large
    group nor a sentence with very many pairs is in one task.  Each round takes the best pair of
    every group at least, and ends when no pair is left; random scores need some log n rounds, a
    chain of pairs each a little better than the next as many as it has pairs."""
    order = F.struct((-F.col("score")).alias("neg"), "i", "j")
    ends = lambda side, c: F.transform(F.array_distinct(c), lambda s: F.struct(F.lit(side).alias("side"), s.cast("int").alias("s")))
    left = checkpointed(own.withColumn("ends", F.concat(ends(0, "left"), ends(1, "right"))).select("group", "i", "j", "score", "ends"))
    taken = None
    while not left.isEmpty():
        at = left.select("group", order.alias("pair"), F.size("ends").alias("n"), F.inline("ends"))
        best = at.groupBy("group", "side", "s").agg(F.min(F.struct("pair", "n")).alias("best"))
        wins = best.groupBy("group", "best").agg(F.count("*").alias("at")).where(F.col("at") == F.col("best.n"))
        new = checkpointed(wins.select("group", F.col("best.pair.i").alias("i"), F.col("best.pair.j").alias("j"), (F.lit(0.0) - F.col("best.pair.neg")).alias("score")))
        taken = new if taken is None else taken.unionByName(new)
        used = few(left.join(new.select("group", "i", "j"), ["group", "i", "j"]).select("group", F.inline("ends")).distinct())
        gone = at.join(used, ["group", "side", "s"], "left_semi").select("group", "pair.i", "pair.j").distinct()
        left = checkpointed(left.join(gone, ["group", "i", "j"], "left_anti"))
    return own.select("group", "i", "j", "score").limit(0) if taken is None else taken


def well_formed(text: Column, least: int = 4) -> Column:
    """At least ``least`` words cut at white space, first character a capital, digit or quote, last
    one of ``.!?``."""
    return (F.size(F.split(F.trim(text), r"\s+")) >= least) & text.rlike(r"^[\p{Lu}\p{Lt}0-9\"'].*[.!?]$")


def one_to_two(multi0: Column, multi1: Column) -> Column:
    return multi0 != multi1
