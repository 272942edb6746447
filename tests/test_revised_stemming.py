"""Stems of the revised English algorithm: its published samples, and the dictionary pass."""

from pyspark.sql import functions as F

from parlance.functions import revised_stemming

#: word stem, from the algorithm's description and its sample vocabulary.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoping hope cry cri by by say say feed feed agreed agre
generate generat general general communion communion arsenal arsenal skis ski skies sky dying die news news inning inning proceed proceed relational relat
conditional condit rationally ration digitizer digit hopefulness hope callousness callous decisiveness decis formality formal sensibility sensibl quickly quick
happily happili national nation triplicate triplic electricity electr electrical electr goodness good adoption adopt replacement replac falling fall rolled roll
controlled control probable probabl rate rate cease ceas young young boy boy enjoyment enjoy youth youth""".split()


def test_known_stems():
    pairs = dict(zip(KNOWN[::2], KNOWN[1::2]))
    assert {w: revised_stemming.stem(w) for w in pairs} == pairs
    assert [revised_stemming.stem(w) for w in ("", "A", "Running", "dog's", "dogs'", "été", "x1y2")] == ["", "a", "run", "dog", "dog", "été", "x1y2"]


def test_dictionary_pass(spark):
    rows = [(1, ["running", None, "dogs"], ["hopes"]), (2, [], None), (3, None, ["running", "running"])]
    frame = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").withColumn("keep", F.lit("x"))
    got = {r["id"]: (r["a"], r["b"], r["keep"]) for r in revised_stemming.with_stems(frame, ["id"], ["a", "b"]).collect()}
    assert got == {1: (["run", None, "dog"], ["hope"], "x"), 2: ([], None, "x"), 3: (None, ["run", "run"], "x")}
    assert revised_stemming.dictionary(frame.select(F.explode("a").alias("word"))).count() == 2


def test_stemmed_features_query(spark, sf):
    from parlance.plans.catalogue import QUERIES
    from parlance.plans.text_queries import points

    stems = lambda words: [revised_stemming.stem(w) for w in words]
    want = set()
    for r in points(spark, sf).collect():
        prev, marker, curr = (stems(r[c]) for c in ("prev", "marker", "curr"))
        names = {f"connective_unistem_{w}" for w in marker} | {f"1_unistem_{w}" for w in prev} | {f"2_unistem_{w}" for w in curr}
        names |= {f"bistem_{a}_{b}" for side in (prev, curr) for a, b in zip(side, side[1:])}
        want |= {(r["doc_id"], r["sent_idx"], n) for n in names}
    got = [tuple(r) for r in QUERIES["stemmed_features"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
