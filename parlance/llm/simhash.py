"""SimHash near copies by multi-index hashing.

A fingerprint bit is 1 if it is set in more than half of the shingles' 64-bit hashes.
Fingerprints within two bits of each other link.  Cut in two 32-bit segments, such a pair agrees
in one segment up to one bit, so each fingerprint is entered in a table under both segments and
looks up, for each segment, its own value and the values in the ball of radius one around it
(only those that set a cleared bit: the pair is then met from just one side).  Matches are kept
if their complete distance is small enough.  A table entry with very many fingerprints is left
to an exact second way that is linear in them: two fingerprints are within two bits of each
other just when they share a neighbour within one bit.

``near_copies`` finds copies of a given Jaccard similarity the same way, from signatures of some
24 segments of 20 bits; both numbers grow with the logarithm of the corpus, so that a document
meets as few unrelated ones in a large corpus as in a small one.  Texts of few shingles, whose signatures say little, meet by shared shingles
instead.  So that no group of copies is compared pair by pair, each table entry first links its
members to one of them, and only what is still apart after two such turns is looked up in the
balls.  Every link is verified by the exact similarity of the shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import filled, forget, modest_batches, small, stored, table

SEED = 42
#: Table entries with more fingerprints than this go the second way.
BUCKET = 64
#: Members of a crowded bucket that one task compares with each other, at most twice this.
BLOCK = 1500


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the shingles of a text, A-Z in lower case; with fewer words that of the whole
    sequence, with none an empty array."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, unsigned; zero without hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(words: int = 3):
    """Column function text -> 64-bit fingerprint as a bigint.  Repeated shingles count as often
    as they occur; a null text is an empty one."""

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(majority(shingle_hashes(t or "", words))) for t in texts], dtype="int64")

    return fingerprint


def probes(entries: DataFrame, bits: int) -> DataFrame:
    """entries with ``key`` (segment number above, value in the low bits) replaced by the keys to
    look up, and ``flip``, zero for the key itself."""
    ones = F.explode(F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i).cast("bigint") for i in range(bits))))
    return entries.withColumn("flip", ones).where(F.col("key").bitwiseAND(F.col("flip")) == 0).withColumn("key", F.col("key").bitwiseOR(F.col("flip")))


def segments(words: list[Column], bits: int) -> Column:
    """The keys of signature words' segments: segment number << bits | value."""
    per, mask = 64 // bits, (1 << bits) - 1
    return F.array(*(F.lit((n * per + s) << bits).cast("bigint").bitwiseOR(F.shiftrightunsigned(w, s * bits).bitwiseAND(F.lit(mask).cast("bigint"))) for n, w in enumerate(words) for s in range(per)))


def crowded(entries: DataFrame, most: int = BUCKET) -> DataFrame:
    """The keys with more than ``most`` entries, written once."""
    return stored(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")


def links(fps: DataFrame, *, most: int = BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints ``fp`` whose links join all fingerprints within two
    bits of each other, directly or through fingerprints linked to both."""
    entries = fps.select("fp", F.explode(segments([F.col("fp")], 32)).alias("key"))
    hot = crowded(entries, most)
    asked = probes(entries, 32)
    crowd = not hot.isEmpty()
    known = entries.join(hot.select("key"), "key", "left_anti") if crowd else entries
    met = asked.withColumnRenamed("fp", "a").join(known.withColumnRenamed("fp", "b"), "key")
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    out = met.where((far <= 2) & ((F.col("flip") != 0) | (F.col("a") < F.col("b")))).select("a", "b")
    if crowd:
        members = asked.join(hot.select("key"), "key", "left_semi").select("fp").distinct()
        around = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))))
        shared = members.select("fp", around.alias("centre")).withColumn("root", F.min("fp").over(Window.partitionBy("centre")))
        out = out.unionByName(shared.where("fp != root").select(F.col("root").alias("a"), F.col("fp").alias("b")))
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the least node of the component.  Each
    round hangs the larger neighbours of each node on the least one, then the smaller ones; the
    edges are written after each round, and the rounds end when nothing changes."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(small.where("a != b").distinct(), "edges")
        forget(last)
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def simhash_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, ``fp``, ``component_id``): the least key of all rows whose fingerprints are reachable.

    Null, empty and blank texts have fingerprint zero and link like any other; texts with fewer
    words are one shingle.  Equal rows stay; null keys are left out of the minimum, and a
    component of null keys alone has a null id.  Only the key and the text are read."""
    modest_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(key), simhash(words)(filled(F.col(text))).alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(fps))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


# --- copies of a given similarity -------------------------------------------------------------

#: Least bits of a segment, bits beyond the logarithm of the number of texts, and the share of links
#: at exactly the similarity that segments find (by the binomial law).
SEGMENT, SPARE, RECALL = 20, 2, 0.988
#: Texts of at most so many distinct shingles meet by shingles instead of segments.
FEW = 64
#: Turns in which table entries link to one member, before the balls are looked up.
TURNS = 2
#: Members of its table entries that a text is compared with in a turn.
HUBS = 3
#: Table entries with more members that are still apart are compared block by block, those whose
#: members are near others (by complete distance) from the second number on.
APART, NEAR_APART = 16, 2
#: Shingles that one task compares in such an entry, on average, at most twice this.
BLOCK_SHINGLES = 500_000


def differing(similarity: float) -> float:
    """Share of bits in which sets of that Jaccard similarity, of like size, differ: their angle."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def layout(texts: int, similarity: float) -> tuple[int, int]:
    """(words of a signature, bits of a segment) for so many texts.  A segment's values outnumber
    the texts, so a table entry holds few unrelated ones; there are as many segments as find
    ``RECALL`` of the links up to one bit."""
    bits = min(62, max(SEGMENT, int(np.ceil(np.log2(max(texts, 1)))) + SPARE))
    p = differing(similarity)
    met = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    count = int(np.ceil(np.log(1 - RECALL) / np.log(1 - met))) if 0 < met < 1 else 1
    return -(-count // (64 // bits)), bits


def wide_signature(hashes: np.ndarray, wide: int) -> list[int]:
    """64 * wide bits from distinct shingle hashes, as signed words."""
    out = []
    for k in range(wide):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_signed(majority(z ^ (z >> np.uint64(31)))))
    return out


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets of that similarity, these many least members of each have one in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def wide_simhash(words: int = 5, similarity: float = 0.8, wide: int = 8):
    """Column function text -> (node, size, sig, prefix): a hash of the set of shingles, its size,
    ``wide`` words and, of sets small enough to be like one of FEW, the least shingle hashes."""

    @F.pandas_udf("node bigint, size int, sig array<bigint>, prefix array<bigint>")
    def signature(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = np.unique(shingle_hashes(t or "", words))
            least = h[: prefix_size(len(h), similarity)].view(np.int64).tolist() if len(h) <= FEW / similarity else []
            rows.append((_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), len(h), wide_signature(h, wide), least))
        return pd.DataFrame(rows, columns=["node", "size", "sig", "prefix"])

    return signature


def shingle_sets(words: int = 5):
    """Column function text -> array of the distinct shingle hashes, in unsigned order."""

    @F.pandas_udf("array<bigint>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t or "", words)).view(np.int64) for t in texts], dtype=object)

    return grams


def allowed_distance(similarity: float, bits: int, deviations: int = 3) -> int:
    """Bits in which sets of that Jaccard similarity, of like size, differ: the mean and some
    standard deviations."""
    p = differing(similarity)
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def needed(sizes, similarity: float):
    """Common members that sets of that summed size need to have the similarity."""
    return sizes * (similarity / (1 + similarity)) - 1e-6


def _joining(far: int, similarity: float):
    """For two blocks of a crowded table entry, rows (node, joined, rest, sig, grams): edges that
    join what is within ``far`` bits (or has few shingles) and has the similarity.  Members of
    ``rest`` are compared with all that isn't joined to them yet; each edge joins two groups, so
    there are fewer edges than members."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.array(pdf["sig"].tolist(), dtype=np.int64).view(np.uint64)
        node, group = pdf["node"].to_numpy(), pdf["joined"].to_numpy().copy()
        grams = [np.asarray(g, dtype=np.int64).view(np.uint64) for g in pdf["grams"]]
        size = np.array([len(g) for g in grams])
        edges = []
        for i in np.flatnonzero(pdf["rest"].to_numpy()):
            least, most = np.minimum(size, size[i]), np.maximum(size, size[i])
            at = np.flatnonzero((group != group[i]) & (least > 0) & (least >= similarity * most - 1e-6))
            at = at[(least[at] <= FEW) | (np.bitwise_count(sig[at] ^ sig[i]).sum(axis=1, dtype=np.int64) <= far)]
            if not len(at):
                continue
            among = np.concatenate([grams[j] for j in at])
            place = np.minimum(np.searchsorted(grams[i], among), size[i] - 1)
            common = np.add.reduceat(grams[i][place] == among, np.cumsum(size[at]) - size[at], dtype=np.int64)
            for j in at[common >= needed(size[at] + size[i], similarity)]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    edges.append((node[i], node[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return join


def linkable(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of members (key, node, size, ...) of table entries, those that may have a link to another member
    of the entry, with ``up_to``, the size of the largest such set; sets (node, grams) are their shingles.

    Shingles that no other set has are in no overlap, so a set has links only to sets up to the
    size at which the rest of its shingles are still enough.  Where that is less than its own size,
    the other set has room for as large ones as itself.  So the copies of one text that are each
    changed too much to be copies of each other aren't compared in every entry that they share."""
    alone = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    up_to = (F.col("size") - F.coalesce("alone", F.lit(0)) + 2e-6) * ((1 + similarity) / similarity) - F.col("size")
    step = lambda n: F.floor(F.log2(n) * 64)
    told = members.join(alone, "node", "left").withColumn("up_to", up_to).drop("alone").withColumn("roomy", F.col("up_to") >= F.col("size"))
    told = stored(told, "told")
    sizes = told.where("roomy").groupBy("key").agg(F.collect_set(step("size")).alias("steps"))  # some 64 for each doubling of the size
    fits = F.exists("steps", lambda s: (s >= step(F.col("size") * similarity - 1e-6)) & (s <= step("up_to")))
    return told.join(sizes, "key").where(F.col("roomy") | F.coalesce(fits, F.lit(False))).select(*members.columns, "up_to")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def nearest_hubs(spokes: DataFrame, most: int = HUBS) -> DataFrame:
    """Of spokes (node, centre), a row an entry, each node's ``most`` centres that it shares most
    entries with, so that a member of a large group is verified a few times, not once an entry.
    What these don't join is still apart, and looked up behind the turns."""
    shared = spokes.groupBy("node", "centre").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("by"), F.xxhash64("centre").alias("at"), "centre")
    best = shared.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("best"))  # at most an entry's hub each
    return best.select("node", F.explode("best.centre").alias("centre"))


def similar_roots(nodes: DataFrame, texts: DataFrame, *, words: int, similarity: float, shape: tuple[int, int], most: int = APART) -> DataFrame:
    """(node, root) of nodes (node, size, sig, prefix, content) that have a link: shingles of the
    similarity, root the least node reachable.

    Candidates share a segment up to one bit or, with few shingles, one of the least shingles.
    First each table entry links its members to one of them, of which a member is verified with
    HUBS a turn; then pairs are formed only between what is still apart, in entries with more than
    ``most`` members, or NEAR_APART that are near others, within tasks, block by block.  Of these
    entries' members only the linkable() ones are compared, behind one more turn to the one that
    shares most.  The shingles are made again from texts (content, text), of candidates alone."""
    words_of, bits = shape
    far = allowed_distance(similarity, 64 * words_of)
    met_before: list[DataFrame] = []  # nodes near others

    def entered(rows: DataFrame, *carried: str) -> DataFrame:
        """Entries of the table; keys of shingles are negative, those of segments are not."""
        wide = rows.where(F.col("size") > FEW).select(*carried, F.col("sig")[0].alias("glance"), F.explode(segments([F.col("sig")[k] for k in range(words_of)], bits)).alias("key"))
        little = rows.select(*carried, F.lit(0).cast("bigint").alias("glance"), F.explode(F.transform("prefix", lambda h: h.bitwiseOR(F.lit(-(1 << 63)).cast("bigint")))).alias("key"))
        return wide.unionByName(little)

    def asking(entries: DataFrame) -> DataFrame:
        return probes(entries.where("key >= 0"), bits).unionByName(entries.where("key < 0").withColumn("flip", F.lit(0).cast("bigint")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = small(nodes.select("node", "content").join(small(wanted), "node", "left_semi"))
        once = texts.join(wanted, "content").dropDuplicates(["content"])
        return stored(once.select("node", shingle_sets(words)(F.col("text")).alias("grams")), "shingles")

    def glanced(a: str, b: str) -> Column:
        """Whether the first words of two signatures differ in few bits; those of shingles are 0."""
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= allowed_distance(similarity, 64, 4)

    alike = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by complete distance and then by the shingles."""
        sa, sb = (nodes.select(F.col("node").alias(c), F.col("sig").alias("s" + c), F.col("size").alias("n" + c)) for c in "ab")
        distance = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(words_of)), F.lit(0))
        close = alike & ((F.least("na", "nb") <= FEW) | (distance <= far))
        near = stored(pairs.join(sa, "a").join(sb, "b").where(close).select("a", "b"), "candidates")
        own = stored(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near")
        met_before.append(own)
        sets = sets_of(own)
        ga, gb = (sets.select(F.col("node").alias(c), F.col("grams").alias("g" + c)) for c in "ab")
        common = F.size(F.array_intersect("ga", "gb"))
        return near.join(ga, "a").join(gb, "b").where(common >= needed(F.size("ga") + F.size("gb"), similarity)).select("a", "b")

    roots = None

    def placed() -> DataFrame:
        if roots is None:
            return nodes.withColumn("joined", F.col("node"))
        return nodes.join(roots, "node", "left").withColumn("joined", F.coalesce("root", "node")).drop("root")

    def joined_by(links: DataFrame) -> DataFrame:
        """The roots with more links, which are first taken as links between roots, so that what is
        joined already isn't gone through again."""
        if roots is None:
            return components(links)
        for c in "ab":
            known = roots.select(F.col("node").alias(c), F.col("root").alias("top"))
            links = links.join(known, c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        above = components(links)
        moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return stored(moved.unionByName(above), "roots")

    for turn in range(TURNS):
        entries = entered(placed(), "node", "joined")
        hubs = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "joined", "glance")).alias("hub"), (F.min("joined") != F.max("joined")).alias("apart"))
        spokes = entries.join(hubs.where("apart").select("key", F.col("hub.node").alias("centre"), F.col("hub.joined").alias("whose"), F.col("hub.glance").alias("seen")), "key")
        roots = joined_by(verified(nearest_hubs(spokes.where((F.col("joined") != F.col("whose")) & glanced("glance", "seen"))).select(*_pair("node", "centre")).distinct()))

    near = met_before[0]
    for more in met_before[1:]:
        near = near.unionByName(more)
    near = stored(near.distinct().withColumn("near", F.lit(True)), "near")

    def all_entries() -> tuple[DataFrame, DataFrame]:
        marked = placed().join(small(near), "node", "left").withColumn("near", F.coalesce("near", F.lit(False)))
        own = stored(entered(marked, "node", "joined", "size", "near"), "entries")
        return own, asking(own)

    entries, asked = all_entries()
    counts = entries.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("near"), 1)).alias("n_near"))
    hot = stored(counts.where((F.col("n") > most) | (F.col("n_near") > min(most, NEAR_APART))).select("key", (F.col("n") > most).alias("whole")), "crowded")
    own_members = None
    if not hot.isEmpty():
        found = stored(asked.join(hot, "key").where("whole or near").select("key", "node", "size", "joined").distinct(), "found")
        apart = found.groupBy("key").agg((F.min("joined") != F.max("joined")).alias("apart")).where("apart").select("key")
        members = stored(found.join(apart, "key", "left_semi"), "members")
        sets = sets_of(members.select("node").distinct())
        compared = stored(sets.join(nodes.select("node", "sig"), "node"), "compared")
        own_members = stored(linkable(members, sets, similarity), "linkable")
        for done in (found, members, sets):
            forget(done)
        # one more turn, to the member of each entry that shares most of its shingles: the text that others are made from
        central = own_members.groupBy("key").agg(F.max(F.struct(F.col("up_to") / F.col("size"), F.xxhash64("node"), "node", "joined")).alias("hub")).select("key", F.col("hub.node").alias("centre"), F.col("hub.joined").alias("whose"))
        spokes = own_members.join(central, "key").where("joined != whose").select("node", "centre")
        roots = joined_by(verified(nearest_hubs(spokes).select(*_pair("node", "centre")).distinct()))

    def up_to_date(rows: DataFrame) -> DataFrame:
        """rows with the roots that ``joined`` names replaced by theirs."""
        now = rows.select(F.col("joined").alias("node")).distinct().join(placed().select("node", F.col("joined").alias("now")), "node")
        return rows.join(small(now.select(F.col("node").alias("joined"), "now")), "joined").withColumn("joined", F.col("now")).select(*rows.columns)

    if own_members is not None:
        members = stored(up_to_date(own_members), "members")
        largest = members.groupBy("key", "joined").agg(F.count("*").alias("n"), F.sum("size").alias("s")).groupBy("key").agg(F.max(F.struct("n", "joined", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")).where("groups > 1")
        share = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
        plan = largest.select("key", F.col("main.joined").alias("whose"), share(F.col("main.n"), F.col("main.s")).alias("mains"), share(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rests"))
        own = members.join(plan, "key").withColumn("rest", F.col("joined") != F.col("whose"))
        own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
        up_to = lambda n: F.sequence(F.lit(0), n - 1)
        with_main = F.transform(up_to(F.col("mains")), lambda m: F.struct(F.col("block").alias("lo"), (-1 - m).alias("hi")))
        with_rest = F.transform(up_to(F.col("rests")), lambda r: F.struct(F.least(r, F.col("block")).alias("lo"), F.greatest(r, F.col("block")).alias("hi")))
        of_main = F.transform(up_to(F.col("rests")), lambda r: F.struct(r.alias("lo"), (-1 - F.col("block")).alias("hi")))
        dealt = own.select("key", "node", "joined", "rest", F.explode(F.when(F.col("rest"), F.concat(with_main, with_rest)).otherwise(of_main)).alias("blocks"))
        dealt = stored(dealt, "dealt")
        if not dealt.isEmpty():
            roots = joined_by(dealt.join(compared, "node").groupBy("key", "blocks").applyInPandas(_joining(far, similarity), "a bigint, b bigint"))
        for done in (own_members, members, dealt, compared, entries):
            forget(done)
        entries, asked = all_entries()
    know = entries.select("key", F.col("node").alias("b"), F.col("size").alias("nb"), F.col("glance").alias("gb"), F.col("joined").alias("jb"), F.col("near").alias("close_b"))
    know = know.join(hot, "key", "left").where(~F.coalesce("whole", F.lit(False)))  # ``whole`` is null where the entry isn't crowded
    ask = asked.select("key", "flip", F.col("node").alias("a"), F.col("size").alias("na"), F.col("glance").alias("ga"), F.col("joined").alias("ja"), F.col("near").alias("close_a"))
    done = F.col("whole").isNotNull() & F.col("close_a") & F.col("close_b")
    met = ask.join(know, "key").where((F.col("ja") != F.col("jb")) & alike & glanced("ga", "gb") & ((F.col("flip") != 0) | (F.col("a") < F.col("b"))) & ~done)
    return joined_by(verified(met.select(*_pair("a", "b")).distinct()))


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, most: int = APART) -> DataFrame:
    """docs with one row kept of each group of copies: that of the least key (null keys last).

    Texts with equal shingle sets, and texts that links of at least the exact similarity join,
    are one group; so are all null, empty and blank texts.  Of rows that
    repeat both key and text one stays.  docs are counted first, for the width of the segments, and
    read four times.  The columns are those of docs, whatever their names."""
    modest_batches(docs.sparkSession)
    content = F.xxhash64(filled(F.col(text)))
    shape = layout(docs.count(), similarity)
    made = docs.select(F.col(key).alias("key"), content.alias("content"), wide_simhash(words, similarity, shape[0])(filled(F.col(text))).alias("made"))
    rows = stored(made.select("key", "content", "made.*"), "signatures")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "content")).alias("least")
    nodes = stored(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"), F.min("content").alias("content"), least), "nodes")
    texts = docs.select(content.alias("content"), filled(F.col(text)).alias("text"))
    roots = similar_roots(nodes, texts, words=words, similarity=similarity, shape=shape, most=most)
    rooted = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"), F.col("least.content").alias("content"))
    again = rows.groupBy("key", "content").agg(F.count("*").alias("n")).select("key", "content", (F.col("n") > 1).alias("again"))
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["content"] == b["content"])
    kept = stored(kept.join(again, same(kept, again)).select(kept["key"], kept["content"], "again"), "kept")
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), content.alias("content"))
    stay = whole.join(kept, same(whole, kept)).select("row", whole["key"], whole["content"], "again")
    if kept.where("again").isEmpty():
        return stay.select("row.*")
    once = stay.where("again").dropDuplicates(["key", "content"])
    return stay.where("not again").unionByName(once).select("row.*")
