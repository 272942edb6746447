"""Predicates on names of semantic frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts and names that make a frame causal, a reason, a result or anticausal.
CAUSAL_PARTS = ("caus", "purpose", "required", "consequence", "result", "response", "enabled")
CAUSAL_NAMES = ("reason", "explanation", "effect", "trigger")
REASON_PARTS = ("caus", "purpose", "required")
REASON_NAMES = ("reason", "explanation", "trigger")
RESULT_PARTS = ("effect", "consequence", "result", "response", "enabled")
ANTICAUSAL_NAMES = (
    "Requirements", "Have_as_requirement", "Statement", "Occasion", "Supplier", "Thriving", "Seeking", "Expectation", "Being_necessary",
    "Clarity_of_resolution", "Circumstances", "Relative_time", "Idiosyncrasy", "Compliance", "Aggregate", "Estimation", "Bringing",
    "Perception_active", "Responding_entity", "Evaluative_comparison", "Justifying", "Waiting", "Taking_sides", "Questioning",
    "Proposed_action", "Evaluee", "Descriptor", "Evidence", "Defend", "Activity_ongoing", "Boundary", "Coming_up_with", "Interval",
    "Explaining_the_facts", "Communicate_categorization", "Terms_of_agreement", "Requirement", "Process", "State",
    "Remembering_experience", "Defender", "Categorization", "Indicating", "Appointing", "Consideration", "Depictive",
    "Coming_to_believe", "Proposition",
)


def _any(frame: Column, parts: tuple[str, ...], names: tuple[str, ...] = ()) -> Column:
    low = F.lower(frame)
    out = low.isin(*names) if names else F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return F.coalesce(out, F.lit(False))


def is_causal(frame: Column) -> Column:
    return _any(frame, CAUSAL_PARTS, CAUSAL_NAMES)


def is_reason(frame: Column) -> Column:
    return _any(frame, REASON_PARTS, REASON_NAMES)


def is_result(frame: Column) -> Column:
    return _any(frame, RESULT_PARTS)


def is_anticausal(frame: Column) -> Column:
    """Told by the exact name, capitals included."""
    return F.coalesce(frame.isin(*ANTICAUSAL_NAMES), F.lit(False))


def token_frames(sentences: DataFrame, key: str, *, tokens: str = "tokens", frames: str = "frames") -> DataFrame:
    """(key, pos, token, frame): the frame of each token; of several spans over it the last listed.
    ``frames`` is an array of (name, spans array of (start, end))."""
    words = sentences.select(key, F.posexplode(tokens).alias("pos", "token"))
    listed = sentences.select(key, F.posexplode(frames).alias("ord", "f")).select(key, "ord", F.col("f.name").alias("name"), F.explode("f.spans").alias("s")).where(F.col("s.end") > F.col("s.start"))
    covered = listed.select(key, "ord", "name", F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias("pos"))
    last = covered.groupBy(key, "pos").agg(F.max_by("name", "ord").alias("frame"))
    return words.join(last, [key, "pos"], "left")


def conll(index: Column, word: Column, pos: Column, head: Column, rel: Column) -> Column:
    """A token's line of ten tab-separated fields, counted from 1; the root's head is 0."""
    blank = F.lit("_")
    return F.concat_ws("\t", (index + 1).cast("string"), word, blank, pos, pos, blank, (head + 1).cast("string"), rel, blank, blank)
