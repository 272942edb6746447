"""Discourse markers by class, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marker lists, one phrase a line, and the numbers of the classes.
REASON = """because"""
RESULT = """accordingly
as a consequence
as a result
consequently
hence
in response
so IN
so that
subsequently
thereby
therefore
thus"""
POSSIBLE_REASON = """after
as
for
insofar as
now that
once
since
so
then
ultimately
when"""
POSSIBLE_RESULT = """and
as
finally
in the end
in turn
now that
once
so
then
ultimately
when"""
NONCAUSAL = """additionally
afterward
also
alternatively
although
as an alternative
as if
as long as
as soon as
as though
as well
before
before and after
besides
but
by comparison
by contrast
conversely
earlier
either or
except
for example
for instance
further
furthermore
however
if
if and when
if then
in addition
in contrast
in fact
in other words
in particular
in short
in sum
in the end
indeed
instead
later
lest
likewise
meantime
meanwhile
moreover
much as
neither nor
nevertheless
next
nonetheless
nor
on the contrary
on the other hand
or
otherwise
overall
plus
previously
rather
regardless
separately
similarly
simultaneously
specifically
still
thereafter
though
till
unless
until
whereas
when and if
while
yet"""
POSSIBLE_NONCAUSAL = """after
and
as
finally
in turn
now that
once
since
then
ultimately
when"""
ALL = """accordingly
additionally
after
afterwards
also
although
and
as
as a consequence
as a matter of fact
as a result
as it turns out
at that time
at the same time
at the time
because
before
besides
but
by comparison
by contrast
consequently
earlier
even though
eventually
ever since
finally
first
for
for example
for instance
for one
for one thing
further
furthermore
hence
however
in addition
in comparison
in contrast
in fact
in other words
in particular
in response
in return
in short
in sum
in summary
in the end
in the meantime
in turn
inasmuch as
incidentally
indeed
insofar as
instead
later
likewise
meanwhile
moreover
nevertheless
next
nonetheless
now
on the contrary
on the one hand
on the other hand
on the whole
or
overall
particularly
plus
previously
rather
regardless
second
separately
similarly
simultaneously
since
since then
so
so far
so that
soon
specifically
still
subsequently
that be
then
thereafter
therefore
third
though
thus
to this end
ultimately
what be more
when
whereas
while
yet"""
MODAL = """be
can
could
dare
do
have
may
might
must
need
ought
shall
should
will
would"""
LABELS = {"binary": {"notcausal": 0, "causal": 1, "other": 2}, "trinary": {"notcausal": 0, "reason": 1, "result": 2, "other": 3}}

SETS = {
    "reason": REASON,
    "result": RESULT,
    "possible_reason": POSSIBLE_REASON,
    "possible_result": POSSIBLE_RESULT,
    "notcausal": NONCAUSAL,
    "possible_notcausal": POSSIBLE_NONCAUSAL,
    "all": ALL,
}
LONGEST = 5


def phrases(name: str) -> list[str]:
    """The phrases of a set; ``causal`` is the union of reason and result."""
    if name == "causal":
        return [*phrases("reason"), *phrases("result")]
    return SETS[name].split("\n")


def frame(spark: SparkSession, *names: str) -> DataFrame:
    """(class, phrase, n): the sets' phrases in lower case and their lengths.  A few hundred rows
    at most, so that it may be broadcast."""
    rows = sorted({(name, p.lower(), len(p.split())) for name in names for p in phrases(name)})
    return spark.createDataFrame(rows, "class string, phrase string, n int")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).select("phrase", "n").distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("phrase", "n").subtract(b.select("phrase", "n"))


def label_number(name: Column, system: str = "trinary") -> Column:
    """The number of a class; unknown and null names are ``other``."""
    out = F.lit(LABELS[system]["other"])
    for label, number in LABELS[system].items():
        out = F.when(name == label, number).otherwise(out)
    return out


def label_name(number: Column, system: str = "trinary") -> Column:
    out = F.lit("other")
    for label, k in LABELS[system].items():
        out = F.when(number == k, label).otherwise(out)
    return out


def collapsed(number: Column) -> Column:
    """Three classes to two: reason and result are causal, other stays other."""
    return F.when(number.isin(1, 2), 1).when(number == 3, 2).otherwise(number)
