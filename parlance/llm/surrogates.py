"""Personal data replaced by keyed surrogates of the same type and form.

Mail addresses, telephone numbers, IPv4 addresses, card numbers (that pass the Luhn test) and
account numbers, social security numbers, secrets behind an assignment, and names behind a form
of address are found in each text; the words of such a name are also replaced where they stand
alone in the same text.  A number, address or secret is replaced by a keyed permutation, without
fixed points, of all strings of its form (digits for digits, letters of the same case for
letters, punctuation kept): a Feistel network over the form's range, walked until the value falls
into it.  As a permutation it gives different entities different surrogates, and the same entity
the same one everywhere.  Card numbers keep their Luhn remainder and account numbers have fresh
check digits.  Names are replaced word by word, each word always by the same syllables of its
script (Latin, Greek, Cyrillic), so surnames still refer to full names; given names have an
ending of the gender that forms of address tell, in all texts together.

Collisions are still looked for, over the distinct entities of all texts: surrogates that two
entities share, or that are entities themselves.  Such entities take the next attempt, round by
round until none is left, and only their overrides travel to the texts.  Forms so crowded that
after ``REAL_ROUNDS`` their surrogates still meet other entities (most of all telephone numbers
of a few digits, say) go back to the first permutation, which is distinct but may meet them.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, stored, table

#: The session setting that ``op4_pii`` and the pipeline take their key from, and their key without it,
#: which is public and fit for tests alone.  The operators have no key of their own.
KEY_SETTING, TEST_KEY = "spark.parlance.surrogateKey", "public test key"
#: Rounds in which a surrogate may not be another entity.
REAL_ROUNDS = 8
#: Kinds whose surrogates are permutations of their forms.
PERMUTED = ("card", "iban", "phone", "ip", "email", "ssn")
#: Overrides that are handed to the tasks as a list; more of them are joined.
MOST_LISTED = 50_000
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Srta", "κα", "госпожа")
MALE = ("Mr", "Herr", "Sr", "κος", "господин")
EITHER = ("Dr", "Prof")


def _capitals() -> str:
    """Ranges of all upper and title case letters, for a character class."""
    at = [c for c in range(0x20000) if unicodedata.category(chr(c)) in ("Lu", "Lt")]
    first = [c for c, before in zip(at, [-1, *at]) if c != before + 1]
    last = [c for c, after in zip(at, [*at[1:], -1]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))


_UPPER, _LETTER = f"[{_capitals()}]", r"(?:[^\W\d_]|[\u0300-\u036f])"
#: A capital and letters of any case and script, with inner hyphens and apostrophes.  An
#: apostrophe is inner behind a first letter (O'Brien) or before a capital, not in Smith's.
_NAME = rf"{_UPPER}(?:['’ʼ]{_LETTER}+|{_LETTER}+)(?:['’ʼ](?={_UPPER}){_LETTER}{{2,}}|[-‐‑]{_LETTER}+)*"
_SECRET = r"\b(?i:token|secret|password|passwd|api[_-]?key)\b\s*[:=]\s*[\"']"

#: What every entity has one of.
_PART = re.compile(r"[^\s\-‐‑]+")
_CAPITALISED = re.compile(rf"(?<!\w){_UPPER}(?:[^\W\d_]|[\u0300-\u036f]|['’ʼ](?=[^\W\d_]))+")
_TRIGGER = re.compile(r"[\d@]|\b(?:" + "|".join(FEMALE + MALE + EITHER) + r")\b|" + _SECRET)
_FIND = re.compile(
    rf"(?P<secret>{_SECRET})"
    r"(?P<value>[^\"'\s]{6,})(?=[\"'])"
    r"|(?<![A-Za-z0-9._%+-])[._%+-]*(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\d.]*\d))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w.])(?!(?:19|20)\d\d-\d\d-\d\d(?!\d))(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w]|[.-]\d)|(?<![\w.])\+\d{7,15}(?!\d))"
    rf"|(?P<form>\b(?:{'|'.join(FEMALE + MALE + EITHER)})\b\.? )(?P<name>{_NAME}(?: {_NAME}){{0,2}})"
)


def _digest(*parts: str) -> int:
    """A keyed hash; the first part begins with the key, up to a bar."""
    key, _, first = parts[0].partition("|")
    own = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=32).digest()
    return int.from_bytes(hashlib.blake2b("\x1f".join((first, *parts[1:])).encode("utf-8", "surrogatepass"), key=own, digest_size=32).digest(), "big")


def permuted(value: int, size: int, tweak: str) -> int:
    """A keyed permutation of range(size) without fixed points: a Feistel network of eight
    rounds, the next value, and the network's way back."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def walk(value: int, rounds) -> int:
        while True:
            left, right = value >> half, value & mask
            for r in rounds:
                left, right = right, left ^ (_digest(tweak, str(r), str(right)) & mask)
            value = right << half | left  # halves change places, so the reversed rounds lead back
            if value < size:
                return value

    return walk((walk(value, range(8)) + 1) % size, range(7, -1, -1))


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _digits(c: str) -> str | None:
    """The ten digits of the script of a digit that is not ASCII."""
    return "".join(chr(ord(c) - int(c) + i) for i in range(10)) if c.isdecimal() and not c.isascii() else None


def same_form(text: str, tweak: str, alphabets=_ALPHABETS) -> str:
    """text with each character of an alphabet replaced by one of the same alphabet, as a
    permutation of all texts of this form."""
    kinds = [next((a for a in alphabets if c in a), None) or _digits(c) for c in text]
    form = "".join("x" if k is None else str(alphabets.index(k)) if k in alphabets else k[0] for k in kinds)
    rest = "".join(c for c, k in zip(text, kinds) if k is None)
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    value = permuted(value, size, f"{tweak}|{form}|{rest}")
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, i = divmod(value, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Luhn remainder; valid numbers have 0."""
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _card(text: str, tweak: str) -> str:
    """The first digit (the issuer's kind) and the Luhn remainder stay."""
    digits = re.sub(r"\D", "", text)
    middle = same_form(digits[1:-1], f"{tweak}|{digits[0]}|{luhn(digits)}")
    last = next(d for d in "0123456789" if luhn(digits[0] + middle + d) == luhn(digits))
    fresh = iter(digits[0] + middle + last)
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _iban(text: str, tweak: str) -> str:
    """The country stays and the check digits are made anew."""
    bare = text.replace(" ", "")
    body = same_form(bare[4:], f"{tweak}|{bare[:4]}")
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    fresh = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(next(fresh) if c != " " else c for c in text)


def _phone(text: str, tweak: str) -> str:
    """The country code stays."""
    country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    at = country.end() if country else 0
    return text[:at] + same_form(text[at:], f"{tweak}|{text[:at]}")


def _ip(text: str, tweak: str) -> str:
    return str(ipaddress.IPv4Address(permuted(int(ipaddress.IPv4Address(text)), 1 << 32, tweak)))


def _email(text: str, tweak: str) -> str:
    """The top-level domain stays."""
    front, _, top = text.rpartition(".")
    return same_form(front, tweak) + "." + top


#: Syllables, and endings of female and male names, by script.
_SYLLABLES = {
    "latin": (("ba", "co", "da", "el", "fi", "ga", "ho", "ka", "li", "mo", "na", "or", "pe", "ri", "sa", "tu"), ("a", "ina"), ("o", "en")),
    "greek": (("αλ", "βα", "γε", "δη", "ελ", "ζω", "θε", "ιρ", "κα", "λε", "μα", "νι", "πε", "ρο", "σο", "τι"), ("α", "η"), ("ος", "ης")),
    "cyrillic": (("ба", "ви", "га", "да", "ел", "жо", "за", "ил", "ка", "ла", "ми", "на", "ол", "по", "ра", "то"), ("а", "ина"), ("ов", "ин")),
}


def _script(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "greek" if "Ͱ" <= c < "Ѐ" else "cyrillic" if "Ѐ" <= c < "԰" else "latin"


def _name(word: str, tweak: str, role: str) -> str:
    """Three or four syllables, two more for each attempt (at the end of the tweak), and for
    given names of a known gender an ending that isn't a syllable, so different syllables stay
    different."""
    longer = min(2 * int(tweak.rpartition("|")[2]), 40)
    syllables, female, male = _SYLLABLES[_script(word)]
    n = _digest(tweak, word)
    body = "".join(syllables[n >> 4 * k & 15] for k in range(3 + (n >> 40) % 2))
    body += "".join(syllables[n >> 64 + 4 * k & 15] for k in range(longer))
    ends = {"female": female, "male": male}.get(role, ("",))
    return (body + ends[(n >> 48) % len(ends)]).capitalize()


def _name_forms(word: str, attempt: int, key: str) -> list[str]:
    """All that a word of a name can become at an attempt."""
    return [surrogate(f"name:{role}", word, attempt, key) for role in ("last", "female", "male")]


def _secret(text: str, tweak: str, attempt: int) -> str:
    """Of the same form, hexadecimal digits for such; letters of a digest where the form has
    nothing to permute or letters of other scripts, or is used up."""
    if attempt > 3 or not text.isascii() or not any(c.isalnum() for c in text):
        n = _digest(tweak, text)
        return "".join(chr(97 + n // 26**k % 26) for k in range(min(50, max(12, len(text)) + attempt)))
    for alphabet in _HEX:
        if all(c in alphabet for c in text):
            return same_form(text, tweak, (alphabet,))
    return same_form(text, tweak)


@functools.lru_cache(50_000)
def surrogate(kind: str, text: str, attempt: int, key: str) -> str:
    """kind is a type, of a name's word with its role (female, male or any for given names, last)
    behind a colon."""
    base, _, role = kind.partition(":")
    tweak = f"{key.replace('|', '/')}|{base}|{attempt}"
    if base == "name":
        return _name(text, tweak, role)
    make = {"card": _card, "iban": _iban, "phone": _phone, "ip": _ip, "email": _email}.get(base)
    if make:
        return make(text, tweak)
    if base == "secret":
        return _secret(text, tweak, attempt)
    return same_form(text, tweak)


def _more_mentions(text: str, told: dict[str, str], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The words of told names where they stand alone, outside what is found, in one pass."""
    out, k = [], 0
    for m in _CAPITALISED.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        word = m[0] if m[0] in told else m[0][:-2] if m[0][-2:] in ("'s", "’s") else ""
        stop = m.start() + len(word)
        if word in told and not (k < len(found) and found[k][0] < stop):
            out.append((m.start(), stop, "name:" + told[word]))
    return out


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the entities of a text, left to right; names word by word."""
    if not _TRIGGER.search(text):
        return []
    out, told = [], {}
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            form = m["form"].strip(" .")
            gender = "female" if form in FEMALE else "male" if form in MALE else "any"
            surname = m.start("name") + m["name"].rfind(" ")
            for part in _PART.finditer(text, m.start("name"), m.end("name")):
                role = told.setdefault(part[0], gender if part.start() < surname else "last")
                out.append((part.start(), part.end(), "name:" + role))
            continue
        kind, group = ("secret", "value") if kind == "value" else (kind, kind)
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[group]) <= 15:
            continue
        if kind == "card" and luhn(re.sub(r"\D", "", m[group])):
            continue
        out.append((m.start(group), m.end(group), kind))
    return sorted(out + _more_mentions(text, told, out)) if told else out


def _replaced(text: str, overrides: dict[tuple[str, str], tuple[int, str | None]], key: str) -> tuple[str, list[dict]]:
    out, at, found = [], 0, []
    for a, b, kind in entities(text):
        base, _, role = kind.partition(":")
        attempt, gender = overrides.get((base, text[a:b]), (0, None))
        if gender and role != "last":
            kind = f"name:{gender}"
        new = surrogate(kind, text[a:b], attempt, key)
        out += [text[at:a], new]
        at = b
        found.append({"start": a, "stop": b, "kind": kind, "surrogate": new})
    return "".join([*out, text[at:]]), found


def found_entities(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """(kind, entity, surrogate, n, female, male, any): the distinct entities of all texts (names
    by words), their first surrogates and their numbers of mentions, in all and, of given names,
    by gender.  Only mentions are shuffled, summed up in each task first."""

    def find(batches):
        for batch in batches:
            rows = []
            for t in batch["text"]:
                for a, b, kind in entities(t) if t else ():
                    base, _, role = kind.partition(":")
                    rows.append((base, t[a:b], surrogate(kind if base != "name" else "name:last", t[a:b], 0, key), role))
            yield pd.DataFrame(rows, columns=["kind", "entity", "surrogate", "role"])

    seen = docs.select(F.col(text).alias("text")).mapInPandas(find, "kind string, entity string, surrogate string, role string")
    by_role = (F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("female", "male", "any"))
    return seen.groupBy("kind", "entity").agg(F.first("surrogate").alias("surrogate"), F.count("*").alias("n"), *by_role)


def collision_free(found: DataFrame, *, key: str, rounds: int = 50) -> DataFrame:
    """found with ``attempt``: 0, or the first at which no two entities share a surrogate and no
    surrogate is an entity (but for crowded forms).  Of entities that collide the least keeps its
    surrogate."""

    @F.pandas_udf("string")
    def make(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, int(a), key) for k, e, a in zip(kind, entity, attempt)], dtype=object)

    @F.pandas_udf("array<string>")
    def forms(kind: pd.Series, entity: pd.Series, attempt: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([_name_forms(e, int(a), key) if k == "name" else [s] for k, e, a, s in zip(kind, entity, attempt, first)], dtype=object)

    rows = stored(found.withColumn("attempt", F.lit(0)), "entities")
    real = rows.select(F.col("entity").alias("form")).distinct()
    crowded: list[str] = []
    for turn in range(rounds):
        # of one string found as two kinds either surrogate will do
        shared = rows.groupBy("surrogate").agg(F.min("entity").alias("least"), F.max("entity").alias("most")).where("least != most").select("surrogate", "least")
        clash = rows.join(shared, "surrogate").where("entity != least").select("kind", "entity")
        strict = rows.where(~F.col("kind").isin(crowded)) if crowded else rows
        told = strict.select("kind", "entity", F.explode(forms("kind", "entity", "attempt", "surrogate")).alias("form"))
        clash = clash.unionByName(told.join(real, "form", "left_semi").select("kind", "entity"))
        clash = stored(clash.unionByName(rows.where("surrogate = entity").select("kind", "entity")).distinct().withColumn("again", F.lit(1)), "clashes")
        if clash.isEmpty():
            return rows
        if turn == REAL_ROUNDS:
            crowded = [r["kind"] for r in clash.where(F.col("kind").isin(*PERMUTED)).select("kind").distinct().collect()]  # at most len(PERMUTED)
            back = F.col("kind").isin(crowded) if crowded else F.lit(False)
            first = make("kind", "entity", F.lit(0))
            rows = stored(rows.withColumns({"surrogate": F.when(back, first).otherwise(F.col("surrogate")), "attempt": F.when(back, 0).otherwise(F.col("attempt"))}), "entities")
            continue
        rows = rows.join(clash, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        rows = stored(rows.withColumn("surrogate", F.when(F.col("again") == 1, make("kind", "entity", "attempt")).otherwise(F.col("surrogate"))).drop("again"), "entities")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def pseudonymised(docs: DataFrame, *, key: str, text: str = "text", out: str = "text", spans: str | None = None) -> DataFrame:
    """docs with the entities of its texts replaced, in ``out``, and, if named, the array of
    (start, stop, kind, surrogate), positions in the old text.

    Null texts stay null and texts without entities, empty ones too, as they are; repeated rows
    stay.  Equal entities have equal surrogates in all rows.  docs is read twice, once for the
    entities.  The few entities that collide, and given names told with several genders, are
    listed to the tasks if they are at most MOST_LISTED, else joined by mention."""
    modest_batches(docs.sparkSession)
    table_of = collision_free(found_entities(docs, text=text, key=key), key=key)
    several = sum((F.col(r) > 0).cast("int") for r in ("female", "male", "any")) > 1
    gender = F.when(several, F.when((F.col("female") >= F.col("male")) & (F.col("female") > 0), "female").otherwise("male"))
    changed = table_of.where((F.col("attempt") > 0) | several).select("kind", "entity", "attempt", gender.alias("gender"))
    listed = {(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in changed.limit(MOST_LISTED + 1).collect()}
    result = "text string, spans array<struct<start: int, stop: int, kind: string, surrogate: string>>"
    made = fresh(docs, "made")

    def apply(texts, overrides):
        rows = [(None, []) if t is None else _replaced(t, overrides(i), key) for i, t in enumerate(texts)]
        return pd.DataFrame(rows, columns=["text", "spans"], dtype=object)

    if len(listed) <= MOST_LISTED:

        def replace(texts: pd.Series) -> pd.DataFrame:
            return apply(texts, lambda i: listed)

        done = docs.withColumn(made, F.pandas_udf(replace, result)(F.col(text)))
    else:

        def mentions(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"kind": k.partition(":")[0], "entity": t[a:b]} for a, b, k in entities(t)] if t else [] for t in texts], dtype=object)

        def replace_own(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
            return apply(texts, lambda i: {(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in own.iloc[i]} if own.iloc[i] is not None else {})

        content = F.sha2(filled(F.col(text)).cast("binary"), 256)
        told = docs.select(content.alias("content"), F.explode(F.pandas_udf(mentions, "array<struct<kind: string, entity: string>>")(F.col(text))).alias("m")).distinct()
        own = told.select("content", "m.*").join(changed, ["kind", "entity"]).groupBy("content").agg(F.collect_set(F.struct("kind", "entity", "attempt", "gender")).alias("own"))
        mark, mine = fresh(docs, "content"), fresh(docs, "own")
        own = own.select(F.col("content").alias(mark), F.col("own").alias(mine))
        marked = docs.withColumn(mark, content).join(own, mark, "left").drop(mark)
        done = marked.withColumn(made, F.pandas_udf(replace_own, result)(F.col(text), F.col(mine))).drop(mine)
    columns = {out: F.col(made)["text"]} | ({spans: F.col(made)["spans"]} if spans else {})
    return done.withColumns(columns).drop(made)


def session_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pseudonymised(docs, key=session_key(spark), spans="spans")
    return rows.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.col("spans.kind"), lambda k: F.split_part(k, F.lit(":"), F.lit(1))))), ",").alias("kinds"))
