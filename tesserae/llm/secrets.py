"""Secret scans: pattern spans, plus high-entropy windows per character class with an allow-list.

Only DataFrame functions. Positions come from pairing what a pattern matches with what lies between the
matches: both lists follow the same leftmost, non-overlapping scan, so running lengths are exact offsets in
code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import fresh, let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails whole: it starts at the run's first character, so the bound can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")


WINDOW = 20
#: Entropies are compared in integers: c * log2(c) times this, rounded, so that sums are exact in any order.
UNIT = 1 << 40
#: Characters of candidates; the place of a character is where its count is kept.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Matches, or spans, that are folded in one piece, so that a text with very many costs no more each.
PIECE = 256


@dataclass(frozen=True)
class EntropyClass:
    """Candidates that match ``pattern`` whole and each of ``needs`` are flagged if a window of WINDOW characters reaches ``bits``."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c), in units, at which a window still reaches ``bits``."""
        return math.floor((math.log2(WINDOW) - self.bits) * WINDOW * UNIT)


def summand(count: int) -> int:
    return round(count * math.log2(count) * UNIT) if count > 1 else 0


#: The first class that a candidate matches decides, and every candidate has one. Random strings of few kinds of characters have
#: lower entropies than such of many, and so have other thresholds; names made of parts, and words, reach more bits by chance.
CLASSES: tuple[EntropyClass, ...] = (
    EntropyClass("hex", r"^[0-9a-fA-F]+$", (), 3.0),
    EntropyClass("mixed", r"^[A-Za-z0-9+/_=-]+$", (r"[0-9]", r"[a-z]", r"[A-Z]"), 3.7),
    EntropyClass("lower_digits", r"^[a-z0-9+=]+$", (r"[0-9]",), 3.5),
    EntropyClass("upper_digits", r"^[A-Z0-9+=]+$", (r"[0-9]",), 3.4),
    EntropyClass("letters", r"^[A-Za-z+=]+$", (r"[a-z]", r"[A-Z]"), 3.9),
    EntropyClass("other", r"^[A-Za-z0-9+/_=-]+$", (), 4.0),
)
#: Suppress entropy candidates that are known not to be secrets: documentation keys, UUID-like identifiers, paths.
ALLOW: tuple[str, ...] = (
    r"EXAMPLE",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]+$",
    r"^(?:[A-Za-z_]+[/_-])+[A-Za-z_]*$",
    r"0123456789abcdef|abcdefghijklmnop|ABCDEFGHIJKLMNOP",
)


def _pieces(items: Column) -> Column:
    """``items`` (not empty) in arrays of PIECE: an array that grows by one item is copied, so only short ones may grow."""
    places = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))
    return let(items, lambda all_: F.transform(places, lambda i: F.slice(all_, i * PIECE + 1, F.lit(PIECE))))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, found) of every match; empty where there is none (one scan, no split).

    Lengths are summed by pieces of the matches first, and then inside each piece from where it starts.
    """
    form = "struct<start:bigint,end:bigint,kind:string,found:string>"
    zero, none = F.lit(0).cast("bigint"), F.array().cast(f"array<{form}>")
    both = lambda x: F.length(x["gap"]) + F.length(x["found"])

    def inside(piece: Column, ahead: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["found"])
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
            return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

        return F.aggregate(piece, F.struct(ahead.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def summed(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda at, x: at + both(x)))
        grow = lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        ahead = F.aggregate(totals, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all")), grow, lambda acc: acc["all"])
        return F.flatten(F.zip_with(pieces, ahead, inside))

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
        return let(_pieces(F.arrays_zip(gaps.alias("gap"), found.alias("found"))), summed)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def least_sum(candidate: Column, window: int) -> Column:
    """Smallest sum of c * log2(c), in units, over the character counts c of any ``window`` neighbouring characters; null if there are fewer.

    The window slides one character at a time. Counts are kept for all characters of ALPHABET, five bits each; per step one grows and one
    shrinks, and the sum changes by what these two contribute.
    """
    if window >= 32:
        raise ValueError("a count takes five bits, so a window has at most 31 characters")
    per = 12
    words = -(-len(ALPHABET) // per)
    # What the sum gains when a count grows from c to c + 1.
    gain = F.array(*[F.lit(summand(c + 1) - summand(c)).cast("bigint") for c in range(window + 1)])
    ones = F.array(*[F.lit(1 << (5 * i)).cast("bigint") for i in range(per)])
    zero = F.struct(F.array(*[F.lit(0).cast("bigint")] * words).alias("counts"), F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("low"))
    count = lambda counts, c: F.call_function("div", F.get(counts, c["word"]), c["one"]).bitwiseAND(F.lit(31)).cast("int")
    moved = lambda counts, c, by: F.transform(counts, lambda v, i: F.when(i == c["word"], v + by * c["one"]).otherwise(v))

    def step(acc: Column, x: Column) -> Column:
        def entered(a: Column) -> Column:
            s = a["s"] + F.get(gain, count(a["counts"], x["new"]))
            n = F.least(acc["n"] + 1, F.lit(window))
            return F.struct(
                moved(a["counts"], x["new"], 1).alias("counts"), s.alias("s"), n.alias("n"),
                F.when(n >= window, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"),
            )

        left = F.when(
            x["old"].isNotNull(),
            F.struct(moved(acc["counts"], x["old"], -1).alias("counts"), (acc["s"] - F.get(gain, count(acc["counts"], x["old"]) - 1)).alias("s")),
        ).otherwise(F.struct(acc["counts"].alias("counts"), acc["s"].alias("s")))
        return let(left, entered)

    def slid(places: Column) -> Column:
        old = F.concat(F.array_repeat(F.lit(None).cast("struct<word:int,one:bigint>"), window), places)
        both = F.arrays_zip(places.alias("new"), F.slice(old, F.lit(1), F.size(places)).alias("old"))
        return F.aggregate(both, zero, step, lambda acc: acc["low"])

    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    places = F.transform(numbered, lambda i: F.struct((F.floor(i / per)).cast("int").alias("word"), F.get(ones, F.pmod(i, F.lit(per))).alias("one")))
    return let(places, slid)


def peak_entropy(candidate: Column, window: int) -> Column:
    """Largest Shannon entropy in bits of any ``window`` neighbouring characters; null if there are fewer."""
    return F.lit(math.log2(window)) - least_sum(candidate, window) / float(window * UNIT)


def entropy_spans(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of kind ``entropy``: candidates with a window above their class's threshold and not allowed."""

    def hot(x: Column) -> Column:
        s, most, allowed = x["found"], F.lit(None).cast("bigint"), F.lit(False)
        for c in reversed(classes):
            fits = s.rlike(c.pattern)
            for need in c.needs:
                fits = fits & s.rlike(need)
            most = F.when(fits, F.lit(c.most)).otherwise(most)
        for p in allow:
            allowed = allowed | s.rlike(p)
        return ~allowed & F.coalesce(least_sum(s, WINDOW) <= most, F.lit(False))

    return F.filter(_matches(text, CANDIDATE, "entropy"), hot)


def _rank(x: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(x["kind"] == k, F.lit(i)).otherwise(out)
    return out


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, text: str = "text", to: str = "secrets", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """``docs`` and a struct ``to``: ``base`` and ``spans``, arrays of (start, rank, end, kind), ascending.

    ``base`` has the three pattern kinds, ``spans`` also the entropy windows; base spans always stay. A null text
    counts as empty and has no spans. Rows stand alone, so repeats and ties give equal results; an empty table gives an empty
    result, and a text may be of any length. An existing column ``to`` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    group2 = lambda s: F.length(F.regexp_extract(s, ASSIGN, 2))
    assign = F.filter(_matches(value, ASSIGN, "assign"), lambda x: group2(x["found"]) >= 6)
    raw = fresh(docs, "__raw")
    found = docs.withColumn(
        raw,
        F.struct(
            F.concat(assign, _matches(value, ACCESS, "access"), _matches(value, HEX, "hex")).alias("base"),
            entropy_spans(value, classes).alias("more"),
        ),
    )
    base, more = F.col(raw)["base"], F.col(raw)["more"]
    return found.withColumn(to, F.struct(_ordered(base).alias("base"), _ordered(F.concat(base, more)).alias("spans"))).drop(raw)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with every stretch covered by spans (sorted by start) replaced by one ``mark``; overlapping spans merge.

    What stands before a span is cut out of the stretch that its piece of spans covers, not out of the whole text.
    """
    end = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda at, x: F.greatest(at, x["end"]))

    def stretches(p: Column, ahead: Column) -> Column:
        covered = F.substring(text, (ahead + 1).cast("int"), F.greatest(end(p) - ahead, F.lit(0)).cast("int"))

        def cut(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                gap = F.substring(part, (acc["at"] - ahead + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
                joined = (acc["at"] > 0) & (x["start"] <= acc["at"])
                piece = F.when(joined, F.lit("")).otherwise(F.concat(gap, F.lit(mark)))
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.array_append(acc["out"], piece).alias("out"))

            zero = F.struct(ahead.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(p, zero, step, lambda acc: F.array_join(acc["out"], ""))

        return let(covered, cut)

    def whole(pieces: Column) -> Column:
        numbers = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        grow = lambda acc, p: F.struct(F.greatest(acc["at"], end(p)).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        return let(
            F.aggregate(pieces, numbers, grow),
            lambda ahead: F.concat(
                F.array_join(F.zip_with(pieces, ahead["all"], stretches), ""),
                F.substring(text, (ahead["at"] + 1).cast("int"), F.length(text)),
            ),
        )

    return F.when(F.size(spans) > 0, let(_pieces(spans), whole)).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with secrets replaced in ``text`` and ``n_chars`` counted again.

    No document is dropped. Null texts stay null; ``n_chars`` is only touched where it exists and the text changed.
    """
    to, clean = fresh(docs, "__secrets"), fresh(docs, "__clean")
    found = scan(docs, to=to)
    hit = F.size(F.col(to)["spans"]) > 0
    # The redacted text is a column of its own first: in one projection, names inside lambdas would mean the new text.
    cleaned = found.withColumn(clean, redact(F.col("text"), F.col(to)["spans"]))
    out = []
    for c, kind in docs.dtypes:
        col = F.col(f"`{c}`")
        if c == "text":
            col = F.col(clean).alias(c)
        elif c == "n_chars":
            col = F.when(hit, F.length(F.col(clean)).cast(kind)).otherwise(col).alias(c)
        out.append(col)
    return cleaned.select(*out)
