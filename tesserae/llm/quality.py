"""Quality rules: a rule bitmask ledger with versioned policies and ablations.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are bit masks over it, so a new policy version or an ablation never reads a text again. The whole
path is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import WORD, fresh, let

SYMBOLS = "#*$%&|<>"
#: Up to so many repeated windows are looked up by scanning; beyond it the windows are sorted with their positions.
SCAN_LIMIT = 24


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the measurement struct to a boolean column; ``bit`` is its place in the ledger and never changes."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


#: The production rules. Bits 0 and 1 are the base rules.
RULES: tuple[Rule, ...] = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols_per_word", lambda m: 10 * m["n_symbols"] > 2 * m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule(4, "word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule(5, "shouting", lambda m: 2 * m["n_upper"] > m["word_chars"]),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "prod-1": tuple(r.name for r in RULES),
}


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in policies[policy])


def _covered(starts: Column) -> Column:
    """Positions that lie in a window of three starting at one of the ascending ``starts``."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice; windows are compared by 64-bit hashes."""
    n = F.size(words)

    def from_hashes(h: Column) -> Column:
        again = let(
            F.array_sort(h),
            lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))),
        )

        def starts(d: Column) -> Column:
            at = F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i))
            return F.filter(at, lambda i: i.isNotNull())

        def starts_sorted() -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            kept = let(
                pairs,
                lambda s: F.filter(
                    s,
                    lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
                ),
            )
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        return let(
            again,
            lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long"))
            .when(F.size(d) <= SCAN_LIMIT, _covered(starts(d)))
            .otherwise(_covered(starts_sorted())),
        )

    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))


def one_of(characters: str) -> str:
    """A pattern for any one of ``characters``."""
    return f"[{re.escape(characters)}]"


def measurements(text: Column, repeats: bool = True) -> Column:
    """One struct of counts over the whole text; a null text counts as empty. Without ``repeats``, n_repeat_words is null.

    ``n_lines`` counts lines with a word, ``n_upper`` the upper-case letters (characters that lower-casing changes
    are counted through ASCII and Latin-1 capitals).
    """
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
        upper, symbols, blanks = (F.regexp_count(t, F.lit(c)) for c in ("[A-ZÀ-ÖØ-Þ]", one_of(SYMBOLS), r"[\x20\x09-\x0D]"))
        def counted(ls: Column, n_words: Column, n_repeat_words: Column) -> Column:
            return F.struct(
                n_words.cast("long").alias("n_words"),
                (F.length(t) - blanks).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                n_repeat_words.alias("n_repeat_words"),
                upper.cast("long").alias("n_upper"),
            )

        if not repeats:
            return let(lines, lambda ls: counted(ls, F.regexp_count(t, F.lit(WORD)), F.lit(None).cast("long")))
        return let(lines, lambda ls: let(words, lambda ws: counted(ls, F.size(ws), _repeat_words(ws))))

    return let(text, of)


def ledger_bits(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Bit r is set if rule r fails by the measurements ``m``."""
    return sum((F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(0) for r in rules), F.lit(0)).cast("long")


def with_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", to: str = "ledger") -> DataFrame:
    """``docs`` and a struct column ``to`` of ``m`` (measurements) and ``bits`` (bit r is set if rule r fails).

    Null and empty texts measure as zero words. Repeated rows are measured alike; an empty table gives an
    empty ledger. Texts are measured whole. An existing column ``to`` is replaced.
    """
    raw = fresh(docs, "__m")
    measured = docs.withColumn(raw, measurements(F.col(text)))
    return measured.withColumn(to, F.struct(F.col(raw).alias("m"), ledger_bits(F.col(raw), rules).alias("bits"))).drop(raw)


def passes(bits: Column, policy: str, rules: tuple[Rule, ...] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> Column:
    """True where none of the policy's rules failed."""
    return bits.bitwiseAND(F.lit(mask_of(policy, rules, policies))) == 0


def ablation(ledger: DataFrame, bits: Column, policy: str, rules: tuple[Rule, ...] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it fails (kept if it were dropped), documents the policy keeps.

    The ledger is first reduced to one row per bit pattern, at most 2 ** rules of them; everything after that is bitwise work on
    a table of bounded size. Every rule has a row, also if the ledger is empty.
    """
    mask = mask_of(policy, rules, policies)
    patterns = ledger.select(bits.bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if mask >> r.bit & 1]
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    sums = patterns.agg(
        total(F.col("bits") == 0).alias("kept"),
        *[total(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"hit_{r.bit}") for r in chosen],
        *[total(F.col("bits") == (1 << r.bit)).alias(f"only_{r.bit}") for r in chosen],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"hit_{r.bit}").alias("failed"), F.col(f"only_{r.bit}").alias("failed_alone")) for r in chosen]))
    return sums.select(rows.alias("r"), "kept").select("r.rule", "r.failed", "r.failed_alone", "kept")


def keep_good(docs: DataFrame, policy: str = "prod-1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    to = fresh(docs, "__ledger")
    return with_ledger(docs, to=to).filter(passes(F.col(to)["bits"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
