"""Mixing sources to target weights by weighted sampling with exponential keys (Efraimidis and Spirakis).

Each source gets a token budget. Whole epochs of a source come first; the rest of its budget is a prefix of
its documents in the order of keys -ln(u) / weight, where u is a hash of the document and so the same in every
run. The prefix sum is distributed: keys fall into about sqrt(n) buckets per source, bucket totals locate the
budget, and only the bucket in which it ends is summed row by row. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import quality
from tesserae.llm._common import fresh, global_row_number, materialize, small_or_plain

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


ODD = "#*$%&|<>0123456789!@^~_=+{}[]"
#: Rules of the quality ledger that a weight counts: those that one look at the characters and lines decides.
WEIGHED = tuple(r for r in quality.RULES if r.name != "repeated_windows")


def quality_weight(text: Column, m: Column) -> Column:
    """In (0, 1]: the share of characters that are not symbols, digits or bars, 0.05 at least, halved by every rule of WEIGHED that fails.

    ``m`` are the ledger's measurements of the text, without repeats.
    """
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(quality.one_of(ODD)))
    clean = F.greatest(F.lit(0.05), F.coalesce(F.when(n > 0, 1.0 - odd / n), F.lit(0.05)))
    return clean / F.pow(F.lit(2.0), F.bit_count(quality.ledger_bits(m, WEIGHED)))


def row_hash(seed: int, *parts: Column) -> Column:
    """52 bits of the MD5 of the seed and the non-null parts; any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def exponential_key(row_hash: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of 52 bits."""
    return -F.log((row_hash + 0.5) / float(1 << 52)) / weight


def source_targets(sources: DataFrame, total: float, cap: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, ..., source_size, weight) with ``target``: ``total`` shared by weight, no share above cap * source_size.

    What a capped source cannot take is shared again by weight. Each round sums two figures over the table of
    sources; a round without a new cap ends it, so there are at most as many rounds as sources and in practice a few.
    """
    limit = F.col("source_size") * float(cap)
    scale = None
    while True:
        capped = F.lit(False) if scale is None else (F.lit(scale) * F.col("weight") >= limit)
        row = sources.agg(
            F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))
        ).first()
        held, open_weight = float(row[0] or 0.0), float(row[1] or 0.0)
        if open_weight <= 0:
            break
        now = max(0.0, (total - held) / open_weight)
        if scale is not None and now <= scale * (1 + 1e-12):
            break
        scale = now
    share = F.least(limit, F.lit(scale or 0.0) * F.col("weight")) if scale is not None else limit
    return sources.withColumn("target", share)


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Per row: the columns ``keep``, size, source_size, target, times and taken (= size * times).

    Size is the number of words (null text: 0). Sources are ordered by code point with null last and weigh
    ``weights`` in turn; together they share all words. ``times`` counts epochs plus at most one fractional pick, so it
    never passes 3. The key depends on doc_id and text, and its weight on the text's quality. Ties in it fall to the columns
    ``keep``; rows equal in all of them are interchangeable. Texts of any length count whole.
    An empty table gives an empty result; a source without words has target 0 and takes nothing.
    """
    mixed = _mixed(docs, keep, weights, seed)
    return mixed.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def _mixed(docs: DataFrame, keep: Sequence[str], weights: Sequence[float], seed: int) -> DataFrame:
    """The columns ``keep`` as k_0, k_1, ..., and size, source_size, target, times."""
    text, source = F.col("text"), F.col("source")
    digest = row_hash(seed, F.col("doc_id"), text)
    m = fresh(docs, "__m")
    # The measurements are taken once; words are among them.
    measured = docs.withColumn(m, quality.measurements(text, repeats=False))
    rows = materialize(
        measured.select(
            *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)],
            source.isNull().alias("no_source"),
            F.coalesce(source, F.lit("")).alias("src"),
            F.col(m)["n_words"].alias("size"),
            exponential_key(digest, quality_weight(text, F.col(m))).alias("key"),
            digest.alias("digest"),
        ),
        "mix-rows",
    )
    by = ["no_source", "src"]
    per_source = rows.groupBy(*by).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("key") > 0, F.col("key"))).alias("mean_key")
    )
    numbered, _ = global_row_number(per_source, by, "place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight)
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    targets = source_targets(numbered, total)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(
        targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix-plan",
    )
    # 1 - exp(-key / mean) rises with the key and spreads it about evenly over sqrt(n) buckets.
    bucket = F.floor((1.0 - F.exp(-F.col("key") / F.col("mean_key"))) * F.ceil(F.sqrt("n")))
    keyed = rows.join(small_or_plain(plan), by).withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    sums = keyed.groupBy(*by, "bucket").agg(F.sum("size").alias("bucket_size"), F.first("rest").alias("rest"))
    upto = F.sum("bucket_size").over(Window.partitionBy(*by).orderBy("bucket"))
    prefix = sums.withColumn("before", upto - F.col("bucket_size")).filter((F.col("before") <= F.col("rest")))
    edge = materialize(
        prefix.groupBy(*by).agg(F.max("bucket").alias("edge"), F.max("before").alias("before")), "mix-edge"
    )
    placed = keyed.join(small_or_plain(edge), by, "left")
    at_edge = F.col("bucket") == F.col("edge")
    kinds = dict(rows.dtypes)
    plain = [f"k_{i}" for i in range(len(keep)) if not kinds[f"k_{i}"].startswith(("map", "array", "struct", "variant"))]
    other = [f"k_{i}" for i in range(len(keep)) if f"k_{i}" not in plain]
    keys = [*plain, *([F.xxhash64(F.to_json(F.struct(*other)))] if other else [])]
    order = Window.partitionBy(*by).orderBy("key", "digest", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The budget ends nearest to its mark if the document that crosses it goes in exactly when more than half of it fits.
    inside = F.col("before") + F.sum("size").over(order) - F.col("size") / 2.0
    last = placed.filter(at_edge).withColumn("picked", inside <= F.col("rest"))
    whole = placed.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("picked", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    picked = whole.unionByName(last)
    times = F.col("epochs") + F.when(F.col("picked") & (F.col("rest") > 0) & (F.col("size") > 0), 1).otherwise(0)
    return picked.select(*[f"k_{i}" for i in range(len(keep))], "size", "source_size", "target", times.alias("times"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows pass through the mix with all their columns, so nothing is matched afterwards. Rows that are equal in every column share their
    picks in any order; nulls, repeats, ties, empty and long texts are as in ``mix``, and an empty table gives an empty one.
    """
    mixed = _mixed(docs, docs.columns, weights, seed).filter("times > 0")
    copies = mixed.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(docs.columns)])
