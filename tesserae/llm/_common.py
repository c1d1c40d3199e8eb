"""Shared plumbing: durable intermediate tables, global numbering, let-bindings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast (rows here are narrow, so this is a few MB).
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = os.path.join(tempfile.gettempdir(), f"tesserae-{os.getuid()}-{os.getpid()}")
    return f"file://{made}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; column pruning and statistics
    still work on the result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1][path] = out
    return out


#: Tables written inside the open ``scratch`` blocks, by path.
_open: list[dict[str, DataFrame]] = []


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table that ``materialize`` returned as ``df`` inside an open ``scratch`` block; nothing may read it any more."""
    for made in _open:
        for path in [p for p, d in made.items() if d is df]:
            remove(df.sparkSession, path)
            del made[path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside the block go when it ends, but for those passed to the function it yields.

    What is kept belongs to the block around it, if there is one; else it stays until the shared folder is cleared, since
    the caller's result still reads it.
    """
    made: dict[str, DataFrame] = {}
    kept: list[DataFrame] = []
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        for path, df in made.items():
            if not any(df is k for k in kept):
                remove(spark, path)
            elif _open:
                _open[-1][path] = df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A lambda variable is a plain slot, so the optimiser cannot copy the expression into an inner loop.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front of it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_or_plain(small: DataFrame) -> DataFrame:
    """Hint a broadcast if ``small`` (already materialised) is counted to be small; else leave it to a shuffle join."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def global_row_number(df: DataFrame, order: list[str], name: str, label: str) -> tuple[DataFrame, int]:
    """Number all rows from 0 without gaps in the order of ``order``; returns the rows and their count.

    Rows are range-partitioned and sorted once, stamped and written; only one count per partition is
    gathered to turn the stamps into row numbers. Equal rows are told apart by a salt, so a value that holds
    a third of all rows still spreads over many partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt, stamp = fresh(df, "__salt"), fresh(df, "__stamp")
    salted = df.withColumn(salt, F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(parts, *order, salt).sortWithinPartitions(*order, salt)
    stamped = materialize(ranged.drop(salt).withColumn(stamp, F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned(F.col(stamp), 33)
    per_part = stamped.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the single window below never sees more rows than there are shuffle partitions.
    before = per_part.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    total = stamped.count()
    numbered = stamped.withColumn("__part", part).join(F.broadcast(before), "__part")
    inside = F.col(stamp).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("__before") + inside).drop("__part", "__before", stamp), total
