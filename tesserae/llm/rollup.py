"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed changes, so a batch of inserts, deletes and revised
counts only adds its own aggregate. Each batch commits one small table under its id; a batch that is committed again
changes nothing. Reading sums the base and the batches after it; compaction makes a new base.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._common import remove, shared_dir
from tesserae.runtime import ship

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
CHANGES = "source string, lang string, tokenizer string, sign int, n_tokens long, n_chars long"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, versions: Mapping[str, str], pattern: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars: one row for every row of ``docs`` and every version (name -> vocabulary file).

    All versions count a text in one pass over the whole text. A null or empty text counts 0. Special tokens in a text are ordinary
    text. Rows stand alone, so repeats count again; an empty table gives an empty result. Other columns are not read.
    """
    ship(docs.sparkSession)
    names = list(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [_encoding(versions[v], pattern) for v in names]
        for b in batches:
            texts = [x or "" for x in b.column(3).to_pylist()]
            chars = pa.array(map(len, texts), pa.int64())
            for v, e in zip(names, encodings, strict=True):
                n = pa.array([len(e.encode_ordinary(t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v] * len(texts), pa.string()), n, chars], names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text")).mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("sign"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens", "n_chars")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts leave and the new ones enter; source, language or tokenizer may differ between them."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """A rollup in a folder that Spark can reach.

    Every write goes to a folder of its own, ``rows/<attempt>``. ``_done/<batch>`` is a small file that names the attempt which
    counts; it appears whole or not at all, and only once, so of several writers of one id exactly one counts and one that dies
    leaves nothing behind but its own folder. ``_base/<number>`` names the attempt that holds the totals of the ids it lists. The file system has
    to rename atomically without replacing (as HDFS does); on a local one a hard link does the same.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, name: str, content: dict) -> bool:
        """Make the file ``name`` appear with its content; False if it is there already."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = self._at(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(self._at(draft).toUri().getPath(), target.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        else:
            done = not self._fs.exists(target) and bool(self._fs.rename(self._at(draft), target))
        self._fs.delete(self._at(draft), False)
        return done

    def _base(self) -> tuple[int, dict]:
        numbers = sorted(map(int, self._names("_base")))
        return (numbers[-1], self._read(f"_base/{numbers[-1]}")) if numbers else (0, {"attempt": None, "ids": []})

    def _write(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{attempt}")
        return attempt

    def committed(self) -> list[str]:
        """Ids of whole batches. One name per batch, so the list stays short."""
        return sorted({*self._names("_done"), *self._base()[1]["ids"]})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed ``changes`` (see CHANGES) as ``batch``; False, and no change, if that id was committed before.

        The batch is reduced to one row per key before it is written. Null keys are keys of their own. An empty batch counts as
        committed.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id consists of letters, digits, - and _")
        if batch in self.committed():
            return False
        sign = F.col("sign").cast("long")
        deltas = changes.groupBy(*KEYS).agg(
            F.sum(sign).alias("n_docs"), F.sum(sign * F.col("n_tokens")).alias("n_tokens"), F.sum(sign * F.col("n_chars")).alias("n_chars")
        )
        attempt = self._write(deltas)
        if self._publish(f"_done/{batch}", {"attempt": attempt}):
            return True
        remove(self.spark, f"{self.path}/rows/{attempt}")
        return False

    def _open(self) -> tuple[int, list[str], list[str]]:
        """(number of the base, ids, attempts) that the totals consist of at this moment."""
        number, base = self._base()
        later = [b for b in self._names("_done") if b not in set(base["ids"])]
        attempts = [a for a in [base["attempt"]] if a] + [self._read(f"_done/{b}")["attempt"] for b in later]
        return number, [*base["ids"], *later], attempts

    def _sum(self, attempts: Sequence[str]) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], SCHEMA)
        paths = [f"{self.path}/rows/{a}" for a in attempts]
        summed = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
        return summed.filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """One row per key whose totals are not all zero."""
        return self._sum(self._open()[2])

    def compact(self) -> bool:
        """Fold all batches so far into one base, in one job; False if another compaction came first.

        Batches committed meanwhile are not in the base's list and so still count on their own. Folders that no reader needs any more are
        left to ``vacuum``.
        """
        number, ids, attempts = self._open()
        attempt = self._write(self._sum(attempts))
        if self._publish(f"_base/{number + 1}", {"attempt": attempt, "ids": ids}):
            return True
        remove(self.spark, f"{self.path}/rows/{attempt}")
        return False

    def vacuum(self) -> None:
        """Delete what the totals do not consist of. Only while no writer and no reader of older totals is at work."""
        needed = set(self._open()[2])
        for a in self._names("rows"):
            if a not in needed:
                remove(self.spark, f"{self.path}/rows/{a}")


def load(spark: SparkSession, counts: DataFrame, name: str, batches: Sequence[tuple[str, DataFrame]] = ()) -> Rollup:
    """A new rollup in the shared folder with ``counts`` inserted and then ``batches`` of changes committed."""
    out = Rollup(spark, f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}")
    out.commit("load", inserts(counts))
    for batch, changes in batches:
        out.commit(batch, changes)
    return out
