"""Token-count rollups against brute force, with writers that die or race."""

import base64
import collections

import pytest
import tiktoken
from pyspark.sql import functions as F

from tesserae.llm import queries, rollup

p = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "word " * 60_000, "en", "a"), (5, "one two three", "en", "b"),
    (5, "one two three", "en", "b"), (None, "no id here", "en", "b"), (8, "ünïcödé 😀 " * 60, "de", "c"),
]


def library(name):
    with open(p.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def counts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(9) for c in ("tokenizer", "n_tokens", "sign")})
    return rollup.count_tokens(docs, {"v1": p.path("byte_bpe_50k.tiktoken")}, p.PATTERN).cache()


def test_counts_by_brute_force(spark, counts):
    e = library("byte_bpe_50k")
    want = sorted([(i, s, lang, "v1", len(e.encode_ordinary(t or "")), len(t or "")) for i, t, lang, s in DOCS], key=str)
    assert rows(counts) == want
    assert rollup.count_tokens(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), {"v1": p.path("byte_bpe_50k.tiktoken")}, p.PATTERN).count() == 0


def test_batches_change_totals_once(spark, counts, tmp_path):
    store = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0 and store.commit("load", rollup.inserts(counts)) and not store.commit("load", rollup.inserts(counts))
    b = counts.filter("source = 'b'")
    store.commit("out", rollup.deletes(b))
    store.commit("moved", rollup.revisions(counts.filter("source = 'c'"), counts.filter("source = 'c'").withColumn("n_tokens", F.col("n_tokens") + 5)))
    e, want = library("byte_bpe_50k"), collections.defaultdict(lambda: [0, 0, 0])
    for _, t, lang, s in DOCS:
        if s != "b":
            for i, x in enumerate((1, len(e.encode_ordinary(t or "")) + 5 * (s == "c"), len(t or ""))):
                want[s, lang, "v1"][i] += x
    whole = sorted([(*k, *v) for k, v in want.items()], key=str)
    assert rows(store.totals()) == whole
    assert store.compact() and rows(store.totals()) == whole and not store.commit("out", rollup.deletes(b))
    assert store.commit("again", rollup.inserts(b)) and store.commit("empty", rollup.inserts(b.filter("false")))
    assert sum(r[3] for r in rows(store.totals())) == len(DOCS)
    store.vacuum()
    assert sum(r[3] for r in rows(store.totals())) == len(DOCS) and store.committed() == ["again", "empty", "load", "moved", "out"]


def test_writers_that_die_or_race(spark, counts, tmp_path, monkeypatch):
    store = rollup.Rollup(spark, f"file://{tmp_path}/r")
    store.commit("load", rollup.inserts(counts))
    whole = rows(store.totals())

    def die(*_):
        raise RuntimeError("lost")

    # Between the write and the mark: no trace in the totals, and the next try commits.
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(rollup.Rollup, "_publish", die)
        store.commit("out", rollup.deletes(counts))
    assert rows(store.totals()) == whole
    # A second writer that looked before the first one published: one of them counts, and its rows stay.
    other = rollup.Rollup(spark, store.path)
    write = other._write

    def late(df):
        attempt = write(df)
        assert store.commit("out", rollup.deletes(counts.filter("source = 'a'")))
        return attempt

    monkeypatch.setattr(other, "_write", late)
    assert not other.commit("out", rollup.deletes(counts))
    left = rows(store.totals())
    assert left == [r for r in whole if r[0] != "a"]
    # A batch that comes in while a compaction writes stays.
    write = store._write

    def slow(df):
        attempt = write(df)
        monkeypatch.undo()
        assert rollup.Rollup(spark, store.path).commit("more", rollup.inserts(counts.filter("source = 'a'")))
        return attempt

    monkeypatch.setattr(store, "_write", slow)
    assert store.compact()
    assert rows(store.totals()) == whole


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "source", "lang").collect()
    first = min(r.source for r in docs if r.source is not None)
    want = collections.defaultdict(lambda: [0, 0, 0])
    for name, extra in (("byte_bpe_50k", 2), ("byte_bpe_multi_50k", 0)):
        e = library(name)
        for r in docs:
            if r.source != first:
                for i, x in enumerate((1, len(e.encode_ordinary(r.text or "")) + extra, len(r.text or ""))):
                    want[r.source, r.lang, name][i] += x
    assert rows(queries.op3_token_counts(spark, SF)) == sorted([(*k, *v) for k, v in want.items()], key=str)
