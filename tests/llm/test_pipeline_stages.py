"""The pipeline's stages against plain Python, and on nulls, blanks, long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesserae.llm import _common
from tesserae.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars int"
KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


TEXTS = [prose(i, 60) for i in range(8)]
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (4, prose(99, 60_000), "en", "a", 0), (5, TEXTS[0], "en", "a", 0), (5, TEXTS[0], "en", "a", 0), (6, TEXTS[0], "de", "b", 0),
    (None, TEXTS[1], "en", None, 0), (8, f"{TEXTS[2]} token = {KEY} end", "en", "b", 0), *[(10 + i, t, "en", "c", 0) for i, t in enumerate(TEXTS[3:])],
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("ledger", "__m", "kept", "class_id", "digest", "__digest", "secrets", "__raw", "__clean", "times", "size", "k_0", "src", "key", "bucket", "ids", "n_tokens")
    return spark.createDataFrame(ROWS, FORM).withColumns({c: F.lit(9) for c in clash})


def test_stages_on_odd_rows(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    assert sorted((str(r.doc_id) for r in good.collect())) == sorted(["4", "5", "5", "6", "None", "8", *[str(10 + i) for i in range(5)]])
    kept = stages["near_dedup"](spark, good, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["4", "5", "None", "8", *[str(10 + i) for i in range(5)]])
    clean = stages["secrets"](spark, kept, SF)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    row = clean.filter("doc_id = 8").first()
    assert row.text == f"{TEXTS[2]} <SECRET> end" and row.n_chars == len(row.text)
    mixed = stages["mix"](spark, clean, SF)
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in clean.collect()} and max(times.values()) <= 3
    out = stages["bpe"](spark, mixed, SF)
    assert out.count() == mixed.count() and out.columns == ["doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for stage in stages.values():
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_late_stages_on_nulls(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert stages["near_dedup"](spark, docs, SF).count() == 3 + 9
    clean = stages["secrets"](spark, docs, SF)
    assert [r.text for r in clean.filter("doc_id <= 3").orderBy("doc_id").collect()] == [None, "", " \n\t"]
    mixed = collections.Counter(r.doc_id for r in stages["mix"](spark, docs, SF).collect())
    assert mixed[1] == mixed[3] and mixed[2] <= mixed[None] and max(mixed.values()) <= 3
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256) for r in stages["bpe"](spark, docs, SF).filter("doc_id <= 2").collect()} == {(0, empty)}


def test_quality_and_bpe_by_plain_python(spark):
    from tokenizers import Tokenizer

    words = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def passes(text):
        w = words.findall(text or "")
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words.search(x)]
        chars, upper = sum(map(len, w)), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" for c in text or "")
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        return not (
            len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * symbols > 2 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
            or chars < 2 * len(w) or chars > 15 * len(w) or 2 * upper > chars
        )

    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in docs.collect() if passes(r.text))
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    text = {r.doc_id: r.text for r in good.collect()}
    for r in stages["bpe"](spark, good, SF).collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tables_of_earlier_stages_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "tesserae").iterdir()}
    assert left == {"stage-mix"}
