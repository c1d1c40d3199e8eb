"""Random tokens of any alphabet are redacted; words and names are not."""

from tesserae.llm import secrets

TOKENS = ["q8zr2lmx9vtb4ksw7ync1pdfh3gj6w5e0au8xokt", "MFRGG43FMZQXEYLUNBUXG2LTONUW4ZDPOJ2GK3TU", "qZrLmXvTbKsWyNcPdFhGjHwEuAoIkTaQxVzRbYnM", "q8Zr2LmX9vTb4KsW7yNc1PdF", "0a1b2c3d4e5f60718293a4b5"]
WORDS = ["unanticonstitutionnellementsupplementaire", "getElementsByClassNameAndTagName", "blog-2024-05-how-to-share-files-with-friends", "https-www-example-com/2024/05/my-first-post", "1234567890123456789012", "SOME_CONSTANT_NAME_2024_VERSION"]


def test_every_candidate_has_a_class(spark):
    df = spark.createDataFrame([(i, f"see {w} here", 0) for i, w in enumerate(TOKENS + WORDS)], "doc_id int, text string, n_chars int")
    got = {r.doc_id: r for r in secrets.redact_secrets(df).collect()}
    for i, w in enumerate(TOKENS + WORDS):
        want = "see <SECRET> here" if i < len(TOKENS) else f"see {w} here"
        assert got[i].text == want and (i >= len(TOKENS) or got[i].n_chars == len(want)), w


def test_many_matches_and_long_texts(spark, monkeypatch):
    """Positions and redaction across pieces, against plain Python."""
    import re

    from pyspark.sql import functions as F

    monkeypatch.setattr(secrets, "PIECE", 4)
    key = "0123abcd" * 3
    text = " é ".join(f"{key}{i:02x} password=abc{i}defgh" for i in range(23)) + "x" * 5000
    df = spark.createDataFrame([(1, text, 0), (2, f"{key}", 0), (3, f"a{key}", 0)], "doc_id int, text string, n_chars int")
    row = secrets.scan(df).filter("doc_id = 1").select(F.col("secrets")["base"].alias("b")).first()
    want = sorted([(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]{24,}", text)] + [(m.start(), m.end(), "assign") for m in re.finditer(r"password=[a-z0-9]+", text)])
    assert sorted((x.start, x.end, x.kind) for x in row.b) == want
    out = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert out[1] == re.sub(r"[0-9a-f]{24,}|password=[a-z0-9]+", "<SECRET>", text) and out[2] == "<SECRET>"


def test_counts_are_exact_at_the_threshold(spark):
    """Sums of c * log2(c) are integers, so a window exactly at a class's bits is flagged, whatever came before it."""
    import collections
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randrange(20, 90))) for _ in range(200)] + ["a" * 200, "ab" * 30]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", secrets.least_sum(F.col("w"), 20).alias("s")).collect():
        assert r.s == min(sum(secrets.summand(c) for c in collections.Counter(r.w[i : i + 20]).values()) for i in range(len(r.w) - 19))
