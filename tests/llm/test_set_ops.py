"""Near-duplicates, top-k, the classifier, the pipeline, and the SQL of the corpus queries."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from tesserae.llm import classifier, minhash, queries, textops, topk

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORDS.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def classes(rows, least=0.8):
    """doc index -> smallest doc_id of its class, by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            whole = sum(bags[i].values()) + sum(bags[j].values()) - both
            if both and both / whole >= least:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_word_hashes_tell_words_apart():
    texts = ["a b  a\tab", None, "", "é\n😀 a", " x", "b" * 600_000 + " a"]
    got = list(textops.per_row(pa.array(texts)))
    seen = {}
    for t, h in zip(texts, got, strict=True):
        words = WORDS.findall(t or "")
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("shared", [0.5, 0.8, 0.95])
def test_signatures_are_unbiased(shared):
    rng = np.random.default_rng(int(shared * 100))
    n, agree, registers = 300, [], 192
    for _ in range(25):
        e = rng.integers(0, 2**63, n).astype(np.uint64)
        a = rng.integers(1, 9, n)
        b = np.where(rng.random(n) < shared, a, rng.integers(1, 9, n))
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (minhash.bag_minhash(e, a, registers) == minhash.bag_minhash(e, b, registers)).mean()
        agree.append(same - want)
    assert abs(np.mean(agree)) < 4 * np.sqrt(0.25 / registers / 25)


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(6)]
    rows = []
    for b in base:
        for k in range(25):
            w = list(b)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"x{int(rng.integers(0, 10**6))}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(900, "same text here"), (5, "same text here"), (901, "same text here now"), (902, None), (903, ""), (904, " \n"), (None, "no id"), (None, "no id"), (906, "la " * 4000), (907, "la " * 4100), (908, "la " * 2000)]
    rows += [(910, rows[0][1]), (910, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "label", "bucket", "digest", "kept", "__digest")})
    got = minhash.near_duplicates(df).collect()
    want = collections.Counter((d, c) for (d, _), c in zip(rows, classes(rows), strict=True))
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    texts = collections.Counter(r.text for r in kept.collect())
    assert sum(r.kept for r in got) == sum(texts.values()) and texts["same text here"] == 1 and texts[None] == 1
    assert minhash.near_duplicates(df.filter("false")).count() == 0 and minhash.keep_one_of_each(df.filter("false")).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    labels = collections.defaultdict(set)
    for r in minhash.components(links).collect():
        labels[r.label].add(r.node)
    assert sorted(map(sorted, labels.values())) == [list(range(n + 1)), [1000, 1001, 1002]]


def brute_top(rows, k, every):
    v = [(i, None if e is None or any(x is None or not np.isfinite(x) for x in e) else np.floor(64 * np.array(e, dtype=float))) for i, e in rows]
    v = [(i, x) for i, x in v if x is not None]
    width = max(len(x) for _, x in v)
    m = np.array([np.pad(x, (0, width - len(x))) for _, x in v])
    out = []
    for a, (q, _) in enumerate(v):
        if q is not None and q % every == 0:
            s = m @ m[a]
            order = sorted((b for b in range(len(v)) if b != a), key=lambda b: (-s[b], v[b][0] is None, v[b][0] or 0))[:k]
            out += [(q, r + 1, v[b][0], int(s[b])) for r, b in enumerate(order)]
    return sorted(out, key=str)


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(400)] + [(500 + i, [0.1] * 8) for i in range(60)]
    rows += [(600, None), (601, [float("nan")] * 8), (602, [None] * 8), (603, [float("inf")] * 8), (604, []), (605, [0.5, 0.5]), (None, [0.3] * 8), (0, [0.2] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rid", "block", "score")})
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, topk.top_k(df, 5, 20).collect()), key=str)
    want = brute_top(stored, 5, 20)
    assert sorted((q, r, s) for q, r, _, s in got) == sorted((q, r, s) for q, r, _, s in want)
    assert got == want
    few = df.filter("vec_id in (20, 21)")
    assert [tuple(r)[:3] for r in topk.top_k(few, 5, 20).collect()] == [(20, 1, 21)]
    assert topk.top_k(df.filter("false"), 5, 20).count() == 0


def test_best_breaks_ties_by_id():
    got = topk.best(np.array([[5, 7, 7, 1, 7]]), np.array([9, 8, 3, 1, 4]), 2)
    assert [x.tolist() for x in got] == [[[7, 7]], [[3, 4]]]
    few = topk.best(np.array([[5, topk._NONE]]), np.array([9, 8]), 3)
    assert few[0].tolist() == [[5, topk._NONE, topk._NONE]] and few[1][0, 0] == 9


def test_top_k_of_wide_components_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 6) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(200)]
    rows += [(200, [4.0e7, *[0.0] * 5]), (201, [4.0e7, 1 / 64, *[0.0] * 4]), (220, [1e-3, 1.0, *[0.0] * 4]), (221, [3.0e7] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    values = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows}
    want = []
    for q in (i for i in values if i % 20 == 0):
        s = sorted(((-sum(a * b for a, b in zip(values[q], values[v], strict=True)), v) for v in values if v != q))[:7]
        want += [(q, r + 1, v, -x) for r, (x, v) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(df, 7, 20).collect())) == sorted(want)
    beyond = spark.createDataFrame([(0, [1e12]), (1, [1e12]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.top_k(beyond, 2, 20).collect()


def test_bounds_leave_out_annuli(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 8)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 4, (12, 8))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    report = {}
    got = sorted(map(tuple, topk.top_k(df, 5, 20, report=report).collect()))
    assert sorted(got, key=str) == brute_top([(r.vec_id, r.embedding) for r in df.collect()], 5, 20)
    assert report["needed"] < 0.5 * report["pairs"]


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rated = classifier.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).cache()
    train, test = rated.filter("doc_id % 5 <> 0"), rated.filter("doc_id % 5 = 0")
    model = classifier.fit(docs, train)
    assert (np.diff(model.thresholds) > 0).all()
    out = classifier.score(docs.join(test, "doc_id"), model).select("grade", "rating.*").toPandas()
    kept = out.tail_probability >= classifier.TAIL
    assert kept[out.grade == 2].mean() > 0.95 and kept[out.grade == 0].mean() < 0.2 and kept[out.grade == 1].mean() < 0.2
    assert out.expected_grade[out.grade == 2].mean() > out.expected_grade[out.grade == 1].mean()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good words " * 50_000), (3, "again"), (None, "x")], "doc_id long, text string").withColumns({"grade": F.lit(1), "rating_": F.lit(2)})
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, classifier.graded(labels).collect())) == [(1, 2), (3, 1)]
    for ratings in (labels, labels.filter("false")):
        model = classifier.fit(docs, classifier.graded(ratings))
        got = classifier.score(docs, model).collect()
        assert [r.rating.tail_probability for r in got if not (r.text or "").strip()] == [0.0, 0.0]
        assert len(got) == 5 and all(0 <= r.rating.tail_probability <= r.rating.at_least <= 1 for r in got)
    assert classifier.score(docs.filter("false"), model).count() == 0 and classifier.select_good(docs, model, 0.0).columns == docs.columns


def test_rows_without_words_are_never_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = classifier.fit(docs, classifier.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "### --- !!!")], "doc_id long, text string").withColumn("rating", F.lit("old"))
    assert classifier.select_good(blank, model).count() == 0
    assert {r.rating.tail_probability for r in classifier.score(blank, model).collect()} == {0.0}


def test_repeated_ids_give_one_row_each(spark):
    docs = spark.createDataFrame([(i % 7, f"word{i % 5} more words") for i in range(400)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(7)], "doc_id long, grade int")
    seen = []
    make = classifier._Rows
    classifier._Rows = lambda feats, chars: seen.append(len(feats)) or make(feats, chars)
    try:
        classifier.fit(docs, ratings)
    finally:
        classifier._Rows = make
    assert max(seen) == 7


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(8)
    n, bits = 40, 4
    size = (1 << bits) + 2 * classifier.SHAPES + 5
    feats = [(np.sort(rng.choice(size - 5, 6, replace=False)), rng.normal(0, 1, 6)) for _ in range(n)]
    rows = classifier._Rows(feats, rng.random((n, 5)))
    grades, weight = rng.integers(0, 4, n), rng.random(n)
    at = np.concatenate([rng.normal(0, 0.5, size), [-0.7], rng.normal(0, 0.3, 2)])
    loss = lambda x: classifier.loss_and_gradient(rows, grades, weight, x[:size], x[size], x[size + 1 :], 0.01)
    g = loss(at)[1]
    for i in [*rng.choice(size, 15, replace=False), size, size + 1, size + 2]:
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert abs((loss(at + step)[0] - loss(at - step)[0]) / 2e-5 - g[i]) < 1e-5


def test_fit_finds_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 600)
    grades = np.digitize(x + rng.logistic(0, 0.3, 600), [-0.7, 0.7])
    rows = classifier._Rows([(np.zeros(0, dtype=np.int64), np.zeros(0))] * 600, np.stack([x, *np.zeros((4, 600))], 1))
    model = classifier.fit_ordinal(rows, grades, 3, bits=4)
    p = model.tails(rows.dot(model.weights))
    assert np.corrcoef(p.sum(1), x)[0, 1] > 0.95 and model.thresholds[0] < 0 < model.thresholds[1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert oracle.rows_of(queries.queries()[name](spark, SF)) == oracle.rows_of_sql(oracle.connect(SF), queries.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline
    from tesserae.llm import mixing, quality, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, ("quality", "near_dedup", "secrets", "mix", "bpe"), strict=True):
        assert name == want
        before = at.collect()
        out = stage(spark, at, SF)
        rows = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "quality":
            kept = {r.doc_id for r in quality.with_ledger(at).filter("ledger.bits = 0").collect()}
            assert {r.doc_id for r in rows} == kept
        elif name == "near_dedup":
            pairs = [(r.doc_id, r.text) for r in before]
            assert {r.doc_id for r in rows} == set(classes(pairs))
        elif name == "secrets":
            assert len(rows) == len(before)
            assert secrets.scan(out).filter("size(secrets.base) > 0").count() == 0
        elif name == "mix":
            times = {r.doc_id: r.times for r in mixing.mix(at).collect()}
            assert collections.Counter(r.doc_id for r in rows) == {d: t for d, t in times.items() if t}
        else:
            assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in before)
        at = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.run(spark, SF).count() == at.count()
