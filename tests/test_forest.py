"""Forests from counts: against plain recursion, against Spark's trainer, and whatever way the rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import forest, models


def rows_of(spark, n=3000):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    z = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double")
    noise = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 100.0
    return spark.range(n).select("id", x.alias("x"), z.alias("z"), F.when((x > 0.4) & (z < 3), noise < 0.9).otherwise(noise < 0.2).cast("int").alias("v"))


def scores(model, df):
    return {r.id: r.p for r in model.score(df).select("id", "p").collect()}


def test_a_forest_does_not_depend_on_how_rows_are_dealt(spark):
    df = rows_of(spark)
    one, many = (scores(models.fit_forest("v ~ x + z", df.repartition(n), trees=5, depth=8), df) for n in (1, 7))
    assert one == many


def test_levels_are_no_jobs(spark):
    df = rows_of(spark, 500)
    spark.sparkContext.setJobGroup("forest", "")
    models.fit_forest("v ~ x + z", df, trees=4, depth=12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 12


def test_agrees_with_sparks_trainer(spark, monkeypatch):
    df = rows_of(spark).cache()
    ours = scores(models.fit_forest("v ~ x + z", df, trees=20, depth=4), df)
    monkeypatch.setattr(forest, "CELLS", 10)
    theirs = models.fit_forest("v ~ x + z", df, trees=20, depth=4)
    assert isinstance(theirs, models.SparkForest)
    assert np.mean([abs(ours[k] - p) for k, p in scores(theirs, df).items()]) < 0.03


def test_missing_features_have_no_probability(spark):
    model = models.fit_forest("v ~ x + z", rows_of(spark, 200), trees=3, depth=3)
    odd = spark.createDataFrame([(0, None, 1.0), (1, float("nan"), 1.0), (2, 0.5, 1.0), (3, float("inf"), -1e300)], "id long, x double, z double")
    assert [p is None for _, p in sorted(scores(model, odd).items())] == [True, True, False, False]
    with pytest.raises(ValueError):
        models.fit_forest("v ~ x + z", rows_of(spark, 0))


def plain(bins, label, weight, depth):
    """The same tree by recursion: (feature, cut, left, right) or P(label = 1)."""
    n = np.array([weight[label == k].sum() for k in (0, 1)], float)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    best = (0.0, None, None)
    for f in range(bins.shape[1]):
        for c in np.unique(bins[:, f])[:-1]:
            lo = np.array([weight[(label == k) & (bins[:, f] <= c)].sum() for k in (0, 1)], float)
            gain = gini(n) - (lo.sum() * gini(lo) + (n - lo).sum() * gini(n - lo)) / n.sum()
            if gain > best[0] + 1e-12:
                best = (gain, f, c)
    leaf = (int(n.argmax()), n[1] / n.sum())
    if depth == 0 or best[1] is None:
        return leaf
    _, f, c = best
    go = bins[:, f] <= c
    a, b = (plain(bins[s], label[s], weight[s], depth - 1) for s in (go, ~go))
    return leaf if len(a) == len(b) == 2 and a[0] == b[0] else (f, c, a, b)


def test_growing_is_the_plain_recursion():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        bins, label, weight = rng.integers(0, 6, (60, 3)).astype(np.uint8), rng.integers(0, 2, 60), rng.integers(0, 40, 60) ** 3
        tree = forest.grow(bins, label, weight, 5, 3, rng)
        some = weight > 0
        want = plain(bins[some], label[some], weight[some], 5)

        def p(row, node=want):
            while len(node) == 4:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node[1]

        assert np.allclose(forest.probability([tree], bins), [p(r) for r in bins])


def test_cuts_part_rare_and_heavy_values(spark):
    df = spark.range(1000).selectExpr("double(id < 3) + double(id < 2) as few", "double(greatest(id, 900)) as low", "double(least(id, 100)) as high", "double(id) as wide")
    few, low, high, wide = forest.cuts(df, df.columns)
    assert few == [0.5, 1.5] and len(wide) == 31
    assert low[0] == 900.0 and len(low) > 25 and 99.0 < high[-1] < 100.0 and len(high) > 25
    for at, x in ((low, 900.0), (high, 100.0)):
        assert df.select(forest.bin_of(F.lit(x), at)).first()[0] == np.searchsorted(at, x)
    placed = df.select("wide", forest.bin_of(F.col("wide"), wide).alias("b")).toPandas()
    assert (placed.b == np.searchsorted(wide, placed.wide)).all() and placed.groupby("b").size().between(30, 33).all()
