"""Random forests on binned features, from counts of the distinct rows of bins.

A tree sees of a row nothing but its bins and its label, so rows are counted once per distinct row of bins, and a bootstrap
draws from the counts: a sum of n Poisson numbers of mean 1 is one of mean n. Each tree then grows in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import formula
from tesserae.runtime import ship

#: Bins of a feature; counts that one task grows a tree from (the driver holds them and the trees).
BINS, CELLS = 32, 1 << 16


def _quantiles(parts: int) -> Column:
    return F.array(*[F.lit(k / parts) for k in range(1, parts)])


def cuts(train: DataFrame, features: list[str]) -> list[list[float]]:
    """Where to cut each feature (x <= cut goes left), BINS - 1 times at most: between all values if there are so few, else at quantiles.

    A value that fills several quantiles is cut off on both sides, and the other cuts are quantiles of the rest. All rows count.
    """
    row = train.agg(*[f(c) for c in features for f in (lambda c: F.percentile_approx(c, _quantiles(BINS), 10_000), F.min, F.max)]).first()
    out = []
    for i, c in enumerate(features):
        at, least, most = row[3 * i : 3 * i + 3]
        if at is None:
            raise ValueError("a forest needs complete rows")
        if len(set(at)) < BINS - 1:
            few = sorted(r[0] for r in train.select(c).distinct().limit(BINS + 1).collect())
            if len(few) <= BINS:
                middle = [(a, b, a / 2 + b / 2) for a, b in zip(few[:-1], few[1:], strict=True)]
                out.append([m if a <= m < b else a for a, b, m in middle])
                continue
            heavy = [v for v in set(at) if at.count(v) > 1]
            sides = {s for v in heavy for s in (v, math.nextafter(v, -math.inf))}
            rest = train.filter(~F.col(c).isin(heavy)).agg(F.percentile_approx(c, _quantiles(BINS - len(sides)), 10_000)).first()[0]
            at = sides | set(rest)
        out.append(sorted(v for v in set(at) if least <= v < most))
    return out


def bin_of(x: Column, at: list[float], low: int = 0) -> Column:
    """How many of the ascending cuts lie below ``x``, by halving."""
    if not at:
        return F.lit(low).cast("int")
    half = len(at) // 2
    return F.when(x <= at[half], bin_of(x, at[:half], low)).otherwise(bin_of(x, at[half + 1 :], low + half + 1))


@dataclass(frozen=True)
class Tree:
    """Nodes from the root on: ``feature`` (-1: a leaf), last bin that goes left, left child (the right one follows it), P(label = 1)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    p: np.ndarray


def _gini(counts: np.ndarray) -> np.ndarray:
    return 1.0 - ((counts / np.maximum(counts.sum(1), 1.0)[:, None]) ** 2).sum(1)


def _best(node: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, stats: np.ndarray, gini: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, gain, bin): the best cut of one feature for every node of the given rows; the lowest one on ties."""
    kinds = stats.shape[1]
    key, place = np.unique(node * 256 + bins, return_inverse=True)
    h = np.bincount(place * kinds + label, weights=weight, minlength=len(key) * kinds).reshape(-1, kinds)
    of = key // 256
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(of)]))
    run = h.cumsum(0)
    lo = run - (run - h)[starts][group]
    hi = stats[of] - lo
    n_lo, n_hi = lo.sum(1), hi.sum(1)
    gain = gini[of] - (n_lo * _gini(lo) + n_hi * _gini(hi)) / (n_lo + n_hi)
    gain[n_hi == 0] = -np.inf
    top = np.maximum.reduceat(gain, starts)
    hits = np.flatnonzero(gain == top[group])
    first = hits[np.unique(group[hits], return_index=True)[1]]
    return of[first], gain[first], key[first] % 256


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, depth: int, subset: int, rng: np.random.Generator) -> Tree:
    """A tree by gini gain, level by level; every split looks at ``subset`` features. Leaf pairs of one prediction become one, as in Spark."""
    kinds, some = max(2, int(label.max()) + 1), weight > 0
    bins, label, weight = bins[some].astype(np.int64), label[some], weight[some].astype(float)
    node, n, base, levels = np.zeros(len(label), np.int64), 1, 0, []
    for level in range(depth + 1):
        stats = np.bincount(node * kinds + label, weights=weight, minlength=n * kinds).reshape(n, kinds)
        gini, feature, cut, gain = _gini(stats), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        if level < depth and len(label):
            looked = np.ones((n, bins.shape[1]), bool)
            if subset < bins.shape[1]:
                looked[:] = False
                np.put_along_axis(looked, rng.random(looked.shape).argsort(1)[:, :subset], True, 1)
            looked[gini <= 0] = False
            for f in range(bins.shape[1]):
                on = looked[node, f]
                if on.any():
                    at, g, b = _best(node[on], bins[on, f], label[on], weight[on], stats, gini)
                    better = g > gain[at]
                    feature[at[better]], cut[at[better]], gain[at[better]] = f, b[better], g[better]
        split = feature >= 0
        child = np.cumsum(split) * 2 - 2
        levels.append((feature, cut, np.where(split, base + n + child, 0), stats))
        base, n = base + n, 2 * int(split.sum())
        if n == 0:
            break
        inside = split[node]
        node, bins, label, weight = node[inside], bins[inside], label[inside], weight[inside]
        node = child[node] + (bins[np.arange(len(node)), feature[node]] > cut[node])
    feature, cut, left, stats = (np.concatenate(x) for x in zip(*levels, strict=True))
    return _pruned(feature, cut, left, stats, [len(x[0]) for x in levels])


def _pruned(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, stats: np.ndarray, sizes: list[int]) -> Tree:
    says, edges = stats.argmax(1), np.cumsum([0, *sizes])
    for lo, hi in zip(edges[-2::-1], edges[:0:-1], strict=True):
        at = lo + np.flatnonzero(feature[lo:hi] >= 0)
        a, b = left[at], left[at] + 1
        feature[at[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]] = -1
    alive = np.zeros(len(feature), bool)
    alive[0] = True
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = lo + np.flatnonzero(alive[lo:hi] & (feature[lo:hi] >= 0))
        alive[left[at]] = alive[left[at] + 1] = True
    left = np.where(feature >= 0, (np.cumsum(alive) - 1)[left], 0)
    p = stats[:, 1] / np.maximum(stats.sum(1), 1.0)
    return Tree(feature[alive].astype(np.int32), cut[alive].astype(np.int32), left[alive].astype(np.int32), p[alive])


def probability(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """Mean over the trees of P(label = 1) for rows of bins."""
    sizes = [len(t.p) for t in trees]
    roots = np.cumsum([0, *sizes[:-1]])
    feature, cut, p = (np.concatenate([getattr(t, k) for t in trees]) for k in ("feature", "cut", "p"))
    left = np.concatenate([t.left + r for t, r in zip(trees, roots, strict=True)])
    out = np.empty(len(bins))
    for lo in range(0, len(bins), 4096):
        part = bins[lo : lo + 4096]
        at, live = np.tile(roots, len(part)), np.arange(len(part) * len(roots))
        while len(live := live[feature[at[live]] >= 0]):
            a = at[live]
            at[live] = left[a] + (part[live // len(roots), feature[a]] > cut[a])
        out[lo : lo + 4096] = p[at].reshape(len(part), -1).mean(1)
    return out


@dataclass(frozen=True)
class Forest:
    design: formula.Design
    cuts: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]

    def score(self, df: DataFrame, to: str = "p") -> DataFrame:
        """P(label = 1) as ``to``; null where a feature is missing. A task walks the trees once per distinct row of bins."""
        cuts, trees = [np.array(c) for c in self.cuts], list(self.trees)

        @F.pandas_udf("double")
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            known: dict[bytes, float] = {}
            for x in batches:
                values = x.to_numpy(float)
                whole = ~np.isnan(values).any(1)
                binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values[whole].T, strict=True)], 1).astype(np.uint8)
                rows, place = np.unique(binned, axis=0, return_inverse=True)
                keys = [r.tobytes() for r in rows]
                fresh = [i for i, k in enumerate(keys) if k not in known]
                known.update(zip([keys[i] for i in fresh], probability(trees, rows[fresh]).tolist(), strict=True))
                out = np.full(len(values), np.nan)
                out[whole] = np.array([known[k] for k in keys])[place.ravel()] if keys else []
                yield pd.Series(out).where(whole)

        ship(df.sparkSession)
        features = [c.cast("double").alias(f"x{i}") for i, (n, c) in enumerate(self.design.columns) if n != "Intercept"]
        return df.withColumn(to, apply(F.struct(*features)))


def fit(train: DataFrame, features: list[str], trees: int, depth: int, seed: int) -> tuple[list[list[float]], list[Tree]] | None:
    """Cuts and trees from all rows of (label, features), complete ones; None if there are more than CELLS distinct rows of bins.

    Draws depend on the seed, the tree and the counts, not on how rows are dealt.
    """
    spark = train.sparkSession
    at = cuts(train, features)
    names = [f"b{i}" for i in range(len(features))]
    binned = train.select(F.col("label"), *[bin_of(F.col(c), a).alias(b) for c, a, b in zip(features, at, names, strict=True)])
    cells = binned.groupBy("label", *names).agg(F.count(F.lit(1)).alias("n")).limit(CELLS + 1).toArrow().to_pandas()
    if len(cells) > CELLS:
        return None
    cells = cells.sort_values([*names, "label"])
    labels = cells["label"].to_numpy()
    if (labels != np.floor(labels)).any() or labels.min() < 0:
        raise ValueError("labels must be whole numbers from 0")
    bins, label, n = cells[names].to_numpy(np.uint8), labels.astype(np.int64), cells["n"].to_numpy()
    subset = math.ceil(math.sqrt(len(features)))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed % (1 << 63), k])
                t = grow(bins, label, rng.poisson(n), depth, subset, rng)
                yield pa.RecordBatch.from_pylist([{"id": k} | {c: getattr(t, c).tobytes() for c in ("feature", "cut", "left", "p")}])

    ship(spark)
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    rows = spark.range(0, trees, 1, tasks).mapInArrow(grown, "id long, feature binary, cut binary, left binary, p binary").collect()
    whole = [Tree(*[np.frombuffer(r[c], np.int32) for c in ("feature", "cut", "left")], np.frombuffer(r["p"])) for r in sorted(rows, key=lambda r: r["id"])]
    return at, whole
