"""Exact top-k inner products over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the index is the table of vectors in the order of that
key, cut into blocks: annuli around a pivot. Queries are cut into groups the same way. A group first searches the annuli that
promise most, which gives every query a score to beat. Annuli that some query of the group still needs are sent to it, once each,
and expanded in falling order of their bound: each query drops those that the triangle inequality rules out by its own
k-th score so far. With d >= |d(q, p) - d(x, p)| a vector of norm n scores at most (|q|^2 + n^2 - d^2) / 2, and at most |q| n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._common import materialize, scratch, small_or_plain
from tesserae.runtime import ship

SCALE = 64.0
PIVOTS = 32
#: Pivots are chosen from at most so many rows; every row is indexed.
PIVOT_SAMPLE = 4096
BLOCK = 2048
#: Queries of a group: they meet the index together.
GROUP = 4096
#: Annuli that a group searches first.
SEEDS = 4
#: Products of components up to this size, and their sums, are exact in doubles.
NARROW = float(1 << 20)
_NO_ID = (1 << 63) - 1
#: Marks of scores: none, below and beyond 64 bits.
_NONE, _LOW, _HIGH = -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1
_BLOCKS = "pivot int, near double, far double, norm double, m int, rids binary, ids binary, vectors binary"


def quantised(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, values): floor(64 * x) as integers, padded with zeros to ``dims``; unusable rows hold zeros.

    Integers are held as doubles, exactly. A vector that is null, or holds a null, NaN or infinity (also once scaled), is unusable.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    usable = np.asarray(column.is_valid())
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    out = np.zeros((n, dims))
    rows = np.repeat(np.arange(n), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values)
    bad = ~np.isfinite(scaled)
    usable = usable & ~np.isin(np.arange(n), rows[bad])
    scaled[bad] = 0
    out[rows, places] = scaled
    return usable, out


def choose_pivots(vectors: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Farthest-first seeds among the sample, then a few rounds of means, rounded to integers."""
    rng = np.random.default_rng(seed)
    chosen = [vectors[rng.integers(len(vectors))]]
    gap = ((vectors - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)) and gap.max() > 0:
        chosen.append(vectors[int(gap.argmax())])
        gap = np.minimum(gap, ((vectors - chosen[-1]) ** 2).sum(1))
    centers = np.array(chosen)
    for _ in range(5):
        near = distances(vectors, centers).argmin(1)
        centers = np.array([np.rint(vectors[near == j].mean(0)) if (near == j).any() else c for j, c in enumerate(centers)])
    return centers


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _exact(q: np.ndarray, x: np.ndarray) -> int:
    total = sum(int(a) * int(b) for a, b in zip(q.tolist(), x.tolist(), strict=True) if a and b)
    return total if _LOW < total < _HIGH else _LOW if total < 0 else _HIGH


def scores(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Integer inner products of the rows of ``q`` and ``x``.

    Where components or dimensions are too large for exact doubles, products that their error bound shows to be below a
    row's k best stay _NONE and the rest is computed in unbounded integers; beyond 64 bits a score is _LOW or _HIGH.
    """
    largest = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1])
    if largest < 2.0**52:
        return np.rint(q @ x.T).astype(np.int64)
    small_q, small_x = np.abs(q).max(1, initial=0.0) <= NARROW, np.abs(x).max(1, initial=0.0) <= NARROW
    if NARROW * NARROW * q.shape[1] >= 2.0**52:
        small_q[:] = False
    out = np.full((len(q), len(x)), _NONE, dtype=np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ x.T
        error = np.where(small_q[:, None] & small_x[None, :], 0.0, (np.abs(q) @ np.abs(x).T) * ((q.shape[1] + 2) * 2.0**-51))
        low, high = np.nan_to_num(near - error, nan=-np.inf), np.nan_to_num(near + error, nan=np.inf)
    for i in range(len(q)):
        floor = -np.inf if len(x) <= k else np.partition(low[i], len(x) - k)[len(x) - k]
        for j in np.flatnonzero(high[i] >= floor).tolist():
            out[i, j] = int(near[i, j]) if error[i, j] == 0.0 else _exact(q[i], x[j])
    return out


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of each row, by score down and then id up; ids are one row for all, or one per row.

    Rows with fewer than k end in _NONE.
    """
    n = s.shape[1]
    ids = np.broadcast_to(ids, s.shape)
    if n > k:
        least = np.partition(s, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(s >= least[:, None])
    else:
        row, col = np.nonzero(np.ones(s.shape, dtype=bool))
    order = np.lexsort((ids[row, col], ~s[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row]
    row, col, nth = row[nth < k], col[nth < k], nth[nth < k]
    out, at = np.full((len(s), k), _NONE, dtype=np.int64), np.full((len(s), k), _NO_ID, dtype=np.int64)
    out[row, nth], at[row, nth] = s[row, col], ids[row, col]
    return out, at


def _pack(size: int, by_pivot: bool):
    """Rows in the order of (pivot, distance) -> blocks of at most ``size`` rows, of one pivot if so wanted.

    Components take four bytes each, or eight in a block where some need them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, dist, norm = (np.asarray(b.column(i)) for i in (0, 1, 2))
            rids, ids = np.asarray(b.column(3)), np.asarray(b.column(4))
            cuts = [0]
            for i in [*((np.flatnonzero(np.diff(pivot)) + 1).tolist() if by_pivot else []), len(pivot)]:
                cuts += [*range(cuts[-1] + size, i, size), i]
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    vectors = np.frombuffer(b"".join(x.as_py() for x in b.column(5)[lo:hi]), dtype="<f8")
                    if np.abs(vectors).max(initial=0.0) < 2.0**31:
                        vectors = vectors.astype("<i4")
                    out.append((int(pivot[lo]), float(dist[lo:hi].min()), float(dist[lo:hi].max()), float(norm[lo:hi].max()), hi - lo, rids[lo:hi].tobytes(), ids[lo:hi].tobytes(), vectors.tobytes()))
            if out:
                types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return run


def _matrix(raw: bytes, m: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * m * dims else "<f8").reshape(m, dims).astype(np.float64)


def _ceiling(q_norm, norm, apart):
    """The most that a query and a vector of at most ``norm`` can score if they are at least ``apart``; rounding allowed for."""
    return np.minimum((q_norm**2 + norm**2 - apart**2) / 2, q_norm * norm) + (q_norm**2 + norm**2) * 1e-9 + 1.0


class _Group:
    """Queries of one group, their k best so far, and the annuli they could skip."""

    def __init__(self, row: dict, centers: np.ndarray, k: int) -> None:
        self.rids, self.ids = np.frombuffer(row["rids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.q = _matrix(row["vectors"], len(self.rids), centers.shape[1])
        self.norms, self.to_pivots = np.sqrt((self.q**2).sum(1)), distances(self.q, centers)
        self.k, self.scores = k, np.full((len(self.rids), k), _NONE, dtype=np.int64)
        self.found = np.full((len(self.rids), k), _NO_ID, dtype=np.int64)
        beats = row.get("beats")
        self.beats = np.frombuffer(beats, "<i8") if beats else np.full(len(self.rids), _NONE, dtype=np.int64)

    def expand(self, row: dict) -> None:
        """Search one annulus with the queries whose bound does not rule it out."""
        d = self.to_pivots[:, row["pivot"]]
        apart = np.maximum(0.0, np.maximum(d - row["far"], row["near"] - d))
        kth = np.maximum(self.scores[:, -1], self.beats).astype(np.float64)
        live = np.flatnonzero(_ceiling(self.norms, row["norm"], apart) >= kth)
        if not len(live):
            return
        rids, ids = np.frombuffer(row["rids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        s = scores(self.q[live], _matrix(row["vectors"], len(rids), self.q.shape[1]), self.k + 1)
        s[self.rids[live][:, None] == rids[None, :]] = _NONE
        s, v = best(s, ids, self.k)
        self.scores[live], self.found[live] = best(np.concatenate([self.scores[live], s], 1), np.concatenate([self.found[live], v], 1), self.k)


def _search(k: int, centers: np.ndarray, thresholds: bool):
    """(task, kind, qblock, pivot, near, far, norm, rids, ids, vectors, beats): a group (kind 0), then its annuli in falling order.

    Gives the k best of each query among these, or with ``thresholds`` per group the k-th scores of its queries.
    """

    def result(g: _Group, qblock: int) -> pa.RecordBatch:
        if thresholds:
            arrays = [pa.array([qblock]), pa.array([int(g.scores[:, -1].min())]), pa.array([g.scores[:, -1].astype("<i8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["qblock", "beat", "beats"])
        row, col = np.nonzero(g.scores != _NONE)
        columns = (g.rids[row], g.ids[row], g.scores[row, col], g.found[row, col])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "query_id", "score", "vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group, qblock = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                if row["kind"] == 0:
                    if group is not None:
                        yield result(group, qblock)
                    task, group, qblock = row["task"], _Group(row, centers, k), row["qblock"]
                elif row["task"] == task:
                    group.expand(row)
        if group is not None:
            yield result(group, qblock)

    return run


_FOUND = "rid long, query_id long, score long, vec_id long"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row whose vec_id is divisible by ``every``, over all other rows.

    ``vectors`` has vec_id and embedding. Scores are inner products of floor(64 * x), exact for all finite components; ties fall to the
    smaller vec_id, null ones last. A score of the result that leaves 64 bits is an error. Null vectors, or ones with null
    or non-finite components, take no part. Shorter vectors are padded with zeros. Rows that repeat a vec_id are separate rows,
    and only a query's own row is left out. An empty table gives an empty result. ``report`` takes the number of pairs of
    group and annulus, and of those that the bounds leave.
    """
    ship(vectors.sparkSession)
    with scratch(vectors.sparkSession) as keep:
        return _top_k(vectors, k, every, pivots, report, keep)


def _top_k(vectors: DataFrame, k: int, every: int, pivots: int, report: dict | None, keep) -> DataFrame:
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dims = int(source.agg(F.max(F.size("embedding"))).first()[0] or 1)
    dims = max(1, dims)
    sample = source.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).select("embedding").toArrow()
    usable, values = quantised(sample.column(0), dims)
    values = values[usable]
    centers = choose_pivots(values if len(values) else np.zeros((1, dims)), pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = quantised(b.column(1), dims)
            x = x[ok]
            d = distances(x, centers)
            near = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            ids = b.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array(np.sqrt((x**2).sum(1))),
                    ids.fill_null(_NO_ID), pa.array([p.tobytes() for p in x.astype("<f8")], pa.binary()), ids.is_valid(),
                ],
                names=["pivot", "dist", "norm", "id", "vector", "has_id"],
            )

    keyed = source.mapInArrow(key, "pivot int, dist double, norm double, id long, vector binary, has_id boolean")
    keyed = materialize(keyed.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asks = keyed.filter(F.col("has_id") & (F.col("id") % every == 0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(rows: DataFrame, size: int, n: int, by_pivot: bool, label: str) -> DataFrame:
        ordered = rows.select("pivot", "dist", "norm", "rid", "id", "vector").repartitionByRange(n, "pivot", "dist", "rid")
        packed = ordered.sortWithinPartitions("pivot", "dist", "rid").select("pivot", "dist", "norm", "rid", "id", "vector").mapInArrow(_pack(size, by_pivot), _BLOCKS)
        return materialize(packed.withColumn("block", F.monotonically_increasing_id()), label)

    index = blocks(keyed, BLOCK, parts, True, "index")
    n_queries = asks.count()
    groups = blocks(asks, GROUP, max(1, -(-n_queries // GROUP)), False, "queries").withColumnRenamed("block", "qblock")
    annuli = index.select("block", "pivot", "near", "far", "norm")
    # How far a group is from every pivot: least, most and on average.
    n_pivots = len(centers)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = distances(_matrix(r["vectors"], r["m"], dims), centers)
                arrays = [np.full(n_pivots, r["qblock"]), np.arange(n_pivots, dtype=np.int32), d.min(0), d.max(0), d.mean(0), np.full(n_pivots, r["norm"])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["qblock", "pivot", "least", "most", "mean", "qnorm"])

    spans = groups.select("qblock", "m", "norm", "vectors").mapInArrow(reach, "qblock long, pivot int, least double, most double, mean double, qnorm double")
    spans = materialize(spans, "spans")
    facing = spans.join(annuli, "pivot")

    def ceiling(apart):
        squares = F.col("qnorm") ** 2 + F.col("norm") ** 2
        return F.least((squares - apart**2) / 2, F.col("qnorm") * F.col("norm")) + squares * 1e-9 + 1.0

    apart = F.greatest(F.lit(0.0), F.col("least") - F.col("far"), F.col("near") - F.col("most"))
    likely = ceiling(F.greatest(F.lit(0.0), F.col("mean") - F.col("far"), F.col("near") - F.col("mean")))

    def search(pairs: DataFrame, heads: DataFrame, slices: int, thresholds: bool, schema: str) -> DataFrame:
        """Each group with its annuli (qblock, block, bound), in ``slices`` tasks; the vectors of an annulus are sent once per group."""
        nth = lambda i: F.xxhash64(F.col("qblock"), i)
        task_rows = ["task", "kind", "bound", "qblock", "pivot", "near", "far", "norm", "rids", "ids", "vectors", "beats"]
        asked = heads.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), nth)))
        asked = asked.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(*task_rows)
        spread = index.join(pairs, "block").withColumn("task", nth(F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")))
        spread = spread.withColumns({"kind": F.lit(1), "beats": F.lit(None).cast("binary")}).select(*task_rows)
        dealt = asked.unionByName(spread).repartition(parts, "task").sortWithinPartitions("task", "kind", F.desc("bound"))
        return dealt.drop("bound").mapInArrow(_search(k, centers, thresholds), schema)

    first = Window.partitionBy("qblock").orderBy(F.desc("bound"), "block")
    seeds = facing.select("qblock", "block", likely.alias("bound")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SEEDS).drop("r")
    beats = search(seeds, groups.withColumn("beats", F.lit(None).cast("binary")), 1, True, "qblock long, beat long, beats binary")
    beats = materialize(beats, "beats")
    limits = facing.join(small_or_plain(beats.select("qblock", "beat")), "qblock").withColumn("bound", ceiling(apart))
    needed = materialize(limits.filter(F.col("bound") >= F.col("beat")).select("qblock", "block", "bound"), "pairs")
    if report is not None:
        report.update(pairs=facing.count(), needed=needed.count())
    slices = max(1, min(2 * parts // max(1, -(-n_queries // GROUP)), parts))
    found = search(needed, groups.join(beats.select("qblock", "beats"), "qblock"), slices, False, _FOUND)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    found = keep(materialize(found, "found"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    beyond = F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id").cast("string"), F.lit(" leaves 64 bits"))).cast("long")
    whole = F.when(F.col("score").isin(_LOW, _HIGH), beyond).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") == _NO_ID, None).otherwise(F.col("vec_id")).alias("vec_id"), whole.alias("score"))
