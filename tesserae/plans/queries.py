"""Registered queries: one per operator, each over its whole tables, most with an equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import pixels
from tesserae.operators import aggregate, formula, grid, icar, models, project, sample, spatial, validate
from tesserae.plans import demo
from tesserae.plans.demo import META, STOCK_META, WIDTH, YEARS, table
from tesserae.sources import planning, raster, vector
from tesserae.sources.raster import KEY, RasterMeta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Shared parts of the SQL: the rasters of ``demo``.
FCC123 = """fcc123 AS (SELECT CAST(o_orderkey // 100 AS INT) y, CAST(o_orderkey % 100 AS INT) x,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END v FROM orders)"""
FCC = FCC123 + ", fcc AS (SELECT y, x, CASE WHEN v = 1 THEN 0 WHEN v >= 2 THEN 1 ELSE 255 END v FROM fcc123)"
RISK = """risk AS (SELECT CAST(event_id // 100 AS INT) y, CAST(event_id % 100 AS INT) x, CASE WHEN event_type = 'error' THEN 0
  ELSE CAST(trunc((greatest(least(value / 500.0::DOUBLE, 1.0::DOUBLE), 1e-6::DOUBLE) * 1e6::DOUBLE - 1.0::DOUBLE) * 65534.0::DOUBLE / 999999.0::DOUBLE + 1.0::DOUBLE) AS INT) END v FROM events)"""
EVENTS = "ev AS (SELECT CAST(event_id // 100 AS INT) y, CAST(event_id % 100 AS INT) x, value, user_id FROM events)"
STOCK = "stock AS (SELECT CAST(c_custkey // 20 AS INT) y, CAST(c_custkey % 20 AS INT) x, c_acctbal v FROM customer)"
RATE = "((cat - 1.0::DOUBLE) * 999999.0::DOUBLE / 65534.0::DOUBLE + 1.0::DOUBLE) * 1e-6::DOUBLE"
CUT = """h AS (SELECT CAST(g.v AS INT) v, coalesce(n, 0) n FROM range(1, 65536) g(v) LEFT JOIN (SELECT v, count(*) n FROM risk WHERE v > 0 GROUP BY v) USING (v)),
 w AS (SELECT v, n, sum(n) OVER (ORDER BY v DESC) cum, sum(n) OVER () nfp FROM h), q AS (SELECT *, round_even(0.3::DOUBLE * nfp, 0) k FROM w),
 top AS (SELECT max(v) v0 FROM q WHERE cum >= k),
 cut AS (SELECT CASE WHEN k >= nfp THEN 1 WHEN cum - k >= k - (cum - n) THEN v + 1 ELSE v END threshold,
  CASE WHEN k >= nfp THEN nfp WHEN cum - k >= k - (cum - n) THEN cum - n ELSE cum END ndp, nfp, k FROM q JOIN top ON v = v0)"""
FUTURE = f"{RISK}, {CUT}, future AS (SELECT y, x, CASE WHEN v = 0 THEN 255 WHEN v >= threshold THEN 0 ELSE 1 END v FROM risk CROSS JOIN cut)"
PAIRS = f"{FCC}, {FUTURE}, pairs AS (SELECT f.y, f.x, f.v obs, p.v pred FROM fcc f JOIN future p USING (y, x))"
RATES = f"""per AS (SELECT r.v cat, count(*) FILTER (f.v > 0) nfor, count(*) FILTER (f.v = 1) ndefor FROM fcc123 f JOIN risk r USING (y, x) WHERE r.v BETWEEN 1 AND 65535 GROUP BY 1),
 fac AS (SELECT sum(ndefor)::DOUBLE * 65534000000.0::DOUBLE / nullif(sum(nfor::HUGEINT * ((cat - 1)::HUGEINT * 999999 + 65534)), 0)::DOUBLE factor FROM per),
 rates AS (SELECT CAST(g.c AS INT) cat, coalesce(nfor, 0) nfor, coalesce(ndefor, 0) ndefor FROM range(1, 65536) g(c) LEFT JOIN per ON per.cat = g.c),
 full_ AS (SELECT cat, nfor, ndefor, CASE WHEN nfor > 0 THEN 1 - pow(1 - ndefor::DOUBLE / nfor, 0.1::DOUBLE) END rate_obs, {RATE} rate_mod, factor * ({RATE}) rate_abs, factor * ({RATE}) * 0.09::DOUBLE / 10.0::DOUBLE dens FROM rates CROSS JOIN fac)"""
MATRIX = "count(*) FILTER (pred = 0 AND obs = 0) n00, count(*) FILTER (pred = 0 AND obs = 1) n01, count(*) FILTER (pred = 1 AND obs = 0) n10, count(*) FILTER (pred = 1 AND obs = 1) n11"


_M = "2654435761 // 2"


def draw_sql(*keys: str, seed: int = 1234) -> str:
    """SQL of ``sample.draw_key``."""
    h = str(seed)
    for k in keys:
        h = f"(((({h} + {k} + 1) % 4294967296) * ({_M}) + ({h} >> 16)) % 4294967296)"
    return h


def uniform_sql(*keys: str, seed: int = 1234) -> str:
    """SQL of ``sample.uniform``."""
    return f"(({draw_sql(*keys, seed=seed)} * 1048576 + ({draw_sql(*keys, seed=seed + 7919)} >> 12)) / 4503599627370496.0::DOUBLE)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """All double columns rounded half up, since sums of doubles depend on their order."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes])


def nine(df: DataFrame, *names: str) -> DataFrame:
    """The named doubles to nine places by floor(x * 1e9 + 0.5): engines' own round() differ on values beside a tie, this one does not."""
    return df.select(*[(F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def nine_sql(*names: str) -> str:
    return ", ".join(f"floor({n} * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE {alias}" for n, alias in (x.split(":") for x in names))


RATE_COLUMNS = ("rate_obs", "rate_mod", "rate_abs", "defor_dens")
RATE_SQL = nine_sql("rate_obs:rate_obs", "rate_mod:rate_mod", "rate_abs:rate_abs", "dens:defor_dens")


# ---- grids and scans


@query(f"WITH {FCC} SELECT count(*) FILTER (v = 1) npix, round(count(*) FILTER (v = 1) * 0.09::DOUBLE, 6) area FROM fcc")
def countpix(spark, sf_dir):
    return rounded(aggregate.count_pixels(demo.fcc(spark, sf_dir), META))


@query(f"WITH {FCC} SELECT CAST(y // 10 AS BIGINT) tile, count(*) FILTER (v = 0) n_zero, count(*) FILTER (v = 1) n_one FROM fcc GROUP BY 1")
def block_counts(spark, sf_dir):
    return aggregate.counts_by_tile(demo.fcc(spark, sf_dir), F.floor(F.col("y") / 10))


@query(f"WITH {FCC}, s AS (SELECT max(y) + 1 h FROM fcc) SELECT CAST(t AS BIGINT) tile, 0 x0, CAST(t * 10 AS INT) y0, 100 nx, CAST(least(10, h - t * 10) AS INT) ny FROM s, range(0, CAST((h + 9) // 10 AS BIGINT)) g(t)")
def make_blocks(spark, sf_dir):
    return grid.blocks(spark, demo.meta_of(demo.fcc(spark, sf_dir)), 10)


@query(f"WITH {FCC}, s AS (SELECT max(y) + 1 h FROM fcc) SELECT CAST(t AS BIGINT) tile, CAST(t % 4 * 33 AS INT) x0, CAST(t // 4 * 33 AS INT) y0, CAST(least(33, 100 - t % 4 * 33) AS INT) nx, CAST(least(33, h - t // 4 * 33) AS INT) ny FROM s, range(0, CAST(4 * ((h + 32) // 33) AS BIGINT)) g(t)")
def make_squares(spark, sf_dir):
    return grid.squares(spark, demo.meta_of(demo.fcc(spark, sf_dir)), 33)


@query(f"WITH {FCC} SELECT y, x, (x + 0.5::DOUBLE) * 30.0 + 0.0 east, 0.0 - (y + 0.5::DOUBLE) * 30.0 north, CAST(floor((y + 0.5::DOUBLE) * 30.0 / 1000) * 3 + floor((x + 0.5::DOUBLE) * 30.0 / 1000) AS BIGINT) cell FROM fcc")
def pixel_center_cell(spark, sf_dir):
    east, north = pixels.pixel_center(META)
    return demo.fcc(spark, sf_dir).select(*KEY, east.alias("east"), north.alias("north"), pixels.spatial_cell(META, 1.0).alias("cell"))


_DATES = "t AS (SELECT y, x, CAST(v >= 1 AS INT) t1, CAST(v >= 2 AS INT) t2, CAST(v >= 3 AS INT) t3 FROM fcc123)"


def _dates(spark, sf_dir) -> DataFrame:
    return demo.fcc123(spark, sf_dir).select(*KEY, *[(F.col("v") >= i).cast("int").alias(f"t{i}") for i in (1, 2, 3)])


@query(f"WITH {FCC123}, {_DATES} SELECT y, x, CASE WHEN t1 = 1 THEN t2 ELSE 255 END fcc12, CASE WHEN t2 = 1 THEN t3 ELSE 255 END fcc23, CASE WHEN t1 = 1 THEN t3 ELSE 255 END fcc13 FROM t")
def fcc_algebra(spark, sf_dir):
    t = _dates(spark, sf_dir)
    change = lambda a, b: pixels.with_nodata(pixels.kept_forest(F.col(a), F.col(b)))
    return t.select(*KEY, change("t1", "t2").alias("fcc12"), change("t2", "t3").alias("fcc23"), change("t1", "t3").alias("fcc13"))


@query(f"WITH {FCC} SELECT y, x, CASE WHEN (y + x) % 3 <> 0 AND v IN (0, 1) THEN v ELSE 255 END v FROM fcc")
def fcc_mask(spark, sf_dir):
    area = F.when((F.col("y") + F.col("x")) % 3 != 0, 1).otherwise(0)
    return demo.fcc(spark, sf_dir).select(*KEY, pixels.inside_area(F.col("v"), area).alias("v"))


@query(f"WITH {FCC123}, {_DATES} SELECT y, x, t1 + t2 + t3 v FROM t")
def fcc123_code(spark, sf_dir):
    return _dates(spark, sf_dir).select(*KEY, pixels.period_code(F.col("t1"), F.col("t2"), F.col("t3")).alias("v"))


@query(f"WITH {RISK}, r AS (SELECT y, x, v cat FROM risk WHERE v > 0) SELECT y, x, cat, round({RATE}, 9) rate FROM r")
def rescale_prob(spark, sf_dir):
    r = demo.risk(spark, sf_dir).filter("v > 0")
    return rounded(r.select(*KEY, F.col("v").alias("cat"), pixels.class_rate(F.col("v")).alias("rate")), 9)


@query(f"WITH {EVENTS}, z AS (SELECT y, x, value / 100.0::DOUBLE - 1 z FROM ev) SELECT y, x, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 9) p FROM z")
def invlogit_score(spark, sf_dir):
    return rounded(demo.events_grid(spark, sf_dir).select(*KEY, pixels.invlogit(F.col("value") / 100.0 - 1.0).alias("p")), 9)


@query(f"WITH {EVENTS}, p AS (SELECT y, x, greatest(least(value / 500.0::DOUBLE, 0.999::DOUBLE), 0.001::DOUBLE) p FROM ev) SELECT y, x, round(ln(p / (1 - p)), 9) z FROM p")
def logit_score(spark, sf_dir):
    p = F.greatest(F.least(F.col("value") / 500.0, F.lit(0.999)), F.lit(0.001))
    return rounded(demo.events_grid(spark, sf_dir).select(*KEY, pixels.logit(p).alias("z")), 9)


@query(f"WITH {RISK} SELECT count(nullif(v, 0)) valid, count(*) - count(nullif(v, 0)) missing, min(nullif(v, 0)) lo, max(v) hi FROM risk")
def nodata_null(spark, sf_dir):
    r = demo.masked(demo.risk(spark, sf_dir), 0)
    return r.agg(F.count("v").alias("valid"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("lo"), F.max("v").alias("hi"))


_STACK = f"{FCC}, {RISK}, {STOCK}, st AS (SELECT f.y, f.x, f.v, r.v risk, s.v stock FROM fcc f LEFT JOIN risk r USING (y, x) LEFT JOIN stock s ON s.y = f.y // 2 AND s.x = f.x // 5)"


def _stack(spark, sf_dir) -> DataFrame:
    layers = {"risk": (demo.risk(spark, sf_dir), META), "stock": (demo.stock(spark, sf_dir), STOCK_META)}
    return grid.stack(demo.fcc(spark, sf_dir), META, layers)


@query(f"WITH {_STACK} SELECT y, x, v, risk, stock FROM st")
def stack_align_nearest(spark, sf_dir):
    return _stack(spark, sf_dir)


@query(f"WITH {_STACK} SELECT y, x, risk, stock FROM st WHERE v = 1 AND risk IS NOT NULL AND stock IS NOT NULL")
def complete_pixels(spark, sf_dir):
    return grid.complete(_stack(spark, sf_dir), "v", ["v", "risk", "stock"]).select(*KEY, "risk", "stock")


@query(f"WITH {FCC123}, a AS (SELECT y, x, v FROM fcc123 WHERE y < 40), b AS (SELECT y, x, CASE WHEN v = 0 THEN NULL ELSE v + 10 END v FROM fcc123 WHERE y >= 30) SELECT y, x, coalesce(b.v, a.v) v FROM a FULL JOIN b USING (y, x)")
def mosaic_union(spark, sf_dir):
    r = demo.fcc123(spark, sf_dir)
    later = r.filter("y >= 30").select(*KEY, F.when(F.col("v") != 0, F.col("v") + 10).alias("v"))
    return grid.mosaic([r.filter("y < 40"), later])


@query(f"WITH {FCC} SELECT CAST(y // 4 AS INT) y, CAST(x // 4 AS INT) x, v FROM fcc WHERE y % 4 = 0 AND x % 4 = 0")
def overview_nearest(spark, sf_dir):
    return grid.overview_nearest(demo.fcc(spark, sf_dir), 4)


@query(f"WITH {EVENTS} SELECT CAST(y // 4 AS INT) y, CAST(x // 4 AS INT) x, round(avg(value), 6) v FROM ev GROUP BY 1, 2")
def overview_average(spark, sf_dir):
    g = demo.events_grid(spark, sf_dir).select(*KEY, F.col("value").alias("v"))
    return rounded(grid.pyramid(g, (2, 4))[4])


@query(f"WITH {FCC}, s AS (SELECT (max(y) + 1) * 100 n FROM fcc), f AS (SELECT min(1 << i) f FROM s, range(0, 20) g(i) WHERE CAST(n // CAST(1 << (2 * i) AS BIGINT) AS BIGINT) <= 500) SELECT CAST(y // f AS INT) y, CAST(x // f AS INT) x, v FROM fcc, f WHERE y % f = 0 AND x % f = 0")
def decimate_maxpixels(spark, sf_dir):
    r = demo.fcc(spark, sf_dir)
    m = demo.meta_of(r)
    return grid.overview_nearest(r, grid.decimation(m.ncol, m.nrow, 500))


@query("""WITH c AS (SELECT CAST(i AS BIGINT) cell, i // 11 a, i % 11 b FROM range(0, 99) g(i))
 SELECT p.cell, count(*) n, array_to_string(list(q.cell ORDER BY q.cell), ' ') adj FROM c p JOIN c q ON abs(p.a - q.a) <= 1 AND abs(p.b - q.b) <= 1 AND p.cell <> q.cell GROUP BY p.cell""")
def cell_neighbours(spark, sf_dir):
    out = grid.adjacency(grid.neighbours(spark, 9, 11, 1))
    return out.select("cell", "n", F.array_join(F.col("adj").cast("array<string>"), " ").alias("adj"))


@query("""WITH c AS (SELECT CAST(i AS BIGINT) cell, i // 7 a, i % 7 b FROM range(0, 35) g(i)), n AS (SELECT p.cell, count(*) n FROM c p JOIN c q ON abs(p.a - q.a) <= 1 AND abs(p.b - q.b) <= 1 AND p.cell <> q.cell GROUP BY 1)
 SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) start FROM n""")
def neighbour_offsets(spark, sf_dir):
    return grid.offsets(grid.adjacency(grid.neighbours(spark, 5, 7, 1)))


@query(f"WITH {FCC}, {EVENTS} SELECT (x + 0.5::DOUBLE) * 30 east, 0.0 - (y + 0.5::DOUBLE) * 30 north, CASE WHEN v = 0 THEN 'lost' ELSE 'kept' END class FROM fcc WHERE v < 255")
def observation_points(spark, sf_dir):
    east, north = pixels.pixel_center(META)
    seen = demo.fcc(spark, sf_dir).filter("v < 255")
    return seen.select(east.alias("east"), north.alias("north"), F.when(F.col("v") == 0, "lost").otherwise("kept").alias("class"))


@query("""WITH c AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) cell FROM part WHERE p_size > 15), d AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 id FROM c)
 SELECT p.cell, p.id cell_id, q.cell neighbor, q.id neighbor_id FROM d p JOIN d q ON abs(p.cell // 40 - q.cell // 40) <= 2 AND abs(p.cell % 40 - q.cell % 40) <= 2 AND p.cell <> q.cell""")
def cell_neighbours_masked(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    cells = parts.filter("p_size > 15").select(F.col("p_partkey").alias("cell"))
    rows = int(cells.agg(F.max("cell")).first()[0]) // 40 + 1
    return grid.neighbours_within(cells, rows, 40, 2)


# ---- aggregates


@query(f"WITH {RISK}, c AS (SELECT v, count(*) n FROM risk GROUP BY 1) SELECT CAST(g.i AS INT) cat, coalesce(n, 0) n FROM range(1, 65536) g(i) LEFT JOIN c ON v = g.i")
def histogram_risk(spark, sf_dir):
    return aggregate.histogram(demo.risk(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT round(min(value), 6) min, round(max(value), 6) max, round(avg(value), 6) mean, round(stddev_pop(value), 6) std FROM ev")
def band_statistics(spark, sf_dir):
    return rounded(aggregate.band_statistics(demo.events_grid(spark, sf_dir), "value"))


@query(f"WITH {FCC123}, {_DATES} SELECT 't1' band, min(t1)::DOUBLE lo, max(t1)::DOUBLE hi FROM t UNION ALL SELECT 't2', min(t2), max(t2) FROM t UNION ALL SELECT 't3', min(t3), max(t3) FROM t")
def check_fcc_minmax(spark, sf_dir):
    t = _dates(spark, sf_dir)
    aggregate.check_forest_cover(t, ["t1", "t2", "t3"], META, META.crs, strict=True)
    return aggregate.minmax(t, ["t1", "t2", "t3"])


@query(f"WITH {FCC} SELECT CAST(y // 7 AS INT) y, CAST(x // 7 AS INT) x, count(*) FILTER (v = 1) n FROM fcc GROUP BY 1, 2")
def resample_sum(spark, sf_dir):
    return aggregate.resample_sum(demo.fcc(spark, sf_dir), 1, 7)


@query(f"WITH {_STACK} SELECT CAST(round_even(sum(CASE WHEN v = 0 THEN greatest(stock, 0) END) * 0.47::DOUBLE * 0.09::DOUBLE, 0) AS BIGINT) carbon FROM st")
def emissions(spark, sf_dir):
    stocked = grid.align(demo.fcc(spark, sf_dir), META, demo.stock(spark, sf_dir).withColumnRenamed("v", "stock"), STOCK_META)
    return aggregate.emissions(stocked, META)


@query(f"WITH {PAIRS} SELECT CAST(y // 33 * 4 + x // 33 AS BIGINT) square, count(*) FILTER (obs = 1) obs_f, count(*) FILTER (pred = 1) pred_f, count(*) FILTER (obs = 0) obs_d, count(*) FILTER (pred = 0) pred_d FROM pairs GROUP BY 1")
def validation_npix(spark, sf_dir):
    return aggregate.counts_by_square(demo.observed_and_predicted(spark, sf_dir), META, 33)


@query("""WITH s AS (SELECT value s, event_type = 'purchase' pos FROM events), t AS (SELECT s, count(*) FILTER (pos) p, count(*) FILTER (NOT pos) q FROM s GROUP BY s),
 w AS (SELECT *, sum(q) OVER (ORDER BY s) - q / 2.0::DOUBLE below FROM t) SELECT round(sum(p * below) / (sum(p)::DOUBLE * sum(q)), 9) auc, CAST(sum(p) AS BIGINT) n_pos, CAST(sum(q) AS BIGINT) n_neg FROM w""")
def auc_exact(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select(F.col("value").alias("score"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))
    return rounded(aggregate.auc(scored), 9)


@query(f"""WITH s AS (SELECT event_id, value, event_type = 'purchase' pos FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY {draw_sql("event_id")}, event_id) - 1 i, count(*) OVER (PARTITION BY pos) n FROM s),
 u AS (SELECT {uniform_sql("k", seed=1235)} a, {uniform_sql("k", seed=1236)} b FROM range(0, 20000) g(k)), t AS (SELECT max(n) FILTER (pos) np, max(n) FILTER (NOT pos) nn FROM n),
 d AS (SELECT CAST(floor(a * np) AS BIGINT) i, CAST(floor(b * nn) AS BIGINT) j FROM u, t)
 SELECT avg(CASE WHEN p.value > q.value THEN 1.0::DOUBLE WHEN p.value = q.value THEN 0.5 ELSE 0 END) auc FROM d JOIN n p ON p.pos AND p.i = d.i JOIN n q ON NOT q.pos AND q.i = d.j""")
def auc_sampled(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))
    return aggregate.sampled_auc(scored, "event_id", draws=20_000)


@query("""WITH d AS (SELECT greatest(least(value / 500.0::DOUBLE, 0.99::DOUBLE), 0.01::DOUBLE) p, CAST(user_id % 3 = 0 AS INT) y FROM events), m AS (SELECT avg(y) m, count(*) n FROM d),
 a AS (SELECT -2 * sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) dev FROM d) SELECT round(dev, 4) deviance, round(-2 * n * (m * ln(m) + (1 - m) * ln(1 - m)), 4) null_deviance, round(100 * (1 - dev / (-2 * n * (m * ln(m) + (1 - m) * ln(1 - m)))), 4) explained FROM a, m""")
def log_loss_deviance(spark, sf_dir):
    p = F.greatest(F.least(F.col("value") / 500.0, F.lit(0.99)), F.lit(0.01))
    scored = table(spark, sf_dir, "events").select(p.alias("p"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("y"))
    return rounded(aggregate.deviance(scored), 4)


@query("""WITH d AS (SELECT value v, CAST(event_type = 'click' AS INT) s FROM events), q AS (SELECT list_transform(range(0, 11), lambda i: i) k, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) q FROM d),
 b AS (SELECT i bin, q[i] lo, q[i + 1] hi FROM q, range(1, 11) g(i)), a AS (SELECT bin, lo, hi, count(*) n, sum(s) s FROM d JOIN b ON v > lo AND v <= hi GROUP BY 1, 2, 3)
 SELECT CAST(bin AS INT) bin, round((lo + hi) / 2, 6) mid, n, round(s / n::DOUBLE, 6) rate, round(sqrt((s + 0.5::DOUBLE) / (n + 1) * (1 - (s + 0.5::DOUBLE) / (n + 1)) / (n + 1)), 6) se FROM a""")
def decile_bins(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("value").alias("v"), (F.col("event_type") == "click").cast("int").alias("s"))
    return rounded(aggregate.quantile_bins(d, "v", "s"))


@query("SELECT CAST(least(floor(value / 25.0::DOUBLE) + 1, 20) AS INT) bin, count(*) n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def fixed_histogram(spark, sf_dir):
    return aggregate.fixed_bins(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 20)


@query("""WITH l AS (SELECT 'value' parameter, value v FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events)
 SELECT parameter, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(quantile_cont(v, 0.025), 6) q025, round(quantile_cont(v, 0.975), 6) q975 FROM l GROUP BY 1""")
def posterior_summary(spark, sf_dir):
    return rounded(aggregate.posterior_summary(table(spark, sf_dir, "events"), ["value", "user_id"]))


@query(f"WITH {FCC} SELECT v, count(*) n FROM fcc WHERE v < 255 GROUP BY 1")
def class_counts(spark, sf_dir):
    return demo.fcc(spark, sf_dir).filter("v < 255").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


# ---- projection and validation


@query(f"WITH {FCC123}, {RISK}, {RATES} SELECT cat, nfor, ndefor, {RATE_SQL}, 10.0::DOUBLE time_interval, 0.09::DOUBLE pixel_area FROM full_")
def defrate_per_cat(spark, sf_dir):
    return nine(project.rates_by_class(demo.fcc123(spark, sf_dir), demo.risk(spark, sf_dir), META, YEARS), *RATE_COLUMNS)


def _period(period: str, start: int, lost: str) -> None:
    """The table of classes for the other periods: which codes are forest at the start and which are lost."""
    rates = RATES.replace("f.v > 0", f"f.v > {start}").replace("f.v = 1", f"f.v IN ({lost})")

    def run(spark, sf_dir):
        return nine(project.rates_by_class(demo.fcc123(spark, sf_dir), demo.risk(spark, sf_dir), META, YEARS, period), *RATE_COLUMNS)

    run.__name__ = f"defrate_{period}"
    query(f"WITH {FCC123}, {RISK}, {rates} SELECT cat, nfor, ndefor, {RATE_SQL}, 10.0::DOUBLE time_interval, 0.09::DOUBLE pixel_area FROM full_")(run)


for _name, _start, _lost in (("validation", 1, "2"), ("historical", 0, "1, 2"), ("forecast", 0, "1, 2")):
    _period(_name, _start, _lost)


@query(f"WITH {RISK}, {CUT} SELECT CAST(threshold AS INT) threshold, CAST(ndp AS BIGINT) ndp, CAST(nfp AS BIGINT) nfp, round(k * 0.09::DOUBLE, 6) hectares, round(CASE WHEN k >= nfp THEN 0 ELSE ndp * 0.09::DOUBLE - k * 0.09::DOUBLE END, 6) error, round_even(100 * (CASE WHEN k >= nfp THEN 0 ELSE ndp * 0.09::DOUBLE - k * 0.09::DOUBLE END) / (k * 0.09::DOUBLE), 2) error_perc FROM cut")
def deforest_threshold(spark, sf_dir):
    r = demo.risk(spark, sf_dir)
    return rounded(project.quota_threshold(r, META, demo.quota_ha(r, 0.3)))


@query(f"WITH {FUTURE} SELECT y, x, v FROM future")
def deforest_map(spark, sf_dir):
    return demo.future(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT y, x, CASE WHEN obs = 1 AND pred = 0 THEN 2 WHEN obs = 0 AND pred = 1 THEN 3 ELSE obs END v FROM pairs")
def diff_raster(spark, sf_dir):
    p = demo.observed_and_predicted(spark, sf_dir)
    return p.select(*KEY, pixels.difference(F.col("obs"), F.col("pred")).alias("v"))


@query(f"WITH {PAIRS}, d AS (SELECT CASE WHEN obs = 1 AND pred = 0 THEN 2 WHEN obs = 0 AND pred = 1 THEN 3 ELSE obs END v FROM pairs) SELECT count(*) FILTER (v = 0) n00, count(*) FILTER (v = 3) n01, count(*) FILTER (v = 2) n10, count(*) FILTER (v = 1) n11 FROM d")
def mat_diffproj(spark, sf_dir):
    return aggregate.difference_matrix(diff_raster(spark, sf_dir))


def _indices_sql(event: int, decimals: int | None, source: str) -> str:
    hit, rest, false_, missed = ("n11", "n00", "n10", "n01") if event == 1 else ("n00", "n11", "n01", "n10")
    cut = (lambda e: f"round_even({e}, {decimals})") if decimals is not None else (lambda e: f"round({e}, 9)")
    oa, ea = "(n00 + n11) / n", "((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)"
    sen, spe = f"{hit} / nullif({hit} + {missed}, 0)", f"{rest} / nullif({rest} + {false_}, 0)"
    parts = {"OA": oa, "EA": ea, "FOM": f"{hit} / nullif({hit} + n10 + n01, 0)", "Sen": sen, "Spe": spe, "TSS": f"{sen} + {spe} - 1", "K": f"({oa} - {ea}) / (1 - {ea})"}
    return f"m AS ({source}), z AS (SELECT n00::DOUBLE n00, n01::DOUBLE n01, n10::DOUBLE n10, n11::DOUBLE n11, (n00 + n01 + n10 + n11)::DOUBLE n FROM m) SELECT " + ", ".join(f'{cut(e)} AS "{k}"' for k, e in parts.items()) + " FROM z"


@query(f"WITH {PAIRS}, {_indices_sql(1, 2, f'SELECT {MATRIX} FROM pairs')}")
def map_validation(spark, sf_dir):
    return validate.indices(aggregate.confusion(demo.observed_and_predicted(spark, sf_dir)), decimals=2)


@query(f"WITH {PAIRS}, {_indices_sql(1, None, f'SELECT {MATRIX} FROM pairs')}")
def accuracy_indices(spark, sf_dir):
    return rounded(validate.indices(aggregate.confusion(demo.observed_and_predicted(spark, sf_dir))), 9)


_GRIDS = f"""{PAIRS}, g AS (SELECT y // 10 gy, x // 10 gx, count(*) FILTER (obs = 0) o0, count(*) FILTER (obs = 1) o1, count(*) FILTER (pred = 0) p0, count(*) FILTER (pred = 1) p1 FROM pairs GROUP BY 1, 2),
 cm AS (SELECT CAST(sum(least(o0, p0)) AS BIGINT) n00, CAST(sum(greatest(0, p1 - o1)) AS BIGINT) n10, CAST(sum(greatest(0, p0 - o0)) AS BIGINT) n01, CAST(sum(least(o1, p1)) AS BIGINT) n11 FROM g)"""


def _count_matrix(spark, sf_dir) -> DataFrame:
    p = demo.observed_and_predicted(spark, sf_dir)
    one = lambda c, v, n: aggregate.resample_sum(p.select(*KEY, F.col(c).alias("v")), v, 10).withColumnRenamed("n", n)
    grids = one("obs", 0, "o0").join(one("obs", 1, "o1"), [*KEY]).join(one("pred", 0, "p0"), [*KEY]).join(one("pred", 1, "p1"), [*KEY])
    return aggregate.count_confusion(grids)


@query(f"WITH {_GRIDS} SELECT n00, n10, n01, n11 FROM cm")
def map_confmat(spark, sf_dir):
    return _count_matrix(spark, sf_dir)


@query(f"WITH {_GRIDS}, z AS (SELECT n00::DOUBLE n00, n01::DOUBLE n01, n10::DOUBLE n10, n11::DOUBLE n11, (n00 + n01 + n10 + n11)::DOUBLE n FROM cm) SELECT round((n00 + n11) / n, 9) AS \"OA\", round(((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n), 9) AS \"EA\", round(n00 / (n00 + n10 + n01), 9) AS \"FOM\", round(n00 / (n00 + n10), 9) AS \"Sen\", round(n11 / (n11 + n01), 9) AS \"Spe\", round(n00 / (n00 + n10) + n11 / (n11 + n01) - 1, 9) AS \"TSS\", round(((n00 + n11) / n - ((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)) / (1 - ((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)), 9) AS \"K\" FROM z")
def map_accuracy(spark, sf_dir):
    return rounded(validate.map_indices(_count_matrix(spark, sf_dir)), 9)


_UDEF = f"""{FCC123}, {RISK}, {RATES}, c AS (SELECT CAST(f.y // 10 * 10 + f.x // 10 AS BIGINT) cell, count(*) FILTER (f.v > 0) nfor_obs, count(*) FILTER (f.v = 1) ndefor_obs, coalesce(sum(d.dens * 10.0::DOUBLE), 0) ndefor_pred_ha
 FROM fcc123 f JOIN risk r USING (y, x) LEFT JOIN full_ d ON d.cat = r.v GROUP BY 1 HAVING count(*) FILTER (f.v > 0) > 0),
 k AS (SELECT cell, nfor_obs, ndefor_obs, nfor_obs * 0.09::DOUBLE nfor_obs_ha, ndefor_obs * 0.09::DOUBLE ndefor_obs_ha, ndefor_pred_ha FROM c)"""


def _cells(spark, sf_dir) -> DataFrame:
    a, b = demo.fcc123(spark, sf_dir), demo.risk(spark, sf_dir)
    return validate.predicted_and_observed(a, b, project.rates_by_class(a, b, META, YEARS), META, YEARS, pixels=10)


@query(f"WITH {_UDEF} SELECT cell, nfor_obs, ndefor_obs, round(nfor_obs_ha, 6) nfor_obs_ha, round(ndefor_obs_ha, 6) ndefor_obs_ha, round(ndefor_pred_ha, 6) ndefor_pred_ha FROM k")
def udef_arp_cells(spark, sf_dir):
    return rounded(_cells(spark, sf_dir))


@query(f"WITH {_UDEF}, e AS (SELECT *, ndefor_pred_ha - ndefor_obs_ha e FROM k) SELECT round_even(sqrt(avg(e * e)), 2) AS \"RMSE\", round_even(sqrt(sum(e * e * nfor_obs_ha) / sum(nfor_obs_ha)), 2) AS \"wRMSE\", round_even(median(abs(e)), 2) AS \"MedAE\", round_even(pow(corr(ndefor_pred_ha, ndefor_obs_ha), 2), 2) AS \"R2\", count(*) ncell, 10 csize_coarse_grid, 9.0::DOUBLE csize_coarse_grid_ha FROM e")
def validation_udef_arp(spark, sf_dir):
    return validate.cell_errors(_cells(spark, sf_dir), 10, META)


@query(f"""WITH {FCC123}, {RISK}, {RATES}, a AS (SELECT sum(nfor * rate_mod) s FROM full_), p AS (SELECT v, count(*) n FROM risk WHERE v > 0 GROUP BY 1),
 t AS (SELECT sum(n * (SELECT rate_mod FROM full_ WHERE cat = v) * (50.0::DOUBLE / (0.09::DOUBLE * s)) * 0.09::DOUBLE / 5.0::DOUBLE) annual FROM p, a)
 SELECT 'annual' period, 1 AS "length (yr)", round_even(annual, 1) AS "deforestation (ha)" FROM t UNION ALL SELECT 'entire', 5, round_even(annual * 5, 1) FROM t""")
def allocate_deforestation(spark, sf_dir):
    r = demo.risk(spark, sf_dir)
    rates = project.rates_by_class(demo.fcc123(spark, sf_dir), r, META, YEARS)
    return project.allocate(r, rates, 50.0, 5.0)


@query(f"WITH {FCC123}, {RISK}, {RATES} SELECT y, x, {nine_sql('coalesce(dens, -9999):v')} FROM risk LEFT JOIN full_ ON cat = v")
def density_map(spark, sf_dir):
    r = demo.risk(spark, sf_dir)
    return nine(project.density_map(r, project.rates_by_class(demo.fcc123(spark, sf_dir), r, META, YEARS)), "v")


def _states(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("state")).agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("forest"), (F.count(F.lit(1)) * 1200.0).alias("defor"))


_STATES = "s AS (SELECT c_nationkey state, round(sum(greatest(c_acctbal, 0)), 2) forest, count(*) * 1200.0::DOUBLE defor FROM customer GROUP BY 1)"
_DIFFUSE = """ RECURSIVE {states}, r(state, forest, loss, spent, i) AS (SELECT state, forest, defor * {t}, false, 0 FROM s UNION ALL
 SELECT state, forest, CASE WHEN loss > forest THEN forest WHEN spent THEN loss ELSE loss + ex / nullif(open_, 0) END, spent OR loss > forest, i + 1
 FROM (SELECT *, sum(greatest(loss - forest, 0)) OVER () ex, count(*) FILTER (NOT spent AND loss <= forest) OVER () open_ FROM r) WHERE ex > 0 AND open_ > 0 AND i < 60)"""


@query("WITH" + _DIFFUSE.format(states=_STATES, t=3) + ", f AS (SELECT max(i) m FROM r) SELECT state, round(forest, 4) forest_t0, round(forest - loss, 4) forest_t, round(loss, 4) defor FROM r, f WHERE i = m")
def diffusion(spark, sf_dir):
    return rounded(project.deforest_diffusion(_states(spark, sf_dir), 2020, 2023), 4)


@query()
def diffusion_years(spark, sf_dir):
    return project.years_to_exhaustion(_states(spark, sf_dir), 2020)


# ---- sampling

_KEYED = f"k AS (SELECT y, x, v, ((((1234 + y + 1) % 4294967296) * ({_M}) + (1234 >> 16)) % 4294967296) a FROM fcc WHERE v IN (0, 1)), d AS (SELECT y, x, v, (((a + x + 1) % 4294967296) * ({_M}) + (a >> 16)) % 4294967296 h FROM k), pick AS (SELECT y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY h, y, x) r FROM d) WHERE r <= 200)"


@query(f"WITH {FCC}, {_KEYED} SELECT y, x, v FROM pick")
def stratified_sample(spark, sf_dir):
    return sample.stratified(demo.fcc(spark, sf_dir), 200)


@query(f"WITH {_STACK}, {_KEYED} SELECT p.y, p.x, p.v, s.risk, s.stock FROM pick p LEFT JOIN st s USING (y, x)")
def sample_lookup(spark, sf_dir):
    drawn = sample.stratified(demo.fcc(spark, sf_dir), 200)
    return sample.lookup(drawn, _stack(spark, sf_dir).drop("v"), at_most=400)


_TWO_STAGE = f"""c AS (SELECT y, x, v, y // 10 tile, {draw_sql("y", "x")} h FROM fcc WHERE v IN (0, 1)), n AS (SELECT v, tile, count(*) n FROM c GROUP BY 1, 2),
 r AS (SELECT v, tile, sum(n) OVER w - n lo, sum(n) OVER w hi, sum(n) OVER (PARTITION BY v) total FROM n WINDOW w AS (PARTITION BY v ORDER BY tile)),
 d AS (SELECT v, least(CAST(floor({uniform_sql("k", seed=1235)} * total) AS BIGINT), total - 1) p FROM range(0, 200) g(k), (SELECT DISTINCT v, total FROM r)),
 w AS (SELECT r.v, r.tile, count(*) want FROM d JOIN r ON d.v = r.v AND p >= lo AND p < hi GROUP BY 1, 2),
 drawn AS (SELECT y, x, v FROM (SELECT c.*, want, row_number() OVER (PARTITION BY c.v, c.tile ORDER BY h, y, x) k FROM c JOIN w ON c.v = w.v AND c.tile = w.tile) WHERE k <= want)"""


@query(f"WITH {FCC}, {_TWO_STAGE} SELECT y, x, v FROM drawn")
def two_stage_sample(spark, sf_dir):
    return sample.two_stage(demo.fcc(spark, sf_dir), F.floor(F.col("y") / 10), 200)


@query(f"WITH {_STACK}, {_TWO_STAGE} SELECT w.y, w.x, w.v, s.risk, s.stock, (w.x + 0.5::DOUBLE) * 30.0 + 0.0 AS east, 0.0 - (w.y + 0.5::DOUBLE) * 30.0 AS north, CAST(floor((w.y + 0.5::DOUBLE) * 30.0 / 1000) * 3 + floor((w.x + 0.5::DOUBLE) * 30.0 / 1000) AS BIGINT) cell FROM drawn w LEFT JOIN st s USING (y, x)")
def model_sample(spark, sf_dir):
    """The whole sampling step: drawn pixels, layers, centres and cells."""
    out = sample.sample(demo.fcc(spark, sf_dir), _stack(spark, sf_dir).drop("v"), META, F.floor(F.col("y") / 10), 200, csize=1.0)
    return out.select("y", "x", "v", "risk", "stock", "east", "north", "cell")


@query(f"WITH {FCC}, a AS (SELECT count(*) FILTER (v IN (0, 1)) * 0.09::DOUBLE ha FROM fcc) SELECT CAST(greatest(10000, least(50000, round_even(1000 * ha / 1e6::DOUBLE, 0))) AS INT) size, CAST(greatest(10, least(50, round_even(1000 * ha / 1e6::DOUBLE, 0))) AS INT) small FROM a")
def adapted_sample_size(spark, sf_dir):
    ha = demo.fcc(spark, sf_dir).filter("v in (0, 1)").count() * META.pixel_ha
    return spark.createDataFrame([(sample.adapted_size(ha), sample.adapted_size(ha, 10, 50))], "size int, small int")


@query(f"WITH b AS (SELECT event_id, ((((1234 + event_id + 1) % 4294967296) * ({_M}) + (1234 >> 16)) % 4294967296) a FROM events), c AS (SELECT event_id, (((a + 2 + 1) % 4294967296) * ({_M}) + (a >> 16)) % 4294967296 h FROM b), r AS (SELECT *, row_number() OVER (ORDER BY h, event_id) r, count(*) OVER () n FROM c) SELECT event_id, r <= round_even(n * 30 / 100.0::DOUBLE, 0) is_test FROM r")
def train_test_split(spark, sf_dir):
    return sample.holdout(table(spark, sf_dir, "events").select("event_id"), "event_id", 30, 2)


@query(f"WITH n AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY {draw_sql('s_suppkey')}, s_suppkey) - 1 i, count(*) OVER () n FROM supplier), d AS (SELECT CAST(floor({uniform_sql('k', seed=1235)} * (SELECT max(n) FROM n)) AS BIGINT) i FROM range(0, 500) g(k)) SELECT s_suppkey, s_acctbal FROM d JOIN n USING (i)")
def bootstrap_draw(spark, sf_dir):
    return sample.bootstrap(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), 500, "s_suppkey")


@query("WITH q AS (SELECT quantile_cont(value, 0.7) c FROM events) SELECT event_id, CAST(value > c AS INT) pred FROM events, q")
def quantile_cut(spark, sf_dir):
    return validate.above_quantile(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.3).select("event_id", "pred")


# ---- geometry


@query(f"WITH {FCC}, t AS (SELECT y, x FROM fcc WHERE v = 0), d AS (SELECT f.y, f.x, min((f.y - t.y) * (f.y - t.y) + (f.x - t.x) * (f.x - t.x)) m FROM fcc f JOIN t ON abs(f.y - t.y) <= 30 AND abs(f.x - t.x) <= 30 GROUP BY 1, 2) SELECT y, x, CAST(floor(sqrt(m * 900.0::DOUBLE)) AS BIGINT) v FROM d")
def edt_distance(spark, sf_dir):
    return spatial.distance(demo.fcc(spark, sf_dir), META, target=0)


_NEAR = {"a": (-1, -1), "b": (-1, 0), "c": (-1, 1), "d": (0, -1), "f": (0, 1), "g": (1, -1), "h": (1, 0), "i": (1, 1)}
_OPP = {"b": "h", "h": "b", "d": "f", "f": "d"}
_DIAGONAL = {"a": "bd", "c": "bf", "g": "hd", "i": "hf"}
_SLOPE = (
    f"WITH {EVENTS}, n AS (SELECT e.y, e.x, e.value e, " + ", ".join(f"{k}.value {k}" for k in _NEAR) + " FROM ev e "
    + " ".join(f"LEFT JOIN ev {k} ON {k}.y = e.y + {dy} AND {k}.x = e.x + {dx}" for k, (dy, dx) in _NEAR.items())
    + "), k AS (SELECT y, x, e, a, c, g, i, " + ", ".join(f"coalesce({k}, 2 * e - {o}, e) {k}" for k, o in _OPP.items())
    + " FROM n), m AS (SELECT y, x, b, d, f, h, " + ", ".join(f"coalesce({k}, {p} + {q} - e) {k}" for k, (p, q) in _DIAGONAL.items())
    + " FROM k), g AS (SELECT y, x, ((c + 2 * f + i) - (a + 2 * d + g)) / 240.0::DOUBLE p, ((g + 2 * h + i) - (a + 2 * b + c)) / 240.0::DOUBLE q FROM m) SELECT y, x, CAST(round_even(degrees(atan(sqrt(p * p + q * q))), 0) AS SMALLINT) v FROM g"
)


@query(_SLOPE)
def slope(spark, sf_dir):
    return spatial.slope(demo.events_grid(spark, sf_dir).select(*KEY, F.col("value").alias("v")), META)


#: An L-shaped polygon and a triangle on the first rows of the grid, in map units.
_SHAPES = [
    (1, [[(300.0, -150.0), (1500.0, -150.0), (1500.0, -600.0), (900.0, -600.0), (900.0, -1800.0), (300.0, -1800.0)]]),
    (2, [[(1811.0, -161.0), (2713.0, -161.0), (2262.0, -1063.0)]]),
]


def _polygons(spark) -> DataFrame:
    rows = [(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in _SHAPES]
    return spark.createDataFrame(rows, f"id int, rings {vector.RINGS}")


_INSIDE = """((px > 300 AND px < 1500 AND py > 150 AND py < 600) OR (px > 300 AND px < 900 AND py > 150 AND py < 1800))"""
_TRIANGLE = "(py > 161 AND py < 1063 AND px > 1811 + (py - 161) / 2 AND px < 2713 - (py - 161) / 2)"


@query(f"WITH p AS (SELECT CAST(i // 100 AS INT) y, CAST(i % 100 AS INT) x, (i // 100 + 0.5::DOUBLE) * 30 py, (i % 100 + 0.5::DOUBLE) * 30 px FROM range(0, 10000) g(i)) SELECT 1 id, y, x FROM p WHERE {_INSIDE} UNION ALL SELECT 2, y, x FROM p WHERE {_TRIANGLE}")
def rasterize_polygon(spark, sf_dir):
    return spatial.rasterize(_polygons(spark), RasterMeta(WIDTH, 100))


@query(f"WITH {FCC} SELECT y, x, v FROM fcc WHERE (y BETWEEN 5 AND 20 AND x BETWEEN 10 AND 50) OR (y BETWEEN 5 AND 60 AND x BETWEEN 10 AND 30)")
def crop_cutline(spark, sf_dir):
    r = demo.fcc(spark, sf_dir)
    return spatial.crop(r, _polygons(spark).filter("id = 1"), demo.meta_of(r))


@query("SELECT 300.0::DOUBLE xmin, -1800.0::DOUBLE ymin, 2713.0::DOUBLE xmax, -150.0::DOUBLE ymax")
def vector_extent(spark, sf_dir):
    return spatial.extent(vector.vertices(_polygons(spark)))


@query("SELECT CAST(floor(min(s_acctbal) - 5000) AS BIGINT) xmin, CAST(floor(min(s_suppkey) - 5000) AS BIGINT) ymin, CAST(ceil(max(s_acctbal) + 5000) AS BIGINT) xmax, CAST(ceil(max(s_suppkey) + 5000) AS BIGINT) ymax FROM supplier")
def buffered_extent(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("y"))
    return spatial.buffered(spatial.extent(points))


# Means in whole cents, rounded half up in integers: a mean of doubles can fall on either side of a tie.
_EFFECTS = """c AS (SELECT c_nationkey cell, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT) + 1000000) AS BIGINT) s, count(*) n FROM customer GROUP BY 1),
 e AS (SELECT cell, ((2 * s + n) // (2 * n) - 1000000) / 100.0::DOUBLE rho FROM c)"""


def _effects(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long") + 1_000_000
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("cell")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("cell", ((F.expr("(2 * s + n) div (2 * n)") - 1_000_000) / 100.0).alias("rho"))


_W = "CASE d WHEN -1 THEN pow(1 - t, 3) / 6 WHEN 0 THEN (3 * pow(t, 3) - 6 * t * t + 4) / 6 WHEN 1 THEN (-3 * pow(t, 3) + 3 * t * t + 3 * t + 1) / 6 ELSE pow(t, 3) / 6 END"


@query(f"""WITH {_EFFECTS}, ax AS (SELECT CAST(i AS INT) i, CAST(floor((i + 0.5::DOUBLE) / 10 - 0.5) AS INT) f, (i + 0.5::DOUBLE) / 10 - 0.5 - floor((i + 0.5::DOUBLE) / 10 - 0.5) t FROM range(0, 50) g(i)), o AS (SELECT CAST(d AS INT) d FROM range(-1, 3) g(d)),
 w AS (SELECT i, f + d n, {_W} w FROM ax, o) SELECT a.i y, b.i x, round(sum(a.w * b.w * rho) / sum(a.w * b.w), 6) v FROM w a, w b JOIN e ON true WHERE e.cell = a.n * 5 + b.n AND a.n BETWEEN 0 AND 4 AND b.n BETWEEN 0 AND 4 GROUP BY 1, 2""")
def interpolate_rho(spark, sf_dir):
    return rounded(spatial.interpolate_effects(_effects(spark, sf_dir), 5, 5))


@query(f"WITH {_EFFECTS} SELECT CAST(cell // 5 AS INT) y, CAST(cell % 5 AS INT) x, rho v FROM e")
def wrast_rho(spark, sf_dir):
    return spatial.spatial_effects(_effects(spark, sf_dir), 5, 5)


_E2 = "0.0818191908426215::DOUBLE"


@query(f"""WITH p AS (SELECT CAST(s_suppkey AS BIGINT) id, s_suppkey % 360 - 180.0::DOUBLE lon, s_acctbal % 80 lat FROM supplier)
 SELECT id, round(lon, 6) lon, round(lat, 6) lat, round(radians(lon) * 6378137.0, 3) east,
 round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - {_E2} * sin(radians(lat))) / (1 + {_E2} * sin(radians(lat))), {_E2} / 2)), 3) north FROM p""")
def reproject_points(spark, sf_dir):
    """There and back: the way back has to give the latitude that SQL starts from."""
    lon, lat = (F.col("s_suppkey") % 360) - 180.0, (F.col("s_acctbal") % 80)
    east, north = spatial.to_mercator(lon, lat)
    back, up = spatial.from_mercator(east, north)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(back, 6).alias("lon"), F.round(up, 6).alias("lat"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query()
def warp_mercator(spark, sf_dir):
    """The risk raster, taken as degrees of a hundredth, on a metric grid that covers it whole.

    A raster taller than 80 degrees is taken as finer pixels, and so is the grid: past the pole no pixel has a place.
    """
    risk = demo.risk(spark, sf_dir)
    height = demo.meta_of(risk).nrow
    degrees = min(0.01, 80.0 / height)
    source = RasterMeta(WIDTH, height, 0.0, 0.0, degrees, degrees, "EPSG:4326")
    target = spatial.warped_meta(spark, source, 1000.0 * degrees / 0.01)
    g = spark.range(target.ncol * target.nrow).select(F.floor(F.col("id") / target.ncol).cast("int").alias("y"), (F.col("id") % target.ncol).cast("int").alias("x"))
    return spatial.warp_nearest(g, target, risk, source)


# ---- lookups and plans


@query("SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL AND (p_type IN ('motorway', 'trunk') OR p_type LIKE '%ary' OR p_type LIKE 'PROMO%')")
def osm_filter(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    tagged = parts.withColumn("highway", F.when(F.col("p_type").startswith("PROMO"), "secondary").otherwise(F.col("p_type")))
    return vector.roads(tagged).select("p_partkey", "p_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND year(o_orderdate) < 1996)")
def wdpa_filter(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Designated").when(F.col("o_orderstatus") == "O", "Proposed").otherwise("Not Reported")
    date = F.concat(F.lit("01/01/"), F.date_format(F.col("o_orderdate"), "yyyy").cast("int") + 14)
    areas = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), date.alias("date"))
    return vector.protected_areas(areas).select("o_orderkey")


_BOX = "b AS (SELECT n_nationkey, n_nationkey * 7.3::DOUBLE - 90 xmin, n_nationkey * 7.3::DOUBLE - 88 xmax, n_nationkey * 2.1::DOUBLE - 40 ymin, n_nationkey * 2.1::DOUBLE - 34 ymax FROM nation)"


@query(f"""WITH {_BOX}, r AS (SELECT *, CAST(ceil((floor(xmin) + 180) / 5) AS INT) l, CAST(ceil((ceil(xmax) + 180) / 5) AS INT) rr, CAST(ceil((60 - ceil(ymax)) / 5) AS INT) t, CAST(ceil((60 - floor(ymin)) / 5) AS INT) bb FROM b),
 w AS (SELECT n_nationkey, l, CASE WHEN l = rr THEN rr + 1 ELSE rr END r, t, CASE WHEN t = bb THEN bb + 1 ELSE bb END b FROM r) SELECT n_nationkey, lpad(l::VARCHAR, 2, '0') || '-' || lpad(r::VARCHAR, 2, '0') tile_long, lpad(t::VARCHAR, 2, '0') || '-' || lpad(b::VARCHAR, 2, '0') tile_lat, CAST((r - l + 1) * (b - t + 1) AS BIGINT) n_tiles FROM w""")
def srtm_tiles(spark, sf_dir):
    k = F.col("n_nationkey")
    box = table(spark, sf_dir, "nation").select(k, (k * 7.3 - 90).alias("xmin"), (k * 7.3 - 88).alias("xmax"), (k * 2.1 - 40).alias("ymin"), (k * 2.1 - 34).alias("ymax"))
    ranges = planning.tile_range(box)
    n = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    return ranges.select("n_nationkey", "tile_long", "tile_lat", n.cast("long").alias("n_tiles"))


@query("SELECT n_regionkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def iso_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return planning.lookup_code(nation, nation.agg(F.min("n_name")).first()[0], "n_name", "n_regionkey")


@query(f"""WITH {_BOX}, r AS (SELECT CAST(ceil((floor(xmin) + 180) / 5) AS INT) l, CAST(ceil((ceil(xmax) + 180) / 5) AS INT) rr, CAST(ceil((60 - ceil(ymax)) / 5) AS INT) t, CAST(ceil((60 - floor(ymin)) / 5) AS INT) bb FROM b),
 w AS (SELECT l, CASE WHEN l = rr THEN rr + 1 ELSE rr END r, t, CASE WHEN t = bb THEN bb + 1 ELSE bb END b FROM r)
 SELECT CAST(i AS INT) i, CAST(j AS INT) j, 'srtm_' || lpad(i::VARCHAR, 2, '0') || '_' || lpad(j::VARCHAR, 2, '0') tile FROM w, range(0, 100) a(i), range(0, 100) c(j) WHERE i BETWEEN l AND r AND j BETWEEN t AND b""")
def tile_product(spark, sf_dir):
    k = F.col("n_nationkey")
    box = table(spark, sf_dir, "nation").select((k * 7.3 - 90).alias("xmin"), (k * 7.3 - 88).alias("xmax"), (k * 2.1 - 40).alias("ymin"), (k * 2.1 - 34).alias("ymax"))
    return planning.tiles(planning.tile_range(box))


@query(f"""WITH {FCC123}, {_DATES}, l AS (SELECT 'fcc12' n, CASE WHEN t1 = 1 THEN t2 ELSE 255 END v FROM t UNION ALL SELECT 'fcc23', CASE WHEN t2 = 1 THEN t3 ELSE 255 END FROM t UNION ALL SELECT 'fcc13', CASE WHEN t1 = 1 THEN t3 ELSE 255 END FROM t
 UNION ALL SELECT 'forest_t1', t1 FROM t UNION ALL SELECT 'forest_t2', t2 FROM t UNION ALL SELECT 'forest_t3', t3 FROM t)
 SELECT s.s AS "set", s.u AS name, v, count(*) n FROM (VALUES ('calibration', 'fcc', 'fcc12'), ('calibration', 'forest', 'forest_t1'), ('validation', 'fcc', 'fcc23'), ('validation', 'forest', 'forest_t2'), ('historical', 'fcc', 'fcc13'), ('historical', 'forest', 'forest_t1'), ('forecast', 'fcc', 'fcc23'), ('forecast', 'forest', 'forest_t3')) s(s, u, d) JOIN l ON l.n = s.d GROUP BY 1, 2, 3""")
def variable_sets(spark, sf_dir):
    """Each set counts its own dated rasters under their undated names."""
    t = _dates(spark, sf_dir)
    change = lambda a, b: pixels.with_nodata(pixels.kept_forest(F.col(a), F.col(b)))
    dated = {"fcc12": change("t1", "t2"), "fcc23": change("t2", "t3"), "fcc13": change("t1", "t3"), **{f"forest_t{i}": F.col(f"t{i}") for i in (1, 2, 3)}}
    # Distances play no part here; they are bound like the rest.
    names = {n for s in raster.VARIABLE_SETS.values() for n in s.values()}
    rasters = {n: t.select(*KEY, dated.get(n, F.lit(0)).alias("v")) for n in names}
    parts = [r[u].select(F.lit(s).alias("set"), F.lit(u).alias("name"), "v") for s, r in raster.bind_variable_sets(rasters).items() for u in ("fcc", "forest")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("set", "name", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RISK} SELECT CAST(CASE WHEN v = 0 THEN 0 WHEN v < 39322 THEN 1 WHEN v < 52429 THEN 2 ELSE 3 END AS INT) stop, count(*) n FROM risk GROUP BY 1")
def prob_stops(spark, sf_dir):
    stop = F.when(F.col("v") == 0, 0).when(F.col("v") < 39322, 1).when(F.col("v") < 52429, 2).otherwise(3)
    return demo.risk(spark, sf_dir).groupBy(stop.alias("stop")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH q AS (SELECT quantile_cont(value, 0.005) lo, quantile_cont(value, 0.995) hi FROM events) SELECT round(greatest(-lo, hi), 6) bound FROM q")
def rho_bounds(spark, sf_dir):
    q = table(spark, sf_dir, "events").agg(F.percentile("value", F.array(F.lit(0.005), F.lit(0.995))).alias("q"))
    return rounded(q.select(F.greatest(-F.get("q", F.lit(0)), F.get("q", F.lit(1))).alias("bound")))


# ---- models

_SAMPLE = f"{FCC}, {EVENTS}, s AS (SELECT f.y, f.x, f.v fcc23, e.value, e.user_id::DOUBLE uid FROM fcc f JOIN ev e USING (y, x) WHERE f.v < 255)"


def _sample(spark, sf_dir) -> DataFrame:
    s = demo.fcc(spark, sf_dir).withColumnRenamed("v", "fcc23").join(demo.events_grid(spark, sf_dir), [*KEY]).filter("fcc23 < 255")
    cell = (F.floor(F.col("y") / 10) * 10 + F.floor(F.col("x") / 10)).cast("long")
    return s.select(*KEY, "fcc23", "value", F.col("user_id").cast("double").alias("uid"), cell.alias("cell"), (F.col("y") * WIDTH + F.col("x")).cast("long").alias("id"), F.lit(1).alias("trial"))


@query(f"WITH {_SAMPLE}, m AS (SELECT avg(value) a, stddev_pop(value) b FROM s) SELECT y, x, CAST(1 - fcc23 AS DOUBLE) resp, 1.0::DOUBLE x0, round((value - a) / b, 6) x1, CASE WHEN fcc23 = 1 THEN 1.0::DOUBLE ELSE 0.0 END x2, round(ln(uid + 1), 6) x3 FROM s, m")
def formula_design(spark, sf_dir):
    d = _sample(spark, sf_dir)
    design = formula.fit("I(1 - fcc23) + trial ~ scale(value) + C(fcc23) + log(uid + 1)", d)
    wide = d.withColumn("resp", design.response.cast("double"))
    return rounded(design.matrix(wide, (*KEY, "resp")))


@query(f"WITH {_SAMPLE}, m AS (SELECT avg(value) a, stddev_pop(value) b FROM s), z AS (SELECT y, x, -0.5::DOUBLE + 0.8::DOUBLE * ((value - a) / b) z FROM s, m), p AS (SELECT y, x, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END p FROM z) SELECT y, x, CAST(trunc((greatest(p, 1e-6::DOUBLE) * 1e6::DOUBLE - 1) * 65534.0::DOUBLE / 999999.0::DOUBLE + 1) AS INT) v FROM p")
def predict_raster(spark, sf_dir):
    d = _sample(spark, sf_dir)
    model = models.Linear(formula.fit("I(1 - fcc23) ~ scale(value)", d), (-0.5, 0.8))
    return models.predict_raster(model, d, ("value", "uid"), None)


@query(f"WITH {_SAMPLE}, m AS (SELECT avg(value) a, stddev_pop(value) b FROM s), z AS (SELECT y, x, -0.5::DOUBLE + 0.8::DOUBLE * ((value - a) / b) + (y // 10 * 10 + x // 10) % 7 / 10.0::DOUBLE z FROM s, m), p AS (SELECT y, x, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END p FROM z) SELECT y, x, CAST(trunc((greatest(p, 1e-6::DOUBLE) * 1e6::DOUBLE - 1) * 65534.0::DOUBLE / 999999.0::DOUBLE + 1) AS INT) v FROM p")
def predict_raster_icar(spark, sf_dir):
    d = _sample(spark, sf_dir).withColumn("rho", (F.col("cell") % 7) / 10.0)
    design = formula.fit("I(1 - fcc23) + trial ~ scale(value) + cell", d, with_cell=True)
    model = icar.IcarModel(design, "", (-0.5, 0.8), d, d)
    return models.predict_raster_icar(model, d, ("value",), forest=None)


@query(f"WITH {_SAMPLE}, m AS (SELECT avg(value) a, stddev_pop(value) b FROM s), z AS (SELECT y, x, -0.5::DOUBLE + 0.8::DOUBLE * ((value - a) / b) + coalesce((y // 10 * 10 + x // 10) % 5 / 4.0::DOUBLE, 0) z FROM s, m) SELECT y, x, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 9) p FROM z")
def icar_score(spark, sf_dir):
    """Probabilities of a spatial model from each cell's own effect."""
    d = _sample(spark, sf_dir)
    effects = d.select("cell").distinct().withColumn("rho", (F.col("cell") % 5) / 4.0)
    design = formula.fit("I(1 - fcc23) + trial ~ scale(value) + cell", d, with_cell=True)
    return rounded(icar.IcarModel(design, "", (-0.5, 0.8), d, effects).score(d).select(*KEY, "p"), 9)


@query(f"WITH {_SAMPLE} SELECT y, x, round(1 / (1 + value / 100.0::DOUBLE), 9) p FROM s")
def predict_with_function(spark, sf_dir):
    d = _sample(spark, sf_dir)
    return models.predict_with(lambda x: 1.0 / (1.0 + x["value"] / 100.0), d, ["value"]).select(*KEY, F.round("p", 9).alias("p"))


@query()
def glm_fit(spark, sf_dir):
    m = models.fit_logistic("I(1 - fcc23) ~ scale(value) + scale(uid)", _sample(spark, sf_dir))
    return spark.createDataFrame([(n, round(b, 6)) for n, b in zip(m.design.names, m.betas, strict=True)], "term string, beta double")


@query()
def rf_fit(spark, sf_dir):
    d = _sample(spark, sf_dir)
    m = models.fit_forest("I(1 - fcc23) ~ value + uid", d)
    return m.score(d).groupBy("fcc23").agg(F.round(F.avg("p"), 6).alias("mean_p"), F.count(F.lit(1)).alias("n"))


@query()
def icar_fit(spark, sf_dir):
    """A sample of all rows, on cells of 10 by 10 pixels over the whole height of the raster."""
    nrow, ncol = -(-demo.meta_of(demo.events_grid(spark, sf_dir)).nrow // 10), WIDTH // 10
    d = sample.smallest_per_group(_sample(spark, sf_dir), ["fcc23"], [sample.draw_key(F.col("id")), "id"], 500)
    settings = icar.Settings(burnin=100, mcmc=100)
    m = icar.fit("I(1 - fcc23) + trial ~ scale(value) + cell", d, grid.neighbours(spark, nrow, ncol), nrow * ncol, settings)
    return m.summary()


@query()
def cross_validation(spark, sf_dir):
    return models.cross_validation(_sample(spark, sf_dir), "I(1 - fcc23) ~ scale(value) + scale(uid)", "id", "glm")


@query("WITH m AS (SELECT stddev_pop(value) sd FROM events) SELECT round((1 / (1 + exp(-(-1 + 0.5::DOUBLE * 10 / sd))) - 1 / (1 + exp(1.0::DOUBLE))) / (1 / (1 + exp(1.0::DOUBLE))), 9) change FROM m")
def effect_size(spark, sf_dir):
    m = table(spark, sf_dir, "events").agg(F.stddev_pop("value").alias("sd"))
    base = pixels.invlogit(F.lit(-1.0))
    return rounded(m.select(((pixels.invlogit(F.lit(-1.0) + 0.5 * 10.0 / F.col("sd")) - base) / base).alias("change")), 9)
