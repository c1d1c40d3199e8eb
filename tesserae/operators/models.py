"""Regression and forest models, scoring of maps, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.pixels import invlogit, rescale
from tesserae.operators import aggregate, forest, formula, icar, sample, validate
from tesserae.runtime import ship
from tesserae.sources.raster import KEY


@dataclass(frozen=True)
class Linear:
    """A logistic model: probabilities are a Column expression of the design."""

    design: formula.Design
    betas: tuple[float, ...]

    def probability(self) -> Column:
        return invlogit(self.design.linear(list(self.betas)))

    def score(self, df: DataFrame, to: str = "p") -> DataFrame:
        return df.withColumn(to, self.probability())


@dataclass(frozen=True)
class SparkForest:
    """Spark's forest, for rows of more distinct bins than ``forest.CELLS``."""

    design: formula.Design
    model: object

    def score(self, df: DataFrame, to: str = "p") -> DataFrame:
        names = self.design.names
        wide = df.withColumns({f"__x{i}": c.cast("double") for i, (n, c) in enumerate(self.design.columns) if n != "Intercept"})
        cols = [f"__x{i}" for i, n in enumerate(names) if n != "Intercept"]
        done = self.model.setFeaturesCol("__f").transform(VectorAssembler(inputCols=cols, outputCol="__f").transform(wide))
        return done.withColumn(to, vector_to_array("probability")[1]).drop(*cols, "__f", "rawPrediction", "probability", "prediction")


def _complete(data: DataFrame, design: formula.Design) -> DataFrame:
    """(label, x0 ..) of the rows without nulls."""
    cols = {f"x{i}": c.cast("double") for i, (n, c) in enumerate(design.columns) if n != "Intercept"}
    return data.select(design.response.cast("double").alias("label"), *[c.alias(n) for n, c in cols.items()]).dropna()


def _training(data: DataFrame, design: formula.Design) -> DataFrame:
    wide = _complete(data, design)
    return VectorAssembler(inputCols=wide.columns[1:], outputCol="features").transform(wide)


def fit_logistic(text: str, data: DataFrame, with_cell: bool = False, strength: float = 1.0) -> Linear:
    """Logistic regression with an L2 penalty of strength 1 over the sum of losses and a free intercept."""
    design = formula.fit(text, data, with_cell)
    train = _training(data, design).cache()
    n = max(1, train.count())
    m = LogisticRegression(regParam=strength / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(train)
    train.unpersist()
    weights = iter(m.coefficients.toArray().tolist())
    return Linear(design, tuple(m.intercept if n == "Intercept" else next(weights) for n in design.names))


def fit_forest(text: str, data: DataFrame, trees: int = 100, depth: int = 30, seed: int = 1234, with_cell: bool = False) -> forest.Forest | SparkForest:
    """Random forest: gini, square root of the features per split, bootstrap; depth is capped at 30 and features are binned.

    Trees grow from counts of the distinct rows of bins, which all rows enter. Where these are too many, Spark's trainer takes the rows.
    """
    design = formula.fit(text, data, with_cell)
    train = _complete(data, design)
    found = forest.fit(train, train.columns[1:], trees, min(30, depth), seed)
    if found is not None:
        return forest.Forest(design, tuple(map(tuple, found[0])), tuple(found[1]))
    rf = RandomForestClassifier(numTrees=trees, maxDepth=min(30, depth), featureSubsetStrategy="sqrt", impurity="gini", seed=seed)
    return SparkForest(design, rf.fit(_training(data, design)))


def predict_raster(model, stacked: DataFrame, bands: tuple[str, ...], forest: str | None = "forest") -> DataFrame:
    """(y, x, v): risk class of every complete forest pixel.

    ``model`` has ``score(df, to)``; a pixel with a null in any band, used or not, is left out.
    """
    ready = stacked.dropna(subset=list(bands))
    ready = ready.filter(F.col(forest) == 1) if forest else ready
    return model.score(ready, "__p").select(*KEY, rescale(F.col("__p")).alias("v"))


def predict_with(function: Callable[[Mapping[str, object]], object], df: DataFrame, columns: list[str], to: str = "p") -> DataFrame:
    """Score with any Python function from a pandas DataFrame to probabilities, in Arrow batches."""

    @F.pandas_udf("double")
    def apply(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(function(rows), index=rows.index)

    ship(df.sparkSession)
    return df.withColumn(to, apply(F.struct(*[F.col(c) for c in columns])))


def predict_raster_icar(model: icar.IcarModel, stacked: DataFrame, bands: tuple[str, ...], rho: str = "rho", forest: str | None = "forest") -> DataFrame:
    """Risk classes of a spatial model with an interpolated effect as one more band: one Column expression, no Python."""
    ready = stacked.dropna(subset=[*bands, rho])
    ready = ready.filter(F.col(forest) == 1) if forest else ready
    p = invlogit(model.design.linear(list(model.betas)) + F.col(rho))
    return ready.select(*KEY, rescale(p).alias("v"))


def cross_validation(
    data: DataFrame, text: str, key: str, kind: str = "glm", ratio: float = 30, repetitions: int = 5, seed: int = 1234, observed: str = "fcc23",
    swap_args: bool = False, **settings,
) -> DataFrame:
    """(index, rep1 .. repN, mean) of AUC, OA, EA, FOM, Sen, Spe, TSS, K on held-out rows, rounded to 4 places.

    Deforested rows (``observed`` = 0) are the positives; predictions are positive strictly above the quantile that leaves
    their share. ``swap_args`` exchanges prediction and observation in the indices, as some published tables do.
    """
    columns: list[dict[str, float]] = []
    for r in range(repetitions):
        split = sample.holdout(data, key, ratio, r, seed).cache()
        train, test = split.filter(~F.col("is_test")), split.filter("is_test")
        if kind == "glm":
            scored = fit_logistic(text, train, **settings).score(test)
        elif kind == "rf":
            scored = fit_forest(text, train, seed=seed + r, **settings).score(test)
        elif kind == "icar":
            scored = icar.fit(text, train, seed=seed + r, **settings).score(test)
        else:
            raise ValueError(f"unknown kind {kind}")
        scored = scored.select("p", F.when(F.col(observed) == 0, 1).otherwise(0).alias("obs")).cache()
        share = scored.agg(F.avg("obs")).first()[0]
        marked = validate.above_quantile(scored, "p", share)
        names = ("obs", "pred") if swap_args else ("pred", "obs")
        row = validate.indices(aggregate.confusion(marked, *names)).first().asDict()
        area = aggregate.auc(scored, "p", "obs").first()[0]
        columns.append({"AUC": area, **row})
        scored.unpersist()
        split.unpersist()
    order = ["AUC", *validate.INDICES]
    rows = [(i, *[round(c[k], 4) for c in columns], round(sum(c[k] for c in columns) / repetitions, 4)) for i, k in [(k, k) for k in order]]
    schema = "`index` string, " + ", ".join(f"rep{r + 1} double" for r in range(repetitions)) + ", mean double"
    return data.sparkSession.createDataFrame(rows, schema)
