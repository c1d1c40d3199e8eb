"""Binomial model with an intrinsic conditional autoregressive effect of spatial cells, by Metropolis within Gibbs.

The likelihood is Bernoulli with logit(theta) = x beta + rho[cell]. Cells of one colour have no neighbour among themselves,
so a whole colour is proposed and accepted at once in numpy. The sample (at most some ten thousand rows) is one task per
chain; chains run in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.pixels import invlogit
from tesserae.operators import aggregate, formula
from tesserae.runtime import ship

ADAPT_EVERY = 100
WANTED_ACCEPTANCE = 0.44


@dataclass(frozen=True)
class Settings:
    burnin: int = 1000
    mcmc: int = 1000
    thin: int = 1
    beta_start: Sequence[float] | float = 0.0
    v_start: float = 1.0
    mubeta: float = 0.0
    vbeta: float = 1.0e6
    prior_v: float = -1.0
    shape: float = 0.5
    rate: float = 0.0005
    v_max: float = 10.0
    save_rho: bool = False

    def check(self) -> None:
        if self.thin < 1 or self.burnin % self.thin or self.mcmc % self.thin:
            raise ValueError("thin must divide burnin and mcmc")
        if self.mcmc < self.thin or self.burnin < 0:
            raise ValueError("mcmc must hold at least one draw")


def colours(n: int, edges: np.ndarray) -> list[np.ndarray]:
    """Cells split greedily into classes without edges inside (four on a grid of king's moves)."""
    around: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges.tolist():
        around[a].append(b)
    colour = np.full(n, -1)
    for i in range(n):
        used = {colour[j] for j in around[i]}
        c = 0
        while c in used:
            c += 1
        colour[i] = c
    return [np.flatnonzero(colour == c) for c in range(colour.max() + 1)] if n else []


def _theta(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def _terms(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Log-likelihood of each observation."""
    return y * z - np.logaddexp(0.0, z)


def _truncated_gamma(rng: np.random.Generator, shape: float, rate: float, least: float) -> float:
    """Gamma draw above ``least``: plain rejection, then an exponential envelope beyond the mode."""
    for _ in range(200):
        x = rng.gamma(shape) / rate
        if x > least:
            return x
    low = least * rate
    lam = max((low - shape + np.sqrt((low - shape) ** 2 + 4 * low)) / (2 * low), 1e-6) if low > 0 else 1.0
    for _ in range(10_000):
        x = low + rng.exponential(1.0 / lam)
        peak = max(low, (shape - 1) / max(1e-12, 1 - lam)) if lam < 1 else low
        if np.log(rng.random()) <= (shape - 1) * (np.log(x) - np.log(peak)) - (1 - lam) * (x - peak):
            return x / rate
    return least


def sample_chain(y: np.ndarray, x: np.ndarray, cell: np.ndarray, n_cells: int, edges: np.ndarray, s: Settings, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(draws of betas, variance and deviance; mean effect per cell; kept effects or an empty array)."""
    rng = np.random.default_rng(seed)
    p = x.shape[1]
    beta = np.broadcast_to(np.asarray(s.beta_start, dtype=float), (p,)).copy()
    rho, v = np.zeros(n_cells), s.v_start
    degree = np.bincount(edges[:, 0], minlength=n_cells).astype(float) if len(edges) else np.zeros(n_cells)
    if (degree == 0).any():
        raise ValueError("every cell needs a neighbour")
    seen = np.bincount(cell, minlength=n_cells) > 0
    order = np.argsort(edges[:, 0], kind="stable")
    a, b = edges[order, 0], edges[order, 1]
    around = lambda r: np.bincount(a, r[b], minlength=n_cells)
    groups = colours(n_cells, edges)
    sd_beta, sd_rho = np.full(p, 1.0), np.full(n_cells, 1.0)
    took_beta, took_rho = np.zeros(p), np.zeros(n_cells)
    every = ADAPT_EVERY if s.burnin + s.mcmc >= 1000 else max(1, (s.burnin + s.mcmc) // 10)
    fixed = x @ beta
    ll = _terms(y, fixed + rho[cell])
    draws, kept, total = [], [], np.zeros(n_cells)
    for g in range(s.burnin + s.mcmc):
        for k in range(p):
            new = beta[k] + sd_beta[k] * rng.standard_normal()
            moved = fixed + (new - beta[k]) * x[:, k]
            ll_new = _terms(y, moved + rho[cell])
            gain = ll_new.sum() - ll.sum() - ((new - s.mubeta) ** 2 - (beta[k] - s.mubeta) ** 2) / (2 * s.vbeta)
            if np.log(rng.random()) < gain:
                beta[k], fixed, ll = new, moved, ll_new
                took_beta[k] += 1
        for members in groups:
            mean = around(rho)[members] / degree[members]
            var = v / degree[members]
            free = members[~seen[members]]
            held = seen[members]
            rho[free] = mean[~held] + np.sqrt(var[~held]) * rng.standard_normal(len(free))
            at = members[held]
            new = rho.copy()
            new[at] = rho[at] + sd_rho[at] * rng.standard_normal(len(at))
            ll_new = _terms(y, fixed + new[cell])
            gain = np.bincount(cell, ll_new - ll, minlength=n_cells)[at]
            m, w = mean[held], var[held]
            gain += ((rho[at] - m) ** 2 - (new[at] - m) ** 2) / (2 * w)
            yes = at[np.log(rng.random(len(at))) < gain]
            took_rho[yes] += 1
            rho[yes] = new[yes]
            ll = _terms(y, fixed + rho[cell])
        rho -= rho.mean()
        spread = float((rho * (degree * rho - around(rho))).sum())
        if s.prior_v > 0:
            v = s.prior_v
        elif s.prior_v == -1:
            v = (s.rate + 0.5 * spread) / rng.gamma(s.shape + 0.5 * (n_cells - 1))
        else:
            v = 1.0 / _truncated_gamma(rng, 0.5 * n_cells - 1, 0.5 * spread, 1.0 / s.v_max)
        ll = _terms(y, fixed + rho[cell])
        if g < s.burnin and (g + 1) % every == 0:
            for sd, took in ((sd_beta, took_beta), (sd_rho, took_rho)):
                share = took / every
                more = share >= WANTED_ACCEPTANCE
                sd[more] *= 2.0 - (1.0 - share[more]) / (1.0 - WANTED_ACCEPTANCE)
                sd[~more] /= 2.0 - share[~more] / WANTED_ACCEPTANCE
                took[:] = 0
        if g >= s.burnin and (g + 1) % s.thin == 0:
            draws.append([*beta, v, -2.0 * ll.sum()])
            total += rho
            if s.save_rho:
                kept.append(rho.copy())
    return np.array(draws), total / len(draws), np.array(kept)


@dataclass(frozen=True)
class IcarModel:
    """Posterior means for scoring, and the draws: ``mcmc`` (chain, draw, betas, Vrho, deviance), ``rho`` (cell, rho)."""

    design: formula.Design
    text: str
    betas: tuple[float, ...]
    mcmc: DataFrame
    rho: DataFrame

    def score(self, df: DataFrame, to: str = "p") -> DataFrame:
        """Probability from the cell's own effect; the effects are one row per spatial cell and broadcast."""
        effects = self.rho.select(F.col("cell").alias("__cell"), F.col("rho").alias("__rho"))
        joined = df.join(F.broadcast(effects), F.col(self.design.cell).cast("long") == F.col("__cell"), "left")
        z = self.design.linear(list(self.betas)) + F.coalesce("__rho", F.lit(0.0))
        return joined.withColumn(to, invlogit(z)).drop("__cell", "__rho")

    def summary(self) -> DataFrame:
        """Mean, deviation and central 95 % of each coefficient (b0, b1, ... in the order of the design), Vrho and deviance."""
        return aggregate.posterior_summary(self.mcmc, [*self.parameters(), "Vrho", "deviance"])

    def parameters(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.betas))]

    def to_json(self) -> str:
        """Formula and coefficients, enough to score with an effects table."""
        return json.dumps({"formula": self.text, "names": self.design.names, "betas": list(self.betas), "cell": self.design.cell})


def fit(text: str, data: DataFrame, neighbours: DataFrame, n_cells: int, settings: Settings = Settings(), seed: int = 1234, chains: int = 1) -> IcarModel:
    """Fit ``y + trials ~ terms + cell`` on the sample ``data`` with the directed edges ``neighbours`` (cell, neighbor).

    Rows with a null in any used column are dropped. Cells are numbered from 0 to n_cells - 1, and each needs a neighbour.
    """
    settings.check()
    spark = data.sparkSession
    ship(spark)
    design = formula.fit(text, data, with_cell=True)
    p = len(design.columns)
    rows = data.select(
        design.response.cast("double").alias("y"), F.col(design.cell).cast("long").alias("cell"), *[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(design.columns)]
    ).dropna()
    edges = neighbours.select("cell", "neighbor").toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    per_chain = rows.crossJoin(F.broadcast(spark.range(chains).select(F.col("id").cast("int").alias("chain"))))
    names = [f"b{i}" for i in range(p)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        pdf = pdf.sort_values([*pdf.columns])
        x = pdf[[f"x{i}" for i in range(p)]].to_numpy(float)
        draws, rho, _ = sample_chain(pdf["y"].to_numpy(float), x, pdf["cell"].to_numpy(np.int64), n_cells, edges, settings, seed + chain)
        a = pd.DataFrame(draws, columns=[*names, "Vrho", "deviance"]).assign(chain=chain, draw=range(len(draws)), cell=-1, rho=np.nan)
        b = pd.DataFrame({"cell": range(n_cells), "rho": rho}).assign(chain=chain, draw=-1, **dict.fromkeys([*names, "Vrho", "deviance"], np.nan))
        return pd.concat([a, b])[["chain", "draw", *names, "Vrho", "deviance", "cell", "rho"]]

    schema = "chain int, draw int, " + ", ".join(f"{n} double" for n in [*names, "Vrho", "deviance"]) + ", cell long, rho double"
    got = spark.createDataFrame(per_chain.groupBy("chain").applyInPandas(run, schema).toPandas(), schema)
    mcmc = got.filter("draw >= 0").select("chain", "draw", *names, "Vrho", "deviance")
    rho = got.filter("cell >= 0").groupBy("cell").agg(F.avg("rho").alias("rho"))
    means = mcmc.agg(*[F.avg(n) for n in names]).first()
    return IcarModel(design, text, tuple(means), mcmc, rho)
