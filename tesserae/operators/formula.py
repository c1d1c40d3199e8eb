"""Model formulas as columns: intercept, I(), scale(), C(), a two-column left side, a trailing cell column.

``fit`` learns what a term needs (mean and deviation, levels) from the data; the fitted design turns any DataFrame into
the same design columns, so scoring a map is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions that may be called in a formula; callers can register their own.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}

_CALL = re.compile(r"^([A-Za-z_]\w*)\((.*)\)$")


def register(name: str, function: Callable[[Column], Column]) -> None:
    FUNCTIONS[name] = function


def _split(text: str, sep: str = "+") -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == sep and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [t.strip() for t in [*out, text[last:]] if t.strip()]


def expression(term: str, functions: Mapping[str, Callable[[Column], Column]] = FUNCTIONS) -> Column:
    """A term without learnt state: a name, I(expression), or a registered function of one."""
    m = _CALL.match(term)
    if m and m[1] == "I":
        return F.expr(m[2])
    if m and m[1] in functions:
        return functions[m[1]](expression(m[2].strip(), functions))
    return F.expr(term)


@dataclass(frozen=True)
class Design:
    """A fitted formula. ``columns`` are (name, column) in order; ``response`` and ``trials`` belong to the left side."""

    response: Column
    trials: Column | None
    columns: tuple[tuple[str, Column], ...]
    cell: str | None

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def matrix(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``keep`` and one double column per design column (named x0, x1, ...)."""
        return df.select(*keep, *[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(self.columns)])

    def linear(self, betas: list[float]) -> Column:
        """The linear predictor as one expression."""
        out = F.lit(0.0)
        for b, (_, c) in zip(betas, self.columns, strict=True):
            out = out + F.lit(float(b)) * c.cast("double")
        return out


def fit(formula: str, data: DataFrame, with_cell: bool = False, functions: Mapping[str, Callable[[Column], Column]] = FUNCTIONS) -> Design:
    """Compile ``y [+ trials] ~ terms`` on ``data`` (rows with nulls should be dropped before).

    An intercept comes first unless ``- 1`` removes it. ``scale(x)`` uses the mean and population deviation of ``data``;
    ``C(x)`` gives a column per level but the first, in sorted order. With ``with_cell`` the last right-hand name is the cell.
    """
    left, right = formula.split("~")
    sides = _split(left)
    intercept = not re.search(r"-\s*1\s*$", right.strip())
    terms = _split(re.sub(r"-\s*1\s*$", "", right.strip()))
    cell = terms.pop() if with_cell else None
    columns: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))] if intercept else []
    for term in terms:
        m = _CALL.match(term)
        if m and m[1] == "scale":
            x = expression(m[2].strip(), functions).cast("double")
            row = data.agg(F.avg(x), F.stddev_pop(x)).first()
            columns.append((term, (x - F.lit(row[0])) / F.lit(row[1] or 1.0)))
        elif m and m[1] == "C":
            x = F.col(m[2].strip())
            levels = sorted(r[0] for r in data.select(x).distinct().collect() if r[0] is not None)
            columns += [(f"C({m[2].strip()})[T.{v}]", F.when(x == F.lit(v), 1.0).otherwise(0.0)) for v in levels[1:]]
        else:
            columns.append((term, expression(term, functions)))
    return Design(expression(sides[0], functions), expression(sides[1], functions) if len(sides) > 1 else None, tuple(columns), cell)
