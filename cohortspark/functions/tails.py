"""Tail probabilities of test statistics; as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column, terms: int = 60, depth: int = 120) -> Column:
    """The complementary error function of x >= 0: one minus a series of positive terms, or a continued fraction from 2 on."""
    x2 = x * x
    first = F.struct(x.alias("term"), x.alias("total"))
    add = lambda s, k: F.struct((s["term"] * 2.0 * x2 / (2.0 * k + 1.0)).alias("term"), (s["total"] + s["term"] * 2.0 * x2 / (2.0 * k + 1.0)).alias("total"))
    series = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x2) * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, add)["total"]
    below = F.aggregate(F.sequence(F.lit(depth), F.lit(1)), x, lambda s, k: x + k / 2.0 / s)
    return F.when(x < 2, series).otherwise(F.exp(-x2) / math.sqrt(math.pi) / below)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X > x) of a chi-square variable of a whole number of degrees: that of one or two degrees and a term for each two more."""
    z, odd = F.greatest(x.cast("double"), F.lit(1e-300)) / 2, dof % 2 == 1
    a = F.when(odd, 0.5).otherwise(1.0)
    log = a * F.log(z) - z - F.when(odd, 0.5 * math.log(math.pi) - math.log(2)).otherwise(0.0)
    more = F.filter(F.sequence(F.lit(0), F.floor((dof - 1) / 2).cast("int")), lambda k: k > 0)
    first = F.struct(log.alias("log"), F.when(odd, erfc(F.sqrt(z))).otherwise(F.exp(-z)).alias("total"))
    add = lambda s, k: F.struct((s["log"] + F.log(z) - F.log(a + k)).alias("log"), (s["total"] + F.exp(s["log"])).alias("total"))
    tail = F.least(F.lit(1.0), F.aggregate(more, first, add)["total"])
    return F.when(x.isNull(), F.lit(None)).when((x <= 0) | (dof <= 0), 1.0).otherwise(tail)


def kolmogorov_tail(d: Column, n_a: Column, n_b: Column, terms: int = 40) -> Column:
    """Asymptotic P(D > d) of the two-sample statistic: 2 * sum of (-1)**(k-1) exp(-2 k**2 t**2), t = sqrt(n_a n_b / (n_a + n_b)) d."""
    t2 = n_a * n_b / (n_a + n_b) * d * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t2))
    return F.when(t2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def lattice_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) of the two-sample statistic of n and m values without ties, exactly: the share of the paths from (0, 0) to (n, m)
    that reach a point where the two curves are d apart. Diagonals of the lattice are taken one after the other; what
    leaves the band is added up, so that small chances keep their digits."""
    far = round(d * n * m)
    if far <= 0:
        return 1.0
    held, out, i = np.zeros(n + 1), 0.0, np.arange(n + 1)
    held[0] = 1.0
    for t in range(n + m):
        up = held * (n - i) / (n + m - t)
        right = held * np.maximum(m - (t - i), 0) / (n + m - t)
        held = right
        held[1:] += up[:-1]
        j = t + 1 - i
        beyond = (np.abs(i * m - j * n) >= far) & (j >= 0) & (j <= m)
        out += held[beyond].sum()
        held[beyond] = 0.0
    return min(1.0, float(out))


def exact_kolmogorov(d: Column, n_a: Column, n_b: Column) -> Column:
    """lattice_tail() of columns, for the few rows of a report; null where any of them is."""

    @F.pandas_udf("double")
    def tails(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, n, m in parts:
            yield pd.Series([lattice_tail(a, int(b), int(c)) if a == a and a is not None else None for a, b, c in zip(x, n, m, strict=True)], dtype="float64")

    return tails(d, n_a, n_b)
