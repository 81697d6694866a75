"""Cleaning, imputation and scaling, driven by specifications. Statistics of all columns come from one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import log1p_floor
from ..functions.units import Registry, align_to_si, convert, names
from ..sources.tables import keep_table
from .cumulative import placed
from .quantiles import exact_quantiles
from .select import align_space


def _stats(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """One pass: a value for each named aggregate."""
    return df.agg(*[c.alias(k) for k, c in columns.items()]).first().asDict() if columns else {}


def long_form(df: DataFrame, columns: dict[str, dict[str, Column]], key: str = "feature") -> DataFrame:
    """(feature, statistics...) from one aggregation: columns: feature -> statistic -> aggregate."""
    names = list(next(iter(columns.values())))
    wide = df.agg(*[F.struct(*[F.lit(f).alias(key), *[s[n].alias(n) for n in names]]).alias(f"f{i}") for i, (f, s) in enumerate(columns.items())])
    return wide.select(F.explode(F.array(*wide.columns)).alias("x")).select("x.*")


#: For `approximate`: exact quantiles by counts of ranges, in a few passes and without a buffer of a column.
RANGES = "ranges"


def column_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """(feature, q) of columns of numbers by selection; see exact_quantiles()."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "feature", "value")
    return exact_quantiles(long, ["feature"], "value", qs)


def _quantiles(df: DataFrame, columns: list[str], qs: list[float], approximate: int | str | None) -> dict[str, list[float] | None]:
    if not columns:
        return {}
    if approximate == RANGES:
        found = {r["feature"]: r["q"] for r in column_quantiles(df, columns, qs).collect()}  # one row for each column
        return {c: found[c] if c in found and found[c][0] is not None else None for c in columns}
    return _stats(df, {c: quantiles_of(c, qs, approximate) for c in columns})


def quantiles_of(c: str, qs: list[float], approximate: int | None = None) -> Column:
    """Interpolated quantiles as an array. They are exact and keep a count of each distinct value in one buffer, unless an accuracy
    of percentile_approx is given, for columns of more distinct values than a task can hold. (Functions that take `approximate`
    also take RANGES.)"""
    return F.percentile(c, F.array(*[F.lit(q) for q in qs])) if approximate is None else F.percentile_approx(F.col(c).cast("double"), qs, approximate)


def median_of(c: str, approximate: int | None = None) -> Column:
    return F.percentile(c, F.lit(0.5)) if approximate is None else F.percentile_approx(F.col(c).cast("double"), 0.5, approximate)


def repair_units(df: DataFrame, rules: dict[str, tuple[float, float]], share: float = 0.2, approximate: int | str | None = None) -> DataFrame:
    """rules: column -> (logical minimum, factor): a column whose median is under share * minimum is multiplied."""
    medians = _quantiles(df, list(rules), [0.5], approximate)
    low = {c: f for c, (m, f) in rules.items() if medians[c] is not None and medians[c][0] < share * m}
    return df.withColumns({c: F.col(c) * f for c, f in low.items()})


def hard_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(df with values beyond their bounds as NULL, (feature, removed))."""
    counts = long_form(df, {c: {"removed": F.count_if(~F.col(c).between(lo, hi))} for c, (lo, hi) in bounds.items()})
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()}), counts


def clamp(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in bounds.items()})


def winsorize(df: DataFrame, columns: list[str], lo: float = 0.01, hi: float = 0.99, exclude: tuple[str, ...] = (), approximate: int | str | None = None, keep_binary: bool = True) -> DataFrame:
    """Columns clipped to their quantiles (exact and interpolated, or percentile_approx of an accuracy). Columns of two values
    at most are left alone unless keep_binary is False: clipping would erase rare flags."""
    used = [c for c in columns if c not in exclude]
    kinds = {f"r_{c}": F.approx_count_distinct(c) for c in used} if keep_binary else {}
    if approximate == RANGES:
        found = _stats(df, kinds) | {f"q_{c}": q for c, q in _quantiles(df, used, [lo, hi], RANGES).items()}
    else:
        found = _stats(df, {f"q_{c}": quantiles_of(c, [lo, hi], approximate) for c in used} | kinds)
    clipped = {c: found[f"q_{c}"] for c in used if found[f"q_{c}"] and not (keep_binary and found[f"r_{c}"] <= 2)}
    return clamp(df, {c: (float(a), float(b)) for c, (a, b) in clipped.items()})


DIRECTIONS = ("forward", "inverse")


def _inverse(direction: str) -> bool:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    return direction == "inverse"


def infer_units(df: DataFrame, registry: Registry, delta: float = 0.3, least: float = 0.7, direction: str = "forward") -> DataFrame:
    """(feature, inferred_unit, p_raw, p_inv, delta_p, confidence): whether values or converted values fit the reference range.

    direction: values in question are converted by the factor to SI units (forward), or by the way back (inverse). confidence is
    high where one of the two fits clearly, else medium."""
    back = _inverse(direction)
    named = {n: registry[n] for n in names(registry) if n in df.columns and registry[n].measure.convert and registry[n].measure.plausible}
    shares = {n: {"p_raw": F.avg(F.col(n).between(*s.measure.plausible).cast("int")), "p_inv": F.avg(convert(F.col(n), s.measure.convert, inverse=back).between(*s.measure.plausible).cast("int"))} for n, s in named.items()}
    table = long_form(df, shares).withColumn("delta_p", F.col("p_inv") - F.col("p_raw"))
    kind = F.when((F.col("delta_p") >= delta) & (F.col("p_inv") >= least), "unit_si").when((F.col("delta_p") <= -delta) & (F.col("p_raw") >= least), "unit").otherwise("ambiguous")
    table = table.withColumn("inferred_unit", kind)
    return table.withColumn("confidence", F.when(F.col("inferred_unit") == "ambiguous", "medium").otherwise("high"))


def patch_units(df: DataFrame, registry: Registry, inferred: dict[str, str], direction: str = "forward") -> tuple[DataFrame, DataFrame]:
    """(df, (feature, global_converted, inverse_patched, forward_patched)).

    A column inferred as unit_si is converted; then a value out of range that conversion brings into range is converted. The
    second compensation after a global conversion finds nothing that the first left, so that forward_patched is 0. direction is that
    of infer_units()."""
    fixed, audit, back = {}, {}, _inverse(direction)
    for n, kind in inferred.items():
        s = registry[n]
        if not (s.measure.convert and s.measure.plausible):
            continue
        x = convert(F.col(n), s.measure.convert, inverse=back) if kind == "unit_si" else F.col(n)
        again = convert(x, s.measure.convert, inverse=back)
        fixable = ~x.between(*s.measure.plausible) & again.between(*s.measure.plausible)
        fixed[n] = F.when(fixable, again).otherwise(x)
        audit[n] = {"global_converted": F.max(F.lit(int(kind == "unit_si"))), "inverse_patched": F.count_if(fixable), "forward_patched": F.max(F.lit(0))}
    return df.withColumns(fixed), long_form(df, audit)


def plausibility_audit(df: DataFrame, ranges: dict[str, tuple[float, float]], least: float = 0.8, approximate: int | str | None = None) -> DataFrame:
    """(feature, in_range, p5, p50, p95, implausible)."""
    q = lambda c, p: F.try_element_at(quantiles_of(c, [p], approximate), F.lit(1))
    share = lambda c: F.avg(F.col(c).between(*ranges[c]).cast("int"))
    if approximate == RANGES:
        df = keep_table(df.select(*ranges), "audited")  # each pass reads it
        found = column_quantiles(df, list(ranges), [0.05, 0.5, 0.95])
        own = long_form(df, {c: {"in_range": share(c)} for c in ranges}).join(found, "feature")
        out = own.select("feature", "in_range", *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))])
        return out.withColumn("implausible", (F.col("in_range") < least).cast("int"))
    stats = {c: {"in_range": share(c), "p5": q(c, 0.05), "p50": q(c, 0.5), "p95": q(c, 0.95)} for c in ranges}
    return long_form(df, stats).withColumn("implausible", (F.col("in_range") < least).cast("int"))


def cleaning_report(registry_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each registered feature with what was decided and counted for it: final_unit is that of a table in SI units."""
    joined = registry_rows.join(decisions.withColumnRenamed("feature", "name"), "name", "left")
    unit = F.coalesce("inferred_unit", F.lit("unit"))
    return joined.select(
        F.col("name").alias("feature"), F.col("use.role").alias("role"), unit.alias("inferred_unit"), F.when(unit == "unit_si", "converted").otherwise("kept").alias("action"),
        F.coalesce("inverse_patched", F.lit(0)).alias("patched"), F.coalesce("removed", F.lit(0)).alias("removed"), F.col("prepare.bounds").isNotNull().cast("int").alias("hard_clip"), F.col("prepare.log").cast("int").alias("log"),
        F.col("prepare.zscore").cast("int").alias("z"), F.coalesce("prepare.impute", F.lit("median")).alias("impute"), F.when(F.col("measure.convert").isNotNull(), F.col("measure.unit_si")).otherwise(F.col("measure.unit")).alias("final_unit"),
    )


def fit_imputer(df: DataFrame, methods: dict[str, str], approximate: int | str | None = None) -> dict[str, float]:
    """Fill values from one pass: median, mean or constant_zero for each column; a column without values gets 0."""
    made = {"median": lambda c: median_of(c, approximate), "mean": F.avg, "constant_zero": lambda c: F.lit(0.0)}
    if unknown := set(methods.values()) - set(made):
        raise ValueError(f"no simple imputation: {sorted(unknown)}")
    ranged = [c for c, m in methods.items() if m == "median"] if approximate == RANGES else []
    found = _stats(df, {c: F.max(F.lit(0.0)) if m == "constant_zero" else made[m](c) for c, m in methods.items() if c not in ranged})
    found |= {c: q and q[0] for c, q in _quantiles(df, ranged, [0.5], RANGES).items()}
    return {c: float(v or 0.0) for c, v in found.items()}


def apply_imputer(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


@dataclass
class Mice:
    """Chained equations: column -> (intercept, weights of the other columns), and what starts each column."""

    columns: list[str]
    start: dict[str, float]
    equations: dict[str, tuple[float, list[float]]] = field(default_factory=dict)
    sweeps: int = 0


def _mice_columns(m: Mice, filled: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for c, (b, ws) in m.equations.items():
        predicted = F.lit(b)
        for o, w in zip(m.columns, ws, strict=True):
            if o != c and w:
                predicted = predicted + filled[o] * w
        out[c] = predicted
    return out


def _filled(df: DataFrame, m: Mice, rounds: int) -> DataFrame:
    """df with columns c filled: started, then `rounds` times predicted from all columns of the round before."""
    names = {c: f"_x_{c}" for c in m.columns}
    out = df.withColumns({names[c]: F.coalesce(F.col(c).cast("double"), F.lit(m.start[c])) for c in m.columns})
    for _ in range(rounds):
        new = _mice_columns(m, {c: F.col(names[c]) for c in m.columns})
        out = out.withColumns({names[c]: F.coalesce(F.col(c).cast("double"), new[c]) for c in new})
    return out


def bayesian_ridge(gram: np.ndarray, target: np.ndarray, target2: float, steps: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """(intercept, weights) of a linear model whose weights and noise have precisions with flat gamma priors, at the greatest evidence.

    gram: products of (1, x) with itself, target: with y, target2: of y with itself; nothing else of the rows is needed. The precisions
    are moved to their fixed point in the basis where the centred Gram matrix is diagonal."""
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:] / n, target[0] / n
    xx, xy, yy = gram[1:, 1:] - n * np.outer(mean, mean), target[1:] - n * mean * y_mean, max(target2 - n * y_mean**2, 0.0)
    values, basis = np.linalg.eigh(xx)
    values, side = np.maximum(values, 0.0), basis.T @ xy
    noise, weight, old = n / (yy + 1e-12 * n), 1.0, None
    for _ in range(steps):
        inner = side / (values + weight / noise)
        wrong = max(yy - 2 * inner @ side + inner @ (values * inner), 0.0)
        known = (noise * values / (weight + noise * values)).sum()
        weight = (known + 2 * prior) / (inner @ inner + 2 * prior)
        noise = (n - known + 2 * prior) / (wrong + 2 * prior)
        coef = basis @ inner
        if old is not None and np.abs(coef - old).sum() < tolerance:
            break
        old = coef
    coef = basis @ (side / (values + weight / noise))
    return np.append(y_mean - mean @ coef, coef)


def fit_mice(df: DataFrame, columns: list[str], sweeps: int = 15, tolerance: float = 1e-3, ridge: float | None = None, rounds: int = 3) -> Mice:
    """Linear chained equations of at most a hundred columns, all refitted from the state of the sweep before.

    A sweep is one pass: tasks add up, for each column, the products of the rows where it is known; the driver solves one
    small system for each: a Bayesian ridge, or one of a fixed relative `ridge`. It ends when no weight moves by the tolerance. Filling replays `rounds` predictions. The columns are
    kept in memory and on disk from the first pass on."""
    p = len(columns)
    df = df.select(*columns).persist()
    m = Mice(columns, fit_imputer(df, {c: "mean" for c in columns}))
    known = [f"_k_{i}" for i in range(p)]
    for sweep in range(sweeps):
        state = _filled(df, m, min(sweep, rounds) if m.equations else 0)
        rows = state.select(*[F.col(f"_x_{c}").alias(f"x{i}") for i, c in enumerate(columns)], *[F.col(c).isNotNull().alias(k) for c, k in zip(columns, known, strict=True)])

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((p, p + 1, p + 1))
            for pdf in batches:
                x = np.column_stack([np.ones(len(pdf)), pdf[[f"x{i}" for i in range(p)]].to_numpy(float)])
                for i in range(p):
                    k = x[pdf[known[i]].to_numpy(bool)]
                    total[i] += k.T @ k
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

        sums = rows.mapInPandas(gram, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        g = np.zeros(p * (p + 1) * (p + 1))
        for r in sums:
            g[r["place"]] = r["value"]
        g, moved = g.reshape(p, p + 1, p + 1), 0.0
        for i, c in enumerate(columns):
            use = [j for j in range(p + 1) if j != i + 1]
            a, y = g[i][np.ix_(use, use)], g[i][use, i + 1]
            if ridge is not None:
                w = np.linalg.solve(a + ridge * np.diag(np.append(0.0, np.diag(a)[1:]) + 1e-9), y)
            else:
                w = bayesian_ridge(a, y, g[i][i + 1, i + 1]) if a[0, 0] else np.zeros(p)
            full = np.zeros(p + 1)
            full[use] = w
            old = np.array([m.equations[c][0], *m.equations[c][1]]) if c in m.equations else np.zeros(p + 1)
            moved = max(moved, float(np.abs(full - old).max() / max(1.0, np.abs(full).max())))
            m.equations[c] = float(full[0]), [float(v) for v in full[1:]]
        m.sweeps = sweep + 1
        if moved < tolerance:
            break
    df.unpersist()
    return m


def apply_mice(df: DataFrame, m: Mice, rounds: int = 3) -> DataFrame:
    out = _filled(df, m, rounds)
    return out.withColumns({c: F.col(f"_x_{c}") for c in m.columns}).drop(*[f"_x_{c}" for c in m.columns])


def fit_scaler(df: DataFrame, columns: list[str], ddof: int = 0) -> dict[str, tuple[float, float]]:
    """column -> (mean, standard deviation), from one pass; a deviation of 0 or NULL counts as 1."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    found = _stats(df, {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": std(c) for c in columns})
    return {c: (float(found[f"m_{c}"] or 0.0), float(found[f"s_{c}"] or 1.0)) for c in columns}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def hash_number(*columns: Column, salt: str = "") -> Column:
    """A number in [0, 1) from 32 bits of md5; the same in any SQL engine."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_split(df: DataFrame, y: str, key: str, fraction: float = 0.8, salt: str = "42", exact: bool = True) -> DataFrame:
    """is_train 0/1: of each outcome round(fraction * n) rows in the order of a hash (exact), or the rows whose hash is under
    the fraction, in one pass without a shuffle."""
    h = hash_number(F.col(key), salt=salt)
    if not exact:
        return df.withColumn("is_train", (h < fraction).cast("int"))
    is_train = (F.col("_place") <= F.round(F.col("_size") * fraction)).cast("int")
    return placed(df, y, h, key).withColumn("is_train", is_train).drop("_place", "_size")


def bifurcate(df: DataFrame, registry: Registry, outcome: str, key: str, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(report branch, model branch).

    Report: features, confounders, outcomes and groups; features in SI units, nothing imputed. Model: the key, features and
    confounders that models may use, the outcome and is_train; rows without an outcome are left out."""
    held = [s for s in registry.values() if s.name in df.columns]
    shown = [s.name for s in held if s.use.role in ("feature", "confounder", "outcome", "group")]
    used = [s.name for s in held if s.use.role in ("feature", "confounder") and s.use.in_model]
    features = {s.name: s for s in held if s.use.role == "feature"}
    model = stratified_split(df.select(key, *used, outcome).where(F.col(outcome).isNotNull()), outcome, key, fraction)
    return align_to_si(df.select(shown), features), model


@dataclass
class Assets:
    """What a cohort's preparation leaves for others: logs, order, fill values (or equations) and scales."""

    order: list[str]
    logs: list[str]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    mice: Mice | None = None

    def table(self, spark) -> DataFrame:
        """A row for each feature, with its equation where there are some: what assets_of() reads."""
        m = self.mice
        equation = lambda c: (None, None, None, None) if m is None else (m.start[c], *m.equations.get(c, (None, None)), m.sweeps)
        rows = [(c, i, c in self.logs, self.fill.get(c), *self.scale[c], *equation(c)) for i, c in enumerate(self.order)]
        return spark.createDataFrame(rows, ASSET_COLUMNS)

    def save(self, spark, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


ASSET_COLUMNS = "feature string, position int, is_log boolean, median double, mean double, std double, start double, intercept double, weights array<double>, sweeps int"


def load_assets(spark, path: str) -> Assets:
    """What Assets.save() wrote; one row for each feature."""
    return assets_of(spark.read.schema(ASSET_COLUMNS).parquet(path))


def assets_of(table: DataFrame) -> Assets:
    rows = table.orderBy("position").collect()
    order = [r["feature"] for r in rows]
    mice = None
    if any(r["start"] is not None for r in rows):
        equations = {r["feature"]: (r["intercept"], list(r["weights"])) for r in rows if r["weights"] is not None}
        mice = Mice(order, {r["feature"]: r["start"] for r in rows}, equations, rows[0]["sweeps"])
    fill = {r["feature"]: r["median"] for r in rows if r["median"] is not None}
    return Assets(order, [r["feature"] for r in rows if r["is_log"]], fill, {r["feature"]: (r["mean"], r["std"]) for r in rows}, mice)


def fit_assets(df: DataFrame, features: list[str], logs: list[str], mice: bool = False, approximate: int | str | None = None) -> Assets:
    logged = keep_table(align_space(df, features).withColumns({c: log1p_floor(F.col(c)) for c in logs}), "logged")  # each pass reads it
    if mice:
        m = fit_mice(logged, features)
        return Assets(features, logs, {}, fit_scaler(apply_mice(logged, m), features), m)
    fill = fit_imputer(logged, {c: "median" for c in features}, approximate)
    return Assets(features, logs, fill, fit_scaler(apply_imputer(logged, fill), features))


def replay(df: DataFrame, assets: Assets, keep: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """Another cohort in the frozen space: order, logs, fill, scale; protected columns keep their own values."""
    out = align_space(df, assets.order, keep=keep + [F.col(c).alias(f"_own_{c}") for c in protected]).withColumns({c: log1p_floor(F.col(c)) for c in assets.logs})
    out = apply_mice(out, assets.mice) if assets.mice else apply_imputer(out, assets.fill)
    out = apply_scaler(out, assets.scale)
    return out.withColumns({c: F.col(f"_own_{c}") for c in protected}).drop(*[f"_own_{c}" for c in protected])
