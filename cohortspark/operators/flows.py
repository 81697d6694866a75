"""Cleaning as jobs made of the operators: one wide table from its registry, and another cohort's for the models that are there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import log1p_floor
from ..functions.units import Registry, registry_table
from ..sources.tables import keep_table
from .cleaning import Assets, Mice, apply_imputer, apply_mice, apply_scaler, bifurcate, cleaning_report, fit_imputer, fit_mice, fit_scaler, hard_bounds, infer_units, long_form, patch_units, repair_units, replay, winsorize


@dataclass
class Cleaned:
    """report: the branch for tables in SI units; model: key, prepared columns, outcome and is_train; decisions: a row for each
    registered feature; fill, scale and mice: what was fitted on the training rows."""

    report: DataFrame
    model: DataFrame
    decisions: DataFrame
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    mice: Mice | None


def clean_cohort(df: DataFrame, registry: Registry, outcome: str, key: str, fraction: float = 0.8, scale_logged: bool = False) -> Cleaned:
    """Units are inferred and patched, values beyond hard bounds removed, the branches parted; then the model branch is imputed,
    logged and scaled with what its training rows say.

    Scales are fitted before the logarithm, as the cohort scripts do; with scale_logged after it. Statistics are sample ones.
    Each step is one aggregate or a projection; the table itself is never sorted or collected. It is stored first and the model branch
    after the split, since every step reads them."""
    df = keep_table(df, "cohort")
    inferred = infer_units(df, registry)
    kinds = {r["feature"]: r["inferred_unit"] for r in inferred.collect()}  # one row for each feature
    patched, audit = patch_units(df, registry, kinds)
    bounded, removed = hard_bounds(patched, {n: s.prepare.bounds for n, s in registry.items() if s.prepare.bounds and n in df.columns})
    report, model = bifurcate(bounded, registry, outcome, key, fraction)
    model = keep_table(model, "model")
    held = [s for s in registry.values() if s.name in model.columns and s.name != outcome]
    train = model.where("is_train = 1")
    simple = {s.name: s.prepare.impute for s in held if s.use.role in ("feature", "confounder") and s.prepare.impute and s.prepare.impute != "mice"}
    fill, chained = fit_imputer(train, simple), [s.name for s in held if s.prepare.impute == "mice"]
    model, train, mice = apply_imputer(model, fill), apply_imputer(train, fill), None
    if chained:
        mice = fit_mice(train, chained)
        model, train = apply_mice(model, mice), apply_mice(train, mice)
    scaled = [s.name for s in held if s.use.role == "feature" and s.prepare.zscore]
    logs = {s.name: log1p_floor(F.col(s.name)) for s in held if s.use.role == "feature" and s.prepare.log}
    scale = fit_scaler(train.withColumns(logs) if scale_logged else train, scaled, ddof=1)
    model = apply_scaler(model.withColumns(logs), scale)
    decisions = removed.join(inferred.select("feature", "inferred_unit"), "feature", "full").join(audit.select("feature", "inverse_patched"), "feature", "full")
    return Cleaned(report, model, cleaning_report(registry_table(df.sparkSession, registry), decisions), fill, scale, mice)


@dataclass(frozen=True)
class Limits:
    """What is logical for a feature, and the factor that mends a column in another unit."""

    lo: float | None = None
    hi: float | None = None
    factor: float = 1.0


@dataclass
class Prepared:
    """audited: the other cohort in its own units; removed: (feature, removed); tables: outcome -> key, its selected features in the frozen
    space and the protected columns; spread: (feature, mean, std) in that space, which should be near 0 and 1."""

    audited: DataFrame
    removed: DataFrame
    spread: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def prepare_external(df: DataFrame, limits: dict[str, Limits], selection: DataFrame, assets: Assets, key: str, protected: list[str], renames: dict[str, str] | None = None, flags: dict[str, Column] | None = None, approximate: int | str | None = None) -> Prepared:
    """Another cohort made ready for the models of the first: renamed, cut to the features that some outcome selected and that have
    limits, units mended by the median, values beyond the limits removed, the rest clipped to their 1 to 99 %, then put through the
    frozen logarithms, fills and scales.

    selection: what read_selection() gives. flags: columns made before anything is cleaned, NULL counting as 0; they and `protected`
    keep their own values as integers (0 for NULL) and are never clipped. A feature that the cohort lacks is filled like a missing
    value; a selected feature that the frozen space lacks is left out. Statistics cost two passes over the rows, which are stored first."""
    chosen: dict[str, list[str]] = {}
    for r in selection.select("outcome", "place", "feature").orderBy("outcome", "place").collect():  # outcomes x features
        chosen.setdefault(r["outcome"], []).append(r["feature"])
    out = df.withColumnsRenamed(renames or {}).withColumns({n: F.coalesce(c.cast("int"), F.lit(0)) for n, c in (flags or {}).items()})
    own = [c for c in [*protected, *(flags or {})] if c in out.columns]
    wanted = {f for fs in chosen.values() for f in fs}
    used = [f for f in limits if f in wanted and f in out.columns and f not in own and f != key]
    out = keep_table(out.select(key, *used, *own), "external")
    out = repair_units(out, {f: (limits[f].lo, limits[f].factor) for f in used if limits[f].lo is not None and limits[f].factor != 1.0}, approximate=approximate)
    bounds = {f: (limits[f].lo, limits[f].hi) for f in used if limits[f].lo is not None and limits[f].hi is not None}
    removed = df.sparkSession.createDataFrame([], "feature string, removed long")
    if bounds:
        out, removed = hard_bounds(out, bounds)
    audited = winsorize(out, used, keep_binary=False, approximate=approximate)
    frozen = replay(audited, assets, [key, *own]).withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in own})
    spread = long_form(frozen, {c: {"mean": F.avg(c), "std": F.stddev_samp(c)} for c in assets.order})
    return Prepared(audited, removed, spread, {o: frozen.select(key, *[f for f in fs if f in assets.order], *own) for o, fs in chosen.items()})
