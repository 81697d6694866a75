"""Unit conversions as a table of straight lines, and the registry of variables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Line(NamedTuple):
    """A conversion to the SI unit, (value + shift) * scale, which has a way back by itself."""

    scale: float = 1.0
    shift: float = 0.0

    def to_si(self, c: Column) -> Column:
        return (c + self.shift if self.shift else c) * self.scale

    def from_si(self, c: Column) -> Column:
        return c / self.scale - self.shift if self.shift else c / self.scale


#: Factors from the conventional unit to the SI unit.
FACTORS = {
    "phosphate_mgdl_to_mmol": 0.3229,
    "gdl_to_gl_multiply_10": 10.0,
    "bun_mgdl_to_mmol": 0.357,
    "creatinine_mgdl_to_umol": 88.4,
    "glucose_mgdl_to_mmol": 0.0555,
    "calcium_mgdl_to_mmol": 0.2495,
    "bilirubin_mgdl_to_umol": 17.1,
}
#: The conversions by name.
CONVERSIONS: Mapping[str, Line] = {
    **{name: Line(scale) for name, scale in FACTORS.items()},
    "fahrenheit_to_celsius": Line(5 / 9, -32.0),
    "wbc_to_si": Line(),
    "identity": Line(),
}


def with_conversion(table: Mapping[str, Line], name: str, line: Line) -> dict[str, Line]:
    """A new table that has one conversion more; the table given stays as it is. A line of scale 0 has no way back."""
    if name in table or not line.scale:
        raise ValueError(f"{name!r} stands in the table already, or has a scale of 0")
    return {**table, name: line}


def convert(column: Column, name: str | None, strict: bool = False, inverse: bool = False, table: Mapping[str, Line] = CONVERSIONS) -> Column:
    """The column in its SI unit, or from it (inverse). Without a name it stays; so it does, with a warning, for a name that the
    table lacks, which raises where strict."""
    line = Line() if name is None else table.get(name)
    if line is None and strict:
        raise KeyError(f"no conversion {name!r}")
    if line is None:
        warnings.warn(f"no conversion {name!r}; values are left as they are", stacklevel=2)
    if line in (None, Line()):
        return column
    return line.from_si(column) if inverse else line.to_si(column)


#: What a variable may say.
ROLES = ("feature", "outcome", "id", "group", "confounder")
IMPUTE = ("median", "mean", "mice", "constant_zero")
AGGREGATIONS = ("first", "last", "min", "max", "mean", "median", "slope", "trend", "count")


Bounds = tuple[float, float] | None


def _one_of(value: str | None, known: tuple[str, ...]) -> None:
    if value is not None and value not in known:
        raise ValueError(f"{value!r} is none of {known}")


def _in_order(bounds: Bounds) -> None:
    if bounds and bounds[0] > bounds[1]:
        raise ValueError(f"{bounds} are in the wrong order")


@dataclass(frozen=True)
class Use:
    """What a variable is for."""

    role: str = "feature"
    domain: str = "other"
    in_model: bool = True
    in_selection: bool = True

    def __post_init__(self) -> None:
        _one_of(self.role, ROLES)


@dataclass(frozen=True)
class Measure:
    """How a variable is measured: its units and plausible values in SI units, and how it is taken from a window of hours after an
    anchor, a column of the cohort (the job's own where it is None)."""

    unit: str | None = None
    unit_si: str | None = None
    convert: str | None = None
    plausible: Bounds = None
    how: str | None = None
    hours: float | None = None
    anchor: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.how, AGGREGATIONS)
        _in_order(self.plausible)


@dataclass(frozen=True)
class Prepare:
    """What is done to a variable before it is used."""

    bounds: Bounds = None
    impute: str | None = None
    log: bool = False
    zscore: bool = False

    def __post_init__(self) -> None:
        _one_of(self.impute, IMPUTE)
        _in_order(self.bounds)


@dataclass(frozen=True)
class Variable:
    name: str
    use: Use = field(default_factory=Use)
    measure: Measure = field(default_factory=Measure)
    prepare: Prepare = field(default_factory=Prepare)


Registry = dict[str, Variable]


def registry_of(*variables: Variable) -> Registry:
    out = {v.name: v for v in variables}
    if len(out) < len(variables):
        raise ValueError("two variables have one name")
    return out


_BOUNDS = "struct<lo:double,hi:double>"
REGISTRY_COLUMNS = f"""name string, use struct<role:string,domain:string,in_model:boolean,in_selection:boolean>,
    measure struct<unit:string,unit_si:string,convert:string,plausible:{_BOUNDS},how:string,hours:double>,
    prepare struct<bounds:{_BOUNDS},impute:string,log:boolean,zscore:boolean>"""


def registry_table(spark: SparkSession, registry: Registry) -> DataFrame:
    """A row for each variable, its parts as structs."""

    def plain(part: Use | Measure | Prepare) -> dict:
        return {k: tuple(map(float, x)) if isinstance(x, tuple) else float(x) if k == "hours" and x is not None else x for k, x in vars(part).items()}

    return spark.createDataFrame([(v.name, plain(v.use), plain(v.measure), plain(v.prepare)) for v in registry.values()], REGISTRY_COLUMNS)


def names(registry: Registry, role: str | None = "feature", where: Callable[[Variable], bool] = lambda v: True) -> list[str]:
    """Names of the variables of a role (None: of all) that a condition holds for, in the registry's order."""
    return [v.name for v in registry.values() if role in (None, v.use.role) and where(v)]


def route_by_role(df: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """The columns of each role that df has."""
    return {role: df.select(names(registry, role, lambda v: v.name in df.columns)) for role in ROLES}


def align_to_si(df: DataFrame, registry: Registry) -> DataFrame:
    """Every registered column that has a conversion, in SI units."""
    held = [v for v in registry.values() if v.measure.convert and v.name in df.columns]
    return df.withColumns({v.name: convert(F.col(v.name), v.measure.convert) for v in held})
