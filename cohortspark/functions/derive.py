"""Derived columns: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.select import ilike_any
from ..sources.tables import keep_table


def parse_age(text: Column) -> Column:
    """'> 89' is 90, digits are their number, all else (NULL too) is 0."""
    return F.when(text == "> 89", 90).when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(0)


def age_at(ts: Column, anchor_year: Column, anchor_age: Column) -> Column:
    return F.year(ts) - anchor_year + anchor_age


def bmi(weight_kg: Column, height_cm: Column, fallback_cm: Column | None = None, lo: float | None = None, hi: float | None = None) -> Column:
    """Weight by squared height in metres; a height that is missing or not positive falls back; NULL beyond lo..hi."""
    height = F.when(height_cm > 0, height_cm)
    if fallback_cm is not None:
        height = F.coalesce(height, F.when(fallback_cm > 0, fallback_cm))
    value = F.when((height > 0) & (weight_kg > 0), weight_kg / F.pow(height / 100, F.lit(2)))
    return value if lo is None else F.when(value.between(lo, hi), value)


def _matches(name: Column, rule: dict) -> Column:
    return ilike_any(name, rule["patterns"], rule.get("but", ()))


def clean_by_rules(name: Column, value: Column, rules: list[dict], matched: Column | None = None) -> Column:
    """The first rule whose patterns (and not `but`) match the name decides; NULL where no rule gives a value.

    A rule has any of: steps (divide, over, lo, hi): divided values that are over `over` and then within lo..hi; lo, hi: plain
    values within. A rule whose range doesn't fit passes a value on only if it has passes=True, as the ladder's plain rules do.
    matched: an array of flags, one for each rule, where names were held against the patterns before."""
    out = None
    for k, r in enumerate(rules):
        on = _matches(name, r) if matched is None else F.coalesce(matched[k], F.lit(False))
        plain = value.between(r["lo"], r["hi"])
        if r.get("not_in"):
            plain = plain & ~value.isin(*r["not_in"])
        if r.get("passes", True):
            cond, result = on & plain, value
        else:
            s = r["step"]
            divided = value / s["divide"]
            fits = (value > s["over"]) & (divided.between(s["lo"], s["hi"]) if "lo" in s else F.lit(True))
            cond, result = on, F.when(fits, divided).when(plain, value)
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out


def clean_by_names(df: DataFrame, name: str, value: str, rules: list[dict], out: str = "clean", most: int = 100_000) -> DataFrame:
    """df with column `out` of clean_by_rules(). Patterns meet each distinct name once; rows meet their name by a join, which is broadcast
    where there are at most `most` names and left to Spark beyond that. A null name matches no rule."""
    names = keep_table(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.lit(1).alias("_one")).select("_name", F.array(*[F.coalesce(_matches(F.col("_name"), r), F.lit(False)) for r in rules]).alias("_matched")), "names")
    known = F.broadcast(names) if names.count() <= most else names
    return df.join(known, F.col(name) == F.col("_name"), "left").withColumn(out, clean_by_rules(F.col(name), F.col(value), rules, F.col("_matched"))).drop("_name", "_matched")


def ratio(a: Column, b: Column, floor: float | None = None) -> Column:
    """a / b, NULL where b isn't positive; with floor, a / greatest(b, floor) and NULL only for NULL."""
    return F.when(b > 0, a / b) if floor is None else F.when(b.isNotNull(), a / F.greatest(b, F.lit(floor)))


def temp_c(t: Column) -> Column:
    """80 to 115 is Fahrenheit and converted, 30 to 45 is Celsius, all else NULL."""
    return F.when(t.between(80, 115), (t - 32) * 5 / 9).when(t.between(30, 45), t)


def fio2(x: Column, fractions: bool = False) -> Column:
    """Inspired oxygen as a fraction: NULL is 0.21, 21 and more is per cent, all else is 0.21 (or, with fractions, itself)."""
    base = F.when(x.isNull(), 0.21).when(x >= 21, x / 100)
    return (base.when(x.between(0.21, 1.0), x) if fractions else base).otherwise(0.21)


def pf_ratio(pao2: Column, fio2_raw: Column, spo2: Column) -> Column:
    """PaO2 / FiO2, or 0.9 * SpO2 / FiO2 where PaO2 is missing."""
    f = fio2(fio2_raw)
    return F.coalesce(pao2 / f, spo2 / f * 0.9)


def derived_ph(hco3: Column, pco2: Column) -> Column:
    """6.1 + log10(HCO3 / (0.0301 pCO2)) where both are positive."""
    return F.when((hco3 > 0) & (pco2 > 0), 6.1 + F.log10(hco3 / (0.0301 * pco2)))


def tiered(columns: Iterable[Column], lo: float, hi: float) -> Column:
    """The first of the columns that is within lo..hi."""
    return F.coalesce(*[F.when(c.between(lo, hi), c) for c in columns])


def label3(conditions: Iterable[Column], evidence: Iterable[Column]) -> Column:
    """1 if any condition holds, else NULL if all evidence is NULL, else 0."""
    hit = reduce(lambda a, b: a | b, conditions)
    none = reduce(lambda a, b: a & b, [e.isNull() for e in evidence])
    return F.when(hit, 1).when(none, F.lit(None).cast("int")).otherwise(0)


def died_within(anchor: Column, death: Column, lo: str, hi: str) -> Column:
    """1 if death is between anchor + lo and anchor + hi (intervals, both ends included), else 0; no death is 0."""
    return F.when(death.between(anchor + F.expr(f"interval '{lo}'"), anchor + F.expr(f"interval '{hi}'")), 1).otherwise(0)


def override_labels(df: DataFrame, early: str, outcome: str, mortality: str, composite: str) -> DataFrame:
    """Early death makes outcome and mortality 1; composite is either of them."""
    is_early = F.coalesce(F.col(early) == 1, F.lit(False))
    out = df.withColumns({c: F.when(is_early, 1).otherwise(F.col(c)) for c in (outcome, mortality)})
    either = F.coalesce(F.col(outcome) == 1, F.lit(False)) | F.coalesce(F.col(mortality) == 1, F.lit(False))
    return out.withColumn(composite, either.cast("int"))


def subgroup(value: Column, below: float, comorbidity: Column | None = None) -> Column:
    """1 if the value is under `below` (and the comorbidity is 0), else 0; NULL is 0."""
    cond = value < below
    return F.coalesce(cond if comorbidity is None else cond & (comorbidity == 0), F.lit(False)).cast("int")


def recode(df: DataFrame, column: str, mapping: dict[str, int], out: str) -> DataFrame:
    """Codes by the mapping; what isn't in it gets the most frequent code (the smallest of equally frequent ones)."""
    code = F.lit(None).cast("int")
    for k, v in mapping.items():
        code = F.when(F.lower(F.col(column)) == k.lower(), v).otherwise(code)
    coded = df.withColumn(out, code)
    mode = coded.where(F.col(out).isNotNull()).groupBy(out).count().orderBy(F.desc("count"), out).select(out).first()
    return coded.fillna({out: mode[0]}) if mode else coded


def log1p_floor(column: Column) -> Column:
    """log1p of the value, negative values counting as 0; NULL stays."""
    return F.when(column.isNotNull(), F.log1p(F.greatest(column.cast("double"), F.lit(0.0))))


def format_ci(estimate: Column, lo: Column, hi: Column, places: int = 3) -> Column:
    f = f"%.{places}f"
    return F.format_string(f"{f} ({f}-{f})", estimate, lo, hi)


def parse_ci(text: Column) -> Column:
    """struct(est, lo, hi): the first three numbers of the text."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), F.lit(1))
    return F.struct(*[F.try_element_at(found, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("est", "lo", "hi"))])


def share(column: Column, *by: str) -> Column:
    return column / F.sum(column).over(Window.partitionBy(*by))
