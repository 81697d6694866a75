"""The development cohort as a job on clinical tables with absolute times: one row for each patient's first stay that qualifies.

The cohort is stored once; every fact table is cut to it and to its window before anything is grouped, gives all its columns in one
aggregation, and meets the cohort as a block of one row for each key. Flags are reduced to keys, so that no two facts multiply."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import age_at, died_within, ratio
from ..sources.tables import keep_table
from .events import _PICK, daily_max, entity_median, first_event, hours, persistence, prefix_flags
from .joins import assemble, exists_in_window, semi


@dataclass(frozen=True)
class Panel:
    """What one fact table gives: its key, time, item and value columns, the window as SQL over the cohort's columns, and
    name -> (codes, how); how is min, max, avg, sum, count or slope ((max - min) an hour, see range_slope)."""

    key: str
    ts: str
    item: str | None
    value: str
    since: str
    until: str
    columns: dict[str, tuple[tuple[int, ...], str]]


def window_rows(fact: DataFrame, cohort: DataFrame, key: str, ts: str, since: str, until: str, closed: bool = True) -> DataFrame:
    """Rows of fact within the window of their cohort row; the key is unique in the cohort."""
    edges = cohort.select(key, F.expr(since).alias("_since"), F.expr(until).alias("_until"))
    before = F.col(ts) <= F.col("_until") if closed else F.col(ts) < F.col("_until")
    return fact.join(edges, key).where((F.col(ts) >= F.col("_since")) & before).drop("_since", "_until")


def panel(fact: DataFrame, cohort: DataFrame, p: Panel, least: int = 3, span: float = 0.5) -> DataFrame:
    """One row for each key that has values in the window, all columns from one aggregation."""
    rows = fact.where(F.col(p.value).isNotNull())
    if p.item is not None:
        rows = rows.where(F.col(p.item).isin(sorted({c for codes, _ in p.columns.values() for c in codes})))
    rows = window_rows(rows.select(p.key, p.ts, p.value, *([p.item] if p.item else [])), cohort, p.key, p.ts, p.since, p.until)

    def column(codes: tuple[int, ...], how: str) -> Column:
        on = lambda c: F.col(c) if p.item is None else F.when(F.col(p.item).isin(list(codes)), F.col(c))
        v, t = on(p.value), on(p.ts)
        if how != "slope":
            return _PICK[how](v)
        h = hours(F.max(t), F.min(t))
        return F.when((F.count(v) >= least) & (h > span), (F.max(v) - F.min(v)) / h)

    return rows.groupBy(p.key).agg(*[column(codes, how).alias(n) for n, (codes, how) in p.columns.items()])


# Code lists, item numbers, thresholds and column names of the clinical tables.

_SINCE, _UNTIL = "admittime - interval 6 hours", "intime + interval 24 hours"
_GLUCOSE = (50931, 50809, 52569)
LABS = Panel("hadm_id", "charttime", "itemid", "valuenum", _SINCE, _UNTIL, {
    "neutrophils_mean": ((51256, 52075), "avg"), "lymphocytes_mean": ((51244, 51133), "avg"), "d_dimer_max": ((50915, 51196, 52551), "max"),
    "fibrinogen_max": ((51214,), "max"), "ldh_max": ((50954,), "max"), "crp_max": ((50889,), "max"), "amylase_max": ((50867, 53087), "max"),
    "lipase_max": ((50956,), "max"), "glucose_lab_min": (_GLUCOSE, "min"), "glucose_lab_max": (_GLUCOSE, "max"), "glucose_slope": (_GLUCOSE, "slope"),
    "triglycerides_max": ((51000,), "max"), "total_cholesterol_min": ((50907,), "min"), "rdw_max": ((51277, 52172), "max"),
    "phosphate_min": ((50970,), "min"), "calcium_min": ((50893, 50808), "min"),
})
GASES = Panel("hadm_id", "charttime", None, "lactate", "intime", _UNTIL, {"lactate_min": ((), "min"), "lactate_max": ((), "max"), "lactate_slope": ((), "slope")})
VITALS = Panel("stay_id", "charttime", "itemid", "valuenum", "intime", _UNTIL, {"spo2_min": ((220277,), "min"), "spo2_max": ((220277,), "max"), "spo2_slope": ((220277,), "slope")})
COMORBIDITIES = {"heart_failure": ["428", "I50"], "chronic_kidney_disease": ["585", "N18"], "malignant_tumor": ["14", "15", "C"]}
FIRST_DAY_LABS = [f"{a}_{e}" for a in "wbc hematocrit hemoglobin platelets albumin aniongap bicarbonate bun calcium chloride creatinine glucose sodium potassium bilirubin_total inr pt ptt amylase alt ast alp".split() for e in ("min", "max")]
#: First-day columns whose names the panels use too.
RENAMED = {"calcium_min": "lab_calcium_min", "amylase_min": "lab_amylase_min", "amylase_max": "lab_amylase_max"}
FIRST_DAY_GASES = ["ph_min", "ph_max", "pao2fio2ratio_min", "pao2fio2ratio_max"]
SCORES = {"first_day_sofa": ("sofa", "sofa_score"), "apsiii": ("apsiii", "apsiii"), "sapsii": ("sapsii", "sapsii"), "oasis": ("oasis", "oasis"), "lods": ("lods", "lods")}


def _pancreatitis(version: Column, code: Column) -> Column:
    return ((version == 9) & (code == "5770")) | ((version == 10) & code.startswith("K85"))


@dataclass(frozen=True)
class Plan:
    """What a study fixes. diagnosis: (version, code) -> condition of the admissions that qualify."""

    diagnosis: object = _pancreatitis
    least_los: float = 1.0
    least_age: int = 18
    labs: Panel = LABS
    gases: Panel = GASES
    vitals: Panel = VITALS
    comorbidities: dict[str, list[str]] = field(default_factory=lambda: dict(COMORBIDITIES))
    organs: dict[str, str] = field(default_factory=lambda: {"resp": "respiration", "cv": "cardiovascular", "renal": "renal"})
    organ_score: float = 2.0
    organ_days: int = 2
    ventilated: tuple[str, ...] = ("InvasiveVent", "Tracheostomy")


def base_cohort(t: dict[str, DataFrame], plan: Plan) -> DataFrame:
    """First stays of patients among qualifying stays (los is looked at before ranking, age after it), with demographics. Stays at one
    time go by stay_id. A missing first-day height is the median of all of the patient's."""
    admissions = t["diagnoses_icd"].where(plan.diagnosis(F.col("icd_version"), F.col("icd_code"))).select("hadm_id").distinct()
    stays = semi(t["icustays"].where(F.col("los") >= plan.least_los), admissions, "hadm_id").select("subject_id", "hadm_id", "stay_id", "intime", "los")
    first = first_event(stays, "subject_id", [F.asc("intime"), F.asc("stay_id")])
    out = first.join(t["admissions"].select("hadm_id", "admittime", "dischtime", "deathtime"), "hadm_id").join(t["patients"].select("subject_id", "dod", "gender", "anchor_year", "anchor_age"), "subject_id")
    out = out.withColumn("admission_age", age_at(F.col("intime"), F.col("anchor_year"), F.col("anchor_age"))).where(F.col("admission_age") >= plan.least_age)
    heights = entity_median(semi(t["height"], out, "subject_id"), "subject_id", "height", "_usual")
    out = out.join(t["first_day_weight"].select("stay_id", F.col("weight").alias("weight_admit")), "stay_id", "left").join(t["first_day_height"].select("stay_id", F.col("height").alias("_own")), "stay_id", "left").join(heights, "subject_id", "left")
    out = out.withColumn("height_admit", F.coalesce("_own", "_usual"))
    out = out.withColumn("bmi", F.when(F.col("height_admit") > 0, F.col("weight_admit") / F.pow(F.col("height_admit") / 100, F.lit(2))))
    return out.select("subject_id", "hadm_id", "stay_id", "intime", "los", "admittime", "dischtime", "deathtime", "dod", "gender", "admission_age", "weight_admit", "height_admit", "bmi")


def outcomes(t: dict[str, DataFrame], cohort: DataFrame, plan: Plan) -> DataFrame:
    """(stay_id, <organ>_pof, pof, mortality_28d, early_death_24_48h, composite_outcome). Organ failure persists with the score on
    enough days from 24 hours to 7 days (that end open). A death is the time in hospital or else the date of death; for early
    death either counts."""
    scores = window_rows(t["sofa"], cohort, "stay_id", "starttime", "intime + interval 24 hours", "intime + interval 7 days", closed=False)
    daily = daily_max(scores, "stay_id", "starttime", {o: F.col(c) for o, c in plan.organs.items()})
    failed = persistence(daily, "stay_id", {o: plan.organ_score for o in plan.organs}, plan.organ_days, cohort)
    failed = failed.select("stay_id", *[F.col(f"persistent_{o}").alias(f"{o}_pof") for o in plan.organs], F.col("persistent_any").alias("pof"))
    start, dod = F.col("intime"), F.col("dod").cast("timestamp_ntz")
    early = F.greatest(*[died_within(start, d, "24 hours", "48 hours") for d in (F.col("deathtime"), dod)])
    dead = F.when(F.coalesce(F.col("deathtime"), dod) <= start + F.expr("interval 28 days"), 1).otherwise(0)
    died = cohort.select("stay_id", dead.alias("mortality_28d"), early.alias("early_death_24_48h"))
    return failed.join(died, "stay_id").withColumn("composite_outcome", F.greatest("pof", "mortality_28d"))


def clinical_cohort(t: dict[str, DataFrame], plan: Plan | None = None) -> DataFrame:
    """The whole table. t: the clinical tables by name; score and first-day tables have one row for each stay."""
    plan = plan or Plan()
    cohort = keep_table(base_cohort(t, plan), "cohort")
    first_day = lambda c: window_rows(t[c], cohort, "stay_id", "starttime", "intime", "intime + interval 24 hours")
    stays = cohort.select("stay_id")
    flags = [exists_in_window(stays, first_day("ventilation"), "stay_id", "mechanical_vent_flag", F.col("ventilation_status").isin(*plan.ventilated))]
    flags += [exists_in_window(stays, first_day("vasoactive_agent"), "stay_id", "vaso_flag")]
    blocks = [outcomes(t, cohort, plan), *[semi(t[n], cohort, "stay_id").select("stay_id", F.col(c).alias(out)) for n, (c, out) in SCORES.items()]]
    blocks += [semi(t["first_day_lab"], cohort, "stay_id").select("stay_id", *[F.col(c).alias(RENAMED.get(c, c)) for c in FIRST_DAY_LABS])]
    blocks += [panel(t["chartevents"], cohort, plan.vitals), semi(t["first_day_bg"], cohort, "stay_id").select("stay_id", *FIRST_DAY_GASES), *flags]
    by_stay = assemble(cohort, blocks, "stay_id", [])
    ill = prefix_flags(semi(t["diagnoses_icd"], cohort, "hadm_id"), "hadm_id", "icd_code", plan.comorbidities)
    wide = assemble(by_stay, [panel(t["labevents"], cohort, plan.labs), panel(t["bg"], cohort, plan.gases), ill], "hadm_id", list(plan.comorbidities))
    return wide.withColumns({
        "nlr": ratio(F.col("neutrophils_mean"), F.col("lymphocytes_mean")), "lar": ratio(F.col("lactate_max"), F.col("albumin_min")), "tbar": ratio(F.col("bilirubin_total_max"), F.col("albumin_min")),
    })
