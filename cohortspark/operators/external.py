"""The external cohort as a job on tables in minutes since unit admission: one row for each patient whose first stay qualifies.

Laboratory names are free text: each distinct name meets the patterns once, for the rules that clean its values and for the columns
that it counts to, and rows meet their name by a join. The cohort is stored once and cuts every fact table before it is grouped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import clean_by_rules, derived_ph, fio2, label3, parse_age, temp_c, tiered
from ..sources.tables import keep_table
from .events import _PICK, first_event, signed_slope, text_flags
from .joins import assemble, exists_in_window, semi
from .select import ilike_any, text_cohort

KEY = "patientunitstayid"

# Patterns, ranges and windows of the external tables.

PH, GAS_PH = (6.7, 7.8), (7.0, 8.0)
LAB_WINDOW, GAS_WINDOW, LATER_WINDOW = (-1440, 1440), (-360, 1440), (1440, 10080)
RULES: list[dict] = [
    {"patterns": ["%BUN%"], "lo": 1, "hi": 200},
    {"patterns": ["%creatinine%"], "passes": False, "step": {"divide": 88.4, "over": 30}, "lo": 0.1, "hi": 30},
    {"patterns": ["%hemoglobin%", "%Hgb%", "%total hemoglobin%"], "but": ["%A1c%"], "lo": 4, "hi": 25},
    {"patterns": ["%Hct%"], "lo": 12, "hi": 75},
    {"patterns": ["%pH%", "%arterial pH%"], "but": ["%urine%", "%fluid%"], "lo": 6.7, "hi": 7.8, "not_in": [7.0, 8.0]},
    {"patterns": ["%PTT%", "%Partial Thromboplastin Time%", "%aPTT%"], "lo": 10, "hi": 150},
    {"patterns": ["%PT%"], "but": ["%PTT%"], "lo": 5, "hi": 150},
    {"patterns": ["%INR%"], "lo": 0.5, "hi": 20},
    {"patterns": ["%lactate%", "%lactic acid%", "%lac%"], "lo": 0.1, "hi": 30},
    {"patterns": ["%RDW%"], "lo": 10, "hi": 35},
    {"patterns": ["%paCO2%"], "lo": 5, "hi": 150},
    {"patterns": ["%bicarb%", "%HCO3%"], "but": ["%total co2%"], "lo": 2, "hi": 60},
    {"patterns": ["%WBC%"], "lo": 0.1, "hi": 500},
    {"patterns": ["%albumin%"], "passes": False, "step": {"divide": 10.0, "over": 10, "lo": 1.0, "hi": 6.0}, "lo": 1.0, "hi": 6.0},
    {"patterns": ["%calcium%"], "but": ["%ion%"], "lo": 4, "hi": 15},
    {"patterns": ["%AST%"], "lo": 1, "hi": 2000},
    {"patterns": ["%ALT%"], "lo": 1, "hi": 2000},
    {"patterns": ["%platelet%"], "lo": 1, "hi": 1000},
    {"patterns": ["%anion gap%"], "lo": 2, "hi": 50},
    {"patterns": ["%total bilirubin%"], "passes": False, "step": {"divide": 17.1, "over": 10, "lo": 0.1, "hi": 70}, "lo": 0.1, "hi": 70},
    {"patterns": ["%glucose%"], "lo": 10, "hi": 2000},
    {"patterns": ["%alkaline phos%"], "lo": 5, "hi": 2500},
]
#: Analyte -> (patterns, but, what is taken of it).
ANALYTES: dict[str, tuple[list[str], list[str], str]] = {
    "lab_ph": (["%pH%"], [], "min max"), "lab_paco2": (["%paCO2%"], [], "avg"), "bicarbonate": (["%bicarb%", "%HCO3%"], [], "min max avg"), "creatinine": (["%creatinine%"], [], "min max"),
    "bun": (["%BUN%"], [], "min max"), "wbc": (["%WBC%"], [], "min max"), "rdw": (["%RDW%"], [], "max"), "hematocrit": (["%Hct%"], [], "min max"), "hemoglobin": (["%hemoglobin%", "%Hgb%"], [], "min max"),
    "platelets": (["%platelet%"], [], "min max"), "albumin": (["%albumin%"], [], "min max"), "bilirubin_total": (["%total bilirubin%"], [], "min max"), "ast": (["%AST%"], [], "max"), "alt": (["%ALT%"], [], "max"),
    "alp": (["%alkaline phos%"], [], "min max"), "ptt": (["%PTT%"], [], "min max"), "pt": (["%PT%"], ["%PTT%"], "min max"), "inr": (["%INR%"], [], "min max"), "glucose": (["%glucose%"], [], "min max"),
    "lactate": (["%lactate%"], [], "max"), "aniongap": (["%anion gap%"], [], "min max"),
}
TREATMENTS = {"vaso_flag": ["%vasopressor%", "%dopamine%", "%norepinephrine%", "%vasopressin%", "%epinephrine%"], "dialysis_treated": ["%dialysis%", "%CRRT%", "%hemofiltration%"], "vent_treated": ["%ventilation%", "%intubat%"]}
CARE_PLANS = ["%ventilat%", "%intubat%", "%ET tube%"]
TUMOURS = ["%malignant%", "%cancer%", "%metastas%"]


def within(df: DataFrame, offset: str, window: tuple[int, int]) -> DataFrame:
    return df.where(F.col(offset).between(*window))


def match_names(df: DataFrame, name: str, tests: Iterable[Column], out: str, most: int = 100_000) -> DataFrame:
    """df with `out`, an array of flags: the tests (columns over _name) that the row's name passes. Each distinct name is tried once; the
    names are broadcast where there are at most `most`. A null name has a null array."""
    distinct = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.lit(1).alias("_one"))
    names = keep_table(distinct.select("_name", F.array(*[F.coalesce(t, F.lit(False)) for t in tests]).alias(out)), "names")
    return df.join(F.broadcast(names) if names.count() <= most else names, F.col(name) == F.col("_name"), "left").drop("_name")


def lab_panel(lab: DataFrame, cohort: DataFrame) -> DataFrame:
    """(stay, <analyte>_<min|max|avg>) of the cleaned results in the window. A name may count to several analytes, as its pattern says."""
    rows = semi(within(lab.where(F.col("labresult").isNotNull()), "labresultoffset", LAB_WINDOW), cohort, KEY).select(KEY, "labname", "labresult")
    test = lambda patterns, but: ilike_any(F.col("_name"), patterns, but)
    known = match_names(rows, "labname", [*[test(r["patterns"], r.get("but", ())) for r in RULES], *[test(p, b) for p, b, _ in ANALYTES.values()]], "_on")
    clean = known.withColumn("_clean", clean_by_rules(F.col("labname"), F.col("labresult"), RULES, F.col("_on"))).where(F.col("_clean").isNotNull())
    taken = [(f"{a}_{how}", _PICK[how](F.when(F.col("_on")[len(RULES) + i], F.col("_clean")))) for i, (a, (_, _, hows)) in enumerate(ANALYTES.items()) for how in hows.split()]
    return clean.groupBy(KEY).agg(*[c.alias(n) for n, c in taken])


def base_cohort(t: dict[str, DataFrame], least_hours: float = 24, least_age: int = 18) -> DataFrame:
    """First stays of patients among those with the diagnosis; a patient whose first stay is too short or who is too young is out.
    Stays at one time go by their number."""
    ill = text_cohort(t["diagnosis"], "diagnosisstring", ["pancreatit"], ["chronic"], KEY)
    order = [F.asc("hospitaladmitoffset"), F.asc("unitadmitoffset"), F.asc(KEY)]
    first = first_event(semi(t["icustay_detail"], ill, KEY).withColumn("admission_age", parse_age(F.col("age"))), "uniquepid", order, having=(F.col("icu_los_hours") >= least_hours) & (F.col("admission_age") >= least_age))
    height, weight = F.col("admissionheight"), F.col("admissionweight")
    sized = first.withColumns({"height_admit": F.when(height.between(120, 250), height), "weight_admit": F.when(weight.between(30, 300), weight)})
    return sized.select(KEY, "uniquepid", "admission_age", "gender", "height_admit", "weight_admit", (F.col("icu_los_hours") / 24).alias("los"), "hosp_mort", (F.col("weight_admit") / F.pow(F.col("height_admit") / 100, F.lit(2))).alias("bmi"))


def _own_ph(c: str, lo: float) -> Column:
    return F.when(F.col(c).between(lo, PH[1]) & ~F.col(c).isin(*GAS_PH), F.col(c))


def oxygenation(gas: DataFrame, vital: DataFrame) -> DataFrame:
    """(stay, pao2fio2ratio_min): the least PaO2 / FiO2, or 0.9 times the least SpO2 / FiO2 where there is none. Gases are reduced to a row
    for each instant before the saturations meet them: the greatest share of oxygen gives the least ratio."""
    share = fio2(F.col("fio2"))
    pf = gas.where(F.col("pao2") > 0).groupBy(KEY).agg(F.min(F.col("pao2") / share).alias("_pf"))
    breathed = gas.groupBy(KEY, "chartoffset").agg(F.max(share).alias("_share"))
    sat = vital.where(F.col("spo2").between(50, 100)).join(breathed, [KEY, "chartoffset"], "left")
    sf = sat.groupBy(KEY).agg(F.min(F.col("spo2") / F.coalesce("_share", F.lit(0.21))).alias("_sf"))
    return pf.join(sf, KEY, "full").select(KEY, F.coalesce("_pf", F.col("_sf") * 0.9).alias("pao2fio2ratio_min"))


def vital_panel(vital: DataFrame) -> DataFrame:
    """Extremes of the vital signs; -1 stands for nothing, temperatures become Celsius."""
    own = lambda c: F.nullif(F.col(c), F.lit(-1))
    picked = {"heart_rate": own("heartrate"), "resp_rate": own("respiratoryrate"), "spo2": own("spo2"), "temp": temp_c(F.col("temperature"))}
    both = [f(c).alias(f"{n}_{e}") for n, c in picked.items() for e, f in (("max", F.max), ("min", F.min))]
    return vital.groupBy(KEY).agg(*both, F.min(own("nibp_mean")).alias("mbp_min"))


def external_cohort(t: dict[str, DataFrame]) -> DataFrame:
    """The whole table. pof is NULL, and the stay left out, where nothing fired and neither creatinine nor oxygenation is known.
    t: the tables by name; patient and apacheapsvar have one row for each stay."""
    cohort = keep_table(base_cohort(t), "cohort")
    of = lambda n, offset, window: semi(within(t[n], offset, window), cohort, KEY)
    gas, vital = of("pivoted_bg", "chartoffset", GAS_WINDOW), of("pivoted_vital", "chartoffset", GAS_WINDOW)
    co2 = F.when(F.col("paco2").between(5, 150), F.col("paco2"))
    gases = gas.groupBy(KEY).agg(F.min(_own_ph("ph", 6.7)).alias("bg_ph_min"), F.max(_own_ph("ph", 6.7)).alias("bg_ph_max"), F.avg(co2).alias("bg_paco2"))
    timed = vital.where(F.col("spo2").between(50, 100)).select(KEY, F.timestamp_seconds(F.col("chartoffset") * 60).alias("at"), "spo2")
    slope = signed_slope(timed, [KEY], "at", "spo2").withColumnRenamed("slope", "spo2_slope")
    treated = text_flags(of("treatment", "treatmentoffset", LATER_WINDOW), KEY, "treatmentstring", TREATMENTS)
    planned = exists_in_window(cohort.select(KEY), of("careplangeneral", "cplitemoffset", LATER_WINDOW), KEY, "_planned", ilike_any(F.col("cplitemvalue"), CARE_PLANS))
    aps = semi(t["apacheapsvar"], cohort, KEY).select(KEY, _own_ph("ph", 6.8).alias("aps_ph"), F.col("vent").alias("_vent"), F.col("dialysis").alias("_dialysis"))
    tumour = text_flags(semi(t["diagnosis"], cohort, KEY), KEY, "diagnosisstring", {"malignant_tumor": TUMOURS})
    known = cohort.join(t["patient"].select(KEY, "hospitaldischargeoffset"), KEY)
    x = assemble(known, [lab_panel(t["lab"], cohort), gases, slope, oxygenation(gas, vital), vital_panel(vital), treated, planned, aps, tumour], KEY, ["malignant_tumor", "vaso_flag"])
    x = x.withColumns({
        "ph_min": tiered([F.col("bg_ph_min"), F.col("lab_ph_min"), derived_ph(F.col("bicarbonate_avg"), F.coalesce("bg_paco2", "lab_paco2_avg")), F.col("aps_ph")], *PH),
        "ph_max": tiered([F.coalesce("bg_ph_max", "lab_ph_max", "bg_ph_min", "lab_ph_min")], *PH),
        "tbar": F.col("bilirubin_total_max") / F.greatest(F.col("albumin_min"), F.lit(1.0)),
        "mechanical_vent_flag": F.coalesce("_vent", F.when(F.col("_planned") == 1, 1), "vent_treated", F.lit(0)),
        "dialysis_flag": F.coalesce("dialysis_treated", "_dialysis", F.lit(0)),
        "mortality_28d": F.when((F.col("hosp_mort") == 1) & (F.col("hospitaldischargeoffset") <= 40320), 1).otherwise(0),
    })
    failed = [
        (F.col("vaso_flag") == 1) & (F.col("los") >= 1), (F.col("mechanical_vent_flag") == 1) & (F.col("los") >= 2), (F.col("pao2fio2ratio_min") < 300) & (F.col("los") >= 2),
        F.col("dialysis_flag") == 1, F.col("creatinine_max") > 1.9,
    ]
    seen = [F.col("creatinine_max"), F.col("pao2fio2ratio_min")]
    x = x.withColumns({"pof": label3(failed, seen), "composite_outcome": label3([*failed, F.col("mortality_28d") == 1], [*seen, F.col("mortality_28d")])})
    inner = ["_vent", "_planned", "_dialysis", "vent_treated", "dialysis_treated", "hospitaldischargeoffset", "hosp_mort", "bg_ph_min", "bg_ph_max", "bg_paco2", "aps_ph", "lab_ph_min", "lab_ph_max", "lab_paco2_avg", "bicarbonate_avg"]
    return x.where(F.col("pof").isNotNull()).drop(*inner)
