"""The external cohort on literal rows: who is in, how names and units are read, and the outcomes."""

from __future__ import annotations

import math

import pytest

from cohortspark.operators import external

STAYS = [  # stay, patient, age, height, weight, hours, died, hospital offset, unit offset
    (1, "a", "> 89", 170.0, 70.0, 24.0, 0, -100, 0), (2, "a", "90", 170.0, 70.0, 90.0, 0, -50, 0),
    (3, "b", "60", 170.0, 70.0, 23.9, 0, -100, 0), (4, "b", "60", 170.0, 70.0, 99.0, 0, -90, 0),  # the first is short: the patient is out
    (5, "c", "", 170.0, 70.0, 50.0, 0, 0, 0), (6, "d", "abc", 170.0, 70.0, 50.0, 0, 0, 0), (7, "e", None, 170.0, 70.0, 50.0, 0, 0, 0), (8, "f", "17", 1.0, 1.0, 50.0, 0, 0, 0),
    (9, "g", "18", 119.0, 70.0, 48.0, 1, 0, 0), (10, "h", "40", 180.0, 301.0, 48.0, 1, 0, 0), (11, "i", "50", None, None, 60.0, None, 0, 0), (12, "j", "50", 170.0, 70.0, 60.0, 0, 0, 0),
    (13, "k", "50", 170.0, 70.0, 47.9, 0, 0, 0), (14, "l", "50", 170.0, 70.0, 30.0, 0, 0, 0),
]
LABS = [
    (1, "creatinine", 0.05, 0), (1, "creatinine", 30.0, 0), (1, "creatinine", 31.0, 0), (1, "albumin", 35.0, 0), (1, "albumin", 61.0, 0), (1, "total bilirubin", 10.0, 0), (1, "total bilirubin", 10.1, 0),
    (1, "pH", 7.0, 0), (1, "pH", 7.31, 0), (1, "urine pH", 7.2, 0), (1, "phosphate", 7.7, 0), (1, "alkaline phos.", 40.0, 0), (1, "PT", 12.0, 0), (1, "PTT", 9.0, 0), (1, "PTT", 30.0, 0), (1, "PT - INR", 5.0, 0), (1, "PT - INR", 1.5, 0),
    (1, "Hgb", 12.0, 0), (1, "HgbA1c", 6.0, 0), (1, "lactic acid", 3.0, 0), (1, "lactate", 2.0, 1440), (1, "lactate", 9.0, 1441), (1, "WBC x 1000", 8.0, -1440), (1, "WBC x 1000", 9.0, -1441), (1, "WBC x 1000", None, 0), (1, None, 5.0, 0),
    (9, "creatinine", 1.9, 0), (10, "bicarbonate", 24.0, 0), (10, "paCO2", 40.0, 0), (10, "creatinine", 1.0, 0), (13, "creatinine", 1.0, 0), (14, "creatinine", 1.0, 0),
]


@pytest.fixture(scope="module")
def cohort(spark):
    make = spark.createDataFrame
    t = {
        "diagnosis": make([(s[0], "pancreatitis|acute") for s in STAYS] + [(9, "chronic pancreatitis"), (12, "lung CANCER"), (1, None)], "patientunitstayid long, diagnosisstring string"),
        "icustay_detail": make([(s, p, a, "Male", h, w, x, m, o, u) for s, p, a, h, w, x, m, o, u in STAYS], "patientunitstayid long, uniquepid string, age string, gender string, admissionheight double, admissionweight double, icu_los_hours double, hosp_mort int, hospitaladmitoffset int, unitadmitoffset int"),
        "lab": make(LABS, "patientunitstayid long, labname string, labresult double, labresultoffset int"),
        "pivoted_bg": make([(1, 0, 7.0, 40.0, 80.0, 50.0), (9, 10, None, None, 90.0, None), (9, 20, None, None, -1.0, 100.0), (12, 30, 7.2, 3.0, None, 40.0), (12, 30, 7.3, 50.0, None, 0.5), (12, -361, 6.9, 5.0, 1.0, 21.0)], "patientunitstayid long, chartoffset int, ph double, paco2 double, pao2 double, fio2 double"),
        "pivoted_vital": make([(12, 30, 90.0, -1.0, 20.0, 70.0, 98.6), (12, 90, 95.0, 80.0, -1.0, -1.0, 37.0), (12, 90, 97.0, 70.0, 15.0, 65.0, 60.0), (10, 5, 99.0, None, None, None, None), (1, 0, 49.0, None, None, None, None)],
                              "patientunitstayid long, chartoffset int, spo2 double, heartrate double, respiratoryrate double, nibp_mean double, temperature double"),
        "treatment": make([(13, "Mechanical VENTILATION", 1440), (14, "norepinephrine drip", 10080), (9, "hemodialysis", 10081), (12, "intubation", 2000)], "patientunitstayid long, treatmentstring string, treatmentoffset int"),
        "careplangeneral": make([(10, "Ventilated - chronic", 1500), (12, "ET tube", 1439)], "patientunitstayid long, cplitemvalue string, cplitemoffset int"),
        "apacheapsvar": make([(1, 7.4, 1.0, 1, 1), (12, None, None, 0, None)], "patientunitstayid long, ph double, creatinine double, vent int, dialysis int"),
        "patient": make([(s[0], "Alive", 3000, 40320 if s[0] != 10 else 40321) for s in STAYS], "patientunitstayid long, unitdischargestatus string, unitdischargeoffset int, hospitaldischargeoffset int"),
    }
    rows = external.external_cohort(t).collect()
    assert len({r["patientunitstayid"] for r in rows}) == len(rows)
    return {r["patientunitstayid"]: r for r in rows}


def test_who_is_in(cohort):
    assert set(cohort) == {1, 9, 10, 12, 13, 14}  # 11 has neither creatinine nor oxygenation, and nothing fired
    assert cohort[1]["admission_age"] == 90 and cohort[1]["bmi"] == pytest.approx(70 / 1.7**2)
    assert (cohort[9]["height_admit"], cohort[9]["bmi"], cohort[10]["weight_admit"], cohort[10]["bmi"]) == (None, None, None, None)


def test_names_and_units(cohort):
    r = cohort[1]
    assert r["creatinine_max"] == 30.0 and r["creatinine_min"] == pytest.approx(31 / 88.4)
    assert (r["albumin_min"], r["albumin_max"]) == (3.5, 3.5)
    assert r["bilirubin_total_max"] == 10.0 and r["bilirubin_total_min"] == pytest.approx(10.1 / 17.1) and r["tbar"] == pytest.approx(10 / 3.5)
    assert (r["ptt_min"], r["hemoglobin_max"], r["lactate_max"], r["wbc_max"], r["alp_min"]) == (30.0, 12.0, 2.0, 8.0, 40.0)
    assert (r["pt_min"], r["pt_max"], r["inr_min"], r["inr_max"]) == (1.5, 12.0, 1.5, 5.0)  # PT - INR counts to both
    assert r["ph_min"] == 7.31 and r["ph_max"] is None  # names with ph in them raise the greatest to 40


def test_ph_goes_down_its_tiers(cohort):
    assert (cohort[12]["ph_min"], cohort[12]["ph_max"]) == (7.2, 7.3)
    assert cohort[10]["ph_min"] == pytest.approx(6.1 + math.log10(24 / (0.0301 * 40))) and cohort[9]["ph_min"] is None


def test_oxygenation_and_vitals(cohort):
    r = cohort[12]
    assert cohort[1]["pao2fio2ratio_min"] == 160.0 and cohort[9]["pao2fio2ratio_min"] == pytest.approx(90 / 0.21)
    assert r["pao2fio2ratio_min"] == pytest.approx(90 / 0.4 * 0.9) and cohort[10]["pao2fio2ratio_min"] == pytest.approx(99 / 0.21 * 0.9)
    assert r["spo2_slope"] == 7.0 and cohort[10]["spo2_slope"] == 0.0 and cohort[1]["spo2_slope"] is None
    assert (r["heart_rate_max"], r["heart_rate_min"], r["resp_rate_min"], r["mbp_min"]) == (80.0, 70.0, 15.0, 65.0)
    assert r["temp_max"] == pytest.approx(37.0) and r["temp_min"] == pytest.approx(37.0)


def test_outcomes(cohort):
    pick = lambda s: tuple(cohort[s][c] for c in ("vaso_flag", "mechanical_vent_flag", "dialysis_flag", "mortality_28d", "pof", "composite_outcome", "malignant_tumor"))
    assert pick(1) == (0, 1, 1, 0, 1, 1, 0)
    assert pick(9) == (0, 0, 0, 1, 0, 1, 0)  # creatinine of 1.9 isn't over it; a chronic line doesn't undo the acute one
    assert pick(10) == (0, 1, 0, 0, 1, 1, 0)  # the care plan; death a minute after 28 days
    assert pick(12) == (0, 0, 0, 0, 1, 1, 1)  # the score's 0 stands before the treatment; oxygenation is low
    assert pick(13) == (0, 1, 0, 0, 0, 0, 0) and pick(14) == (1, 0, 0, 0, 1, 1, 0)
