"""The development cohort on literal clinical rows: who is in, what the windows hold, and the outcomes."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from cohortspark.operators.clinical import FIRST_DAY_GASES, FIRST_DAY_LABS, SCORES, clinical_cohort

T = datetime(2150, 3, 10, 8)
H, TICK = timedelta(hours=1), timedelta(microseconds=1)
# stay n belongs to admission 100 + n
STAYS = [
    (1, 11, T, 3.0), (1, 12, T + 90 * 24 * H, 5.0),  # two that qualify: the first stays
    (2, 21, T, 0.9), (2, 22, T + 50 * H, 2.0),  # the first is too short: the second stays
    (3, 31, T, 2.0),  # 17 years
    (4, 41, T, 2.0),  # 18 years
    (5, 51, T, 2.0),  # another disease
    (6, 61, T, 2.0), (6, 60, T, 2.0),  # one time: the lesser stay
]
PATIENTS = [(1, None, "F", 2150, 60), (2, date(2150, 3, 14), "M", 2148, 50), (3, None, "F", 2150, 17), (4, None, "M", 2149, 17), (5, None, "F", 2150, 40), (6, None, "F", 2150, 40)]


@pytest.fixture(scope="module")
def cohort(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind.replace(" ts", " timestamp_ntz"))
    codes = [(n, "5770", 9) if n != 51 else (n, "577", 9) for _, n, _, _ in STAYS] + [(11, "K8590", 10), (11, "I509", 10), (11, "I500", 10), (41, "C250", 10), (12, "5859", 9), (51, "K85", 9), (51, "5770", 10)]
    death = {11: T + 24 * H, 41: T + 28 * 24 * H, 60: T + 48 * H + TICK}
    labs = [
        (11, 50931, T - 5 * H - 60 * TICK, 9.0), (11, 50809, T, 3.0), (11, 52569, T + 24 * H, 5.0), (11, 50931, T + 24 * H + TICK, 99.0), (11, 50931, T - 8 * H, 0.5), (11, 99999, T, 7.0),
        (11, 51256, T, 80.0), (11, 51244, T, 0.0), (22, 50931, T + 50 * H, 4.0), (22, 50931, T + 50.5 * H, 6.0), (22, 50931, T + 50.25 * H, None), (22, 51256, T + 51 * H, 9.0), (22, 52075, T + 51 * H, 7.0), (22, 51133, T + 51 * H, 2.0),
        (41, 50931, T, 1.0), (41, 50931, T + 0.25 * H, 2.0), (41, 50931, T + 0.5 * H, 4.0), (51, 50931, T, 1.0),
    ]
    days = lambda s, x: [(s, T + k * 24 * H, *v) for k, v in x]
    sofa = days(11, [(1, (2, 0, None)), (1.1, (4, 0, None)), (7, (4, 3, 3)), (0.9, (3, 3, 3))]) + days(41, [(1, (2, None, 1)), (2, (2, 2, 1))]) + days(22, [(4, (1, 2, 0)), (5, (None, 3, 2))])
    lab_row = lambda s, albumin: (s, *[{"albumin_min": albumin, "bilirubin_total_max": 6.0}.get(c, 1.0) for c in FIRST_DAY_LABS])
    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    t = {
        "diagnoses_icd": make([(n // 10, 100 + n, v, c) for n, c, v in codes], "subject_id long, hadm_id long, icd_version int, icd_code string"),
        "icustays": make([(p, 100 + n, n, at, los) for p, n, at, los in STAYS], "subject_id long, hadm_id long, stay_id long, intime ts, los double"),
        "admissions": make([(100 + n, at - H, at + 500 * H, death.get(n)) for _, n, at, _ in STAYS], "hadm_id long, admittime ts, dischtime ts, deathtime ts"),
        "patients": make(PATIENTS, "subject_id long, dod date, gender string, anchor_year int, anchor_age int"),
        "height": make([(1, 160.0), (1, 170.0), (1, None), (2, 190.0), (4, 150.0)], "subject_id long, height double"),
        "first_day_weight": make([(11, 66.0), (22, 80.0), (41, None)], "stay_id long, weight double"),
        "first_day_height": make([(11, None), (22, 200.0), (41, 0.0)], "stay_id long, height double"),
        "sofa": make(sofa, "stay_id long, starttime ts, respiration int, cardiovascular int, renal int"),
        "labevents": make([(100 + n, *r) for n, *r in labs], "hadm_id long, itemid int, charttime ts, valuenum double"),
        "bg": make([(111, T, 1.0), (111, T + H, 4.0), (111, T + 2 * H, 2.0), (111, T - TICK, 50.0), (141, T, 2.0)], "hadm_id long, charttime ts, lactate double"),
        "chartevents": make([(11, 220277, T + 24 * H, 90.0), (11, 220045, T, 20.0), (41, 220277, T + 25 * H, 88.0)], "stay_id long, itemid int, charttime ts, valuenum double"),
        "ventilation": make([(11, T, "InvasiveVent"), (11, T + H, "Tracheostomy"), (41, T, "HFNC"), (22, T, "InvasiveVent")], "stay_id long, starttime ts, ventilation_status string"),
        "vasoactive_agent": make([(11, T + H), (11, T + 2 * H), (11, T + 3 * H), (41, T + 24 * H)], "stay_id long, starttime ts"),
        "first_day_lab": make([lab_row(11, 2.0), lab_row(41, 0.0)], f"stay_id long, {doubles(FIRST_DAY_LABS)}"),
        "first_day_bg": make([(11, 7.2, 7.4, 150.0, 300.0)], f"stay_id long, {doubles(FIRST_DAY_GASES)}"),
        **{n: make([(11, 7), (51, 9)], f"stay_id long, {c} int") for n, (c, _) in SCORES.items()},
    }
    rows = clinical_cohort(t).collect()
    assert len({r["stay_id"] for r in rows}) == len(rows)
    return {r["stay_id"]: r for r in rows}


def test_who_is_in(cohort):
    assert set(cohort) == {11, 22, 41, 60}
    assert [cohort[s]["admission_age"] for s in (11, 22, 41)] == [60, 52, 18]


def test_heights_fall_back_only_where_none_is_there(cohort):
    assert (cohort[11]["height_admit"], cohort[22]["height_admit"], cohort[41]["height_admit"]) == (165.0, 200.0, 0.0)
    assert cohort[11]["bmi"] == pytest.approx(66 / 1.65**2) and cohort[22]["bmi"] == pytest.approx(20.0) and cohort[41]["bmi"] is None


def test_windows_hold_both_ends(cohort):
    a, b, c = cohort[11], cohort[22], cohort[41]
    assert (a["glucose_lab_min"], a["glucose_lab_max"]) == (3.0, 9.0)
    assert a["glucose_slope"] == pytest.approx(6 / ((29 * H + 60 * TICK) / H))
    assert b["glucose_slope"] is None and c["glucose_slope"] is None  # two samples; a span of half an hour
    assert (a["lactate_min"], a["lactate_max"], a["lactate_slope"]) == (1.0, 4.0, 1.5) and c["lactate_slope"] is None
    assert a["spo2_max"] == 90.0 and c["spo2_max"] is None
    assert a["nlr"] is None and b["nlr"] == 4.0
    assert (a["lar"], a["tbar"], c["lar"], c["tbar"]) == (2.0, 3.0, None, None)


def test_outcomes(cohort):
    pick = lambda s: tuple(cohort[s][c] for c in ("resp_pof", "cv_pof", "renal_pof", "pof", "mortality_28d", "early_death_24_48h", "composite_outcome"))
    assert pick(11) == (0, 0, 0, 0, 1, 1, 1)  # one day in the window; death at 24 hours sharp
    assert pick(22) == (0, 1, 0, 1, 1, 1, 1)  # the date of death only: its midnight is 38 hours after the stay began
    assert pick(41) == (1, 0, 0, 1, 1, 0, 1)  # 28 days sharp
    assert pick(60) == (0, 0, 0, 0, 1, 0, 1)


def test_flags_and_scores(cohort):
    pick = lambda s: tuple(cohort[s][c] for c in ("mechanical_vent_flag", "vaso_flag", "heart_failure", "chronic_kidney_disease", "malignant_tumor", "sofa_score"))
    assert pick(11) == (1, 1, 1, 0, 0, 7) and pick(41) == (0, 1, 0, 0, 1, None) and pick(22) == (0, 0, 0, 0, 0, None)
    assert (cohort[11]["lab_calcium_min"], cohort[11]["ph_min"], cohort[60]["wbc_min"]) == (1.0, 7.2, None)
