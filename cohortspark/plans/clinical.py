"""Clinical tables made of the star-schema ones, and the cohort job over them with its SQL.

Both engines read the same statements; a name in braces is a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators import external
from ..operators.clinical import COMORBIDITIES, FIRST_DAY_LABS, GASES, LABS, RENAMED, SCORES, VITALS, clinical_cohort
from .queries import ORACLES, QUERIES, r6, rd
from .views import Views


def _pick(number: str, values: list) -> str:
    """SQL of the number's place in a list."""
    shown = [f"'{x}'" if isinstance(x, str) else str(x) for x in values]
    return f"case {number} % {len(values)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(shown)) + " end"


_ITEMS = sorted({c for codes, _ in LABS.columns.values() for c in codes})
_LINES = "{lineitem} join {orders} on l_orderkey = o_orderkey"
_LABS = [f"case when o_orderkey % {7 + i // 2} = 3 then null else o_orderkey % {11 + i // 2} + {2.5 * (i % 2)} end {n}" for i, n in enumerate(FIRST_DAY_LABS)]

TABLES = {
    "diagnoses_icd": f"select o_custkey subject_id, l_orderkey hadm_id, case when l_linenumber % 2 = 1 then 9 else 10 end icd_version, case when l_linenumber % 2 = 1 then {_pick('l_partkey', ['5770', '4280', '5859', '1570', '2749'])} else {_pick('l_partkey', ['K8510', 'I509', 'N189', 'C259', 'K86'])} end icd_code from {_LINES}",
    "icustays": "select o_custkey subject_id, o_orderkey hadm_id, o_orderkey stay_id, o_orderdate + interval 5 hour intime, o_totalprice / 50000 los from {orders}",
    "admissions": "select o_orderkey hadm_id, o_orderdate admittime, o_orderdate + interval 30 day dischtime, case when o_orderkey % 5 = 0 then o_orderdate + (o_orderkey % 41) * interval 1 day end deathtime from {orders}",
    "patients": f"select c_custkey subject_id, case when c_custkey % 3 = 0 then cast('1996-05-01' as date) end dod, {_pick('c_custkey', ['F', 'M'])} gender, 1994 anchor_year, cast(10 + c_custkey % 70 as int) anchor_age from {{customer}}",
    "height": "select o_custkey subject_id, 150.0 + o_orderkey % 40 height from {orders} where o_orderkey % 2 = 0",
    "first_day_weight": "select o_orderkey stay_id, case when o_orderkey % 9 > 0 then 40 + o_totalprice / 6997 end weight from {orders}",
    "first_day_height": "select o_orderkey stay_id, case when o_orderkey % 3 > 0 then 20.0 * (o_orderkey % 10) end height from {orders}",
    "sofa": f"select l_orderkey stay_id, o_orderdate + l_linenumber * interval 19 hour starttime, l_partkey % 4 respiration, l_suppkey % 3 cardiovascular, case when l_partkey % 5 > 0 then l_partkey % 3 end renal from {_LINES}",
    "labevents": f"select l_orderkey hadm_id, case when l_returnflag = 'N' then {_pick('l_partkey', [50931, 50809, 52569])} else {_pick('l_partkey', _ITEMS)} end itemid, o_orderdate + l_linenumber * interval 4 hour - interval 9 hour charttime, case when l_partkey % 13 > 0 then l_quantity end valuenum from {_LINES}",
    "bg": f"select l_orderkey hadm_id, o_orderdate + l_linenumber * interval 5 hour charttime, case when l_suppkey % 4 > 0 then l_quantity / 10 end lactate from {_LINES}",
    "chartevents": f"select l_orderkey stay_id, case when l_partkey % 5 > 0 then 220277 else 220045 end itemid, o_orderdate + l_linenumber * interval 5 hour charttime, 70 + l_quantity / 2 valuenum from {_LINES}",
    "ventilation": f"select l_orderkey stay_id, o_orderdate + l_linenumber * interval 9 hour starttime, {_pick('l_suppkey', ['InvasiveVent', 'HFNC', 'Tracheostomy', 'None'])} ventilation_status from {_LINES}",
    "vasoactive_agent": f"select l_orderkey stay_id, o_orderdate + l_linenumber * interval 11 hour starttime from {_LINES} where l_linestatus = 'F'",
    **{t: f"select o_orderkey stay_id, cast(o_orderkey % {17 + i} as int) {c} from {{orders}} where o_orderkey % {3 + i} > 0" for i, (t, (c, _)) in enumerate(SCORES.items())},
    "first_day_lab": f"select o_orderkey stay_id, {', '.join(_LABS)} from {{orders}} where o_orderkey % 8 > 0",
    "first_day_bg": "select o_orderkey stay_id, 7.0 + o_orderkey % 5 / 10 ph_min, 7.1 + o_orderkey % 5 / 10 ph_max, 1.0 * (o_orderkey % 300) pao2fio2ratio_min, 1.0 * (o_orderkey % 300) + 50 pao2fio2ratio_max from {orders} where o_orderkey % 6 > 0",
}


def tables_of(v: Views, statements: dict[str, str]) -> dict[str, DataFrame]:
    made = {}
    for name, statement in statements.items():
        read = {n: v.table(n) for n in set(re.findall(r"\{(\w+)\}", statement))}
        df = v.spark.sql(statement, **read)
        made[name] = df.select([df[c].cast("double") if t.startswith("decimal") else df[c] for c, t in df.dtypes])
    return made


def _panel_sql(name: str, p, table: str) -> str:
    """A CTE with one row for each key of a panel."""
    out = []
    for c, (codes, how) in p.columns.items():
        on = f"filter ({p.item} in ({', '.join(map(str, codes))}))" if p.item else ""
        if how == "slope":
            h = f"((epoch_us(max({p.ts}) {on}) - epoch_us(min({p.ts}) {on})) / 3600000000.0::double)"
            out.append(f"case when count({p.value}) {on} >= 3 and {h} > 0.5 then (max({p.value}) {on} - min({p.value}) {on}) / {h} end {c}")
        else:
            out.append(f"{how}({p.value}) {on} {c}")
    return f"{name} as (select f.{p.key}, {', '.join(out)} from {table} f join c using ({p.key}) where {p.ts} between {p.since} and {p.until} and {p.value} is not null group by 1)"


def _cohort_sql() -> str:
    views = ", ".join(f"{n} as (select * from ({re.sub(r'[{}]', '', q)}))" for n, q in TABLES.items())
    prefix = lambda ps: " or ".join(f"icd_code like '{p}%'" for p in ps)
    score = lambda x: f"(select stay_id, ({x} >= 2)::integer hit from (select stay_id, starttime::date d, max({x}) {x} from sofa join c using (stay_id) where starttime >= intime + interval 24 hour and starttime < intime + interval 7 day group by 1, 2))"
    organs = {"resp": "respiration", "cv": "cardiovascular", "renal": "renal"}
    failed = ", ".join(f"{o} as (select stay_id, (sum(hit) >= 2)::integer {o}_pof from {score(x)} group by 1)" for o, x in organs.items())
    day = "starttime between intime and intime + interval 24 hour"
    between = lambda d: f"coalesce({d} between intime + interval 24 hour and intime + interval 48 hour, false)"
    doubles = ["los", "weight_admit", "height_admit", "bmi", *[RENAMED.get(x, x) for x in FIRST_DAY_LABS], *[x for p in (LABS, GASES, VITALS) for x in p.columns], "ph_min", "ph_max", "pao2fio2ratio_min", "pao2fio2ratio_max", "nlr", "lar", "tbar"]
    whole = ["subject_id", "hadm_id", "stay_id", "intime", "admittime", "dischtime", "deathtime", "dod", "gender", "admission_age", *[o for _, o in SCORES.values()], "resp_pof", "cv_pof", "renal_pof", "pof", "mortality_28d", "early_death_24_48h", "composite_outcome", "mechanical_vent_flag", "vaso_flag", *COMORBIDITIES]
    joined = " ".join(f"left join (select stay_id, {c} {o} from {t}) {t} using (stay_id)" for t, (c, o) in SCORES.items())
    return f"""with {views},
      ill as (select distinct hadm_id from diagnoses_icd where (icd_version = 9 and icd_code = '5770') or (icd_version = 10 and icd_code like 'K85%')),
      ranked as (select *, row_number() over (partition by subject_id order by intime, stay_id) k from icustays where los >= 1 and hadm_id in (select hadm_id from ill)),
      c as (select subject_id, hadm_id, stay_id, intime, los, admittime, dischtime, deathtime, dod, gender, (year(intime) - anchor_year + anchor_age)::integer admission_age, weight weight_admit, coalesce(h.height, g.usual) height_admit
        from ranked join admissions using (hadm_id) join patients using (subject_id) left join first_day_weight using (stay_id) left join first_day_height h using (stay_id) left join (select subject_id, median(height) usual from height group by 1) g using (subject_id)
        where k = 1 and year(intime) - anchor_year + anchor_age >= 18),
      {failed}, {_panel_sql('lab', LABS, 'labevents')}, {_panel_sql('gas', GASES, 'bg')}, {_panel_sql('vital', VITALS, 'chartevents')},
      other as (select hadm_id, {', '.join(f'max(({prefix(ps)})::integer) {n}' for n, ps in COMORBIDITIES.items())} from diagnoses_icd group by 1),
      w as (select c.*, case when height_admit > 0 then weight_admit / pow(height_admit / 100, 2) end bmi, coalesce(resp_pof, 0) resp_pof, coalesce(cv_pof, 0) cv_pof, coalesce(renal_pof, 0) renal_pof,
        greatest(coalesce(resp_pof, 0), coalesce(cv_pof, 0), coalesce(renal_pof, 0)) pof, coalesce(coalesce(deathtime, dod) <= intime + interval 28 day, false)::integer mortality_28d,
        ({between('deathtime')} or {between('dod')})::integer early_death_24_48h, (stay_id in (select stay_id from ventilation join c using (stay_id) where {day} and ventilation_status in ('InvasiveVent', 'Tracheostomy')))::integer mechanical_vent_flag,
        (stay_id in (select stay_id from vasoactive_agent join c using (stay_id) where {day}))::integer vaso_flag, {', '.join(f'coalesce({n}, 0) {n}' for n in COMORBIDITIES)},
        lab.* exclude (hadm_id), gas.* exclude (hadm_id), vital.* exclude (stay_id), l.* exclude (stay_id), f.* exclude (stay_id), {', '.join(o for _, o in SCORES.values())}
        from c left join resp using (stay_id) left join cv using (stay_id) left join renal using (stay_id) left join lab using (hadm_id) left join gas using (hadm_id) left join vital using (stay_id) left join other using (hadm_id)
        left join (select stay_id, {', '.join(f'{x} {RENAMED.get(x, x)}' for x in FIRST_DAY_LABS)} from first_day_lab) l using (stay_id) left join first_day_bg f using (stay_id) {joined}),
      z as (select *, greatest(pof, mortality_28d) composite_outcome, case when lymphocytes_mean > 0 then neutrophils_mean / lymphocytes_mean end nlr, case when albumin_min > 0 then lactate_max / albumin_min end lar, case when albumin_min > 0 then bilirubin_total_max / albumin_min end tbar from w)
      select {', '.join(whole)}, {rd(*doubles)} from z"""


QUERIES["clinical_cohort"] = lambda spark, sf_dir: r6(clinical_cohort(tables_of(Views(spark, sf_dir), TABLES)))
ORACLES["clinical_cohort"] = _cohort_sql()


_KEY = external.KEY
_NAMES = ["creatinine", "albumin", "total bilirubin", "pH", "phosphate", "alkaline phos.", "PT", "PTT", "PT - INR", "Hgb", "HgbA1c", "lactic acid", "lactate", "WBC x 1000", "BUN", "bicarbonate", "paCO2", "RDW", "Hct", "platelets x 1000", "AST (SGOT)", "ALT (SGPT)", "glucose", "anion gap", "calcium", "ionized calcium", "urine pH"]
_OFFSET = "cast(l_linenumber * 400 + l_suppkey % 7 - 1500 as int)"

OFFSET_TABLES = {
    "diagnosis": f"select l_orderkey {_KEY}, {_pick('l_partkey', ['acute pancreatitis', 'chronic pancreatitis', 'sepsis', 'PANCREATITIS | biliary', 'lung Cancer', 'metastasis'])} diagnosisstring from {{lineitem}}",
    "icustay_detail": f"""select o_orderkey {_KEY}, concat('p', cast(o_custkey as varchar(20))) uniquepid, case when o_custkey % 11 = 0 then '> 89' when o_custkey % 13 = 0 then '' when o_custkey % 17 = 0 then 'abc' when o_custkey % 19 > 0 then cast(10 + o_custkey % 75 as varchar(20)) end age,
      {_pick('o_custkey', ['Female', 'Male'])} gender, case when o_orderkey % 7 > 0 then 110.0 + o_orderkey % 90 end admissionheight, 25 + o_totalprice / 6997 admissionweight, o_totalprice / 2999 icu_los_hours, case when o_orderkey % 6 > 0 then cast(o_orderkey % 2 as int) end hosp_mort,
      cast(o_orderkey % 5 as int) - 5 hospitaladmitoffset, cast(o_orderkey % 3 as int) unitadmitoffset from {{orders}}""",
    "lab": f"select l_orderkey {_KEY}, {_pick('l_partkey', _NAMES)} labname, case when l_partkey % 29 > 0 then (case when l_suppkey % 3 = 0 then l_quantity / 7 else l_quantity end) end labresult, {_OFFSET} labresultoffset from {{lineitem}}",
    "pivoted_bg": f"select l_orderkey {_KEY}, {_OFFSET} chartoffset, case when l_partkey % 3 > 0 then 6.6 + l_quantity / 40 end ph, l_quantity paco2, case when l_suppkey % 4 = 0 then 40 + 3 * l_quantity end pao2, case when l_partkey % 2 = 0 then 2 * l_quantity end fio2 from {{lineitem}} where l_returnflag <> 'A'",
    "pivoted_vital": f"select l_orderkey {_KEY}, {_OFFSET} chartoffset, 45 + l_quantity * 1.1 spo2, case when l_partkey % 9 = 0 then -1 else 60 + l_quantity end heartrate, case when l_partkey % 8 = 0 then -1 else l_quantity end respiratoryrate, case when l_partkey % 7 = 0 then -1 else 50 + l_quantity end nibp_mean, case when l_suppkey % 2 = 0 then 25 + l_quantity / 2 else 70 + l_quantity end temperature from {{lineitem}} where l_linestatus = 'F' or l_partkey % 2 = 0",
    "treatment": f"select l_orderkey {_KEY}, {_pick('l_partkey', ['NOREPINEPHRINE drip', 'antibiotics', 'hemodialysis', 'diet', 'mechanical ventilation', 'fluids', 'analgesia', 'intubation'])} treatmentstring, cast(l_linenumber * 1500 + l_suppkey % 3 as int) treatmentoffset from {{lineitem}} where l_suppkey % 5 = 0",
    "careplangeneral": f"select l_orderkey {_KEY}, {_pick('l_suppkey', ['Ventilated - daily', 'oral diet', 'ET tube', 'mobile', 'family'])} cplitemvalue, cast(l_linenumber * 1600 as int) cplitemoffset from {{lineitem}} where l_partkey % 6 = 0",
    "apacheapsvar": f"select o_orderkey {_KEY}, case when o_orderkey % 2 = 0 then 6.5 + o_orderkey % 16 / 10 end ph, 1.0 * (o_orderkey % 25) creatinine, case when o_orderkey % 3 > 0 then cast(o_orderkey % 2 as int) end vent, case when o_orderkey % 4 > 0 then case when o_orderkey % 10 = 1 then 1 else 0 end end dialysis from {{orders}} where o_orderkey % 5 > 0",
    "patient": f"select o_orderkey {_KEY}, cast(30000 + o_orderkey % 20000 as int) hospitaldischargeoffset from {{orders}}",
}


def _external_sql() -> str:
    views = ", ".join(f"{n} as (select * from ({re.sub(r'[{}]', '', q)}))" for n, q in OFFSET_TABLES.items())
    like = lambda c, ps, but=(): "(" + " or ".join(f"{c} ilike '{p}'" for p in ps) + ")" + "".join(f" and {c} not ilike '{p}'" for p in but)
    ladder = []
    for r in external.RULES:
        on, plain = like("labname", r["patterns"], r.get("but", ())), f"labresult between {r['lo']} and {r['hi']}"
        if "step" in r:
            s, d = r["step"], f"labresult / {r['step']['divide']}::double"
            fits = f"labresult > {s['over']}" + (f" and {d} between {s['lo']} and {s['hi']}" if "lo" in s else "")
            ladder.append(f"when {on} then case when {fits} then {d} when {plain} then labresult end")
        else:
            ladder.append(f"when {on} and {plain}{' and labresult not in (7.0, 8.0)' if 'not_in' in r else ''} then labresult")
    panel = ", ".join(f"{how}(x) filter ({like('labname', p, b)}) {a}_{how}" for a, (p, b, hows) in external.ANALYTES.items() for how in hows.split())
    own = lambda c, e, n: f"{e}(nullif({c}, -1)) {n}_{e}"
    celsius = "case when temperature between 80 and 115 then (temperature - 32) * 5 / 9 when temperature between 30 and 45 then temperature end"
    fi = "case when fio2 >= 21 then fio2 / 100 else 0.21::double end"
    ph = lambda lo: f"case when ph between {lo} and 7.8 and ph not in (7.0, 8.0) then ph end"
    flags = ", ".join(f"max(({like('treatmentstring', ps)})::integer) {n}" for n, ps in external.TREATMENTS.items())
    failed = "(vaso_flag = 1 and los >= 1) or (mechanical_vent_flag = 1 and los >= 2) or (pao2fio2ratio_min < 300 and los >= 2) or dialysis_flag = 1 or creatinine_max > 1.9"
    labs = [f"{a}_{how}" for a, (_, _, hows) in external.ANALYTES.items() for how in hows.split() if f"{a}_{how}" not in ("lab_ph_min", "lab_ph_max", "lab_paco2_avg", "bicarbonate_avg")]
    vitals = [f"{n}_{e}" for n in ("heart_rate", "resp_rate", "spo2", "temp") for e in ("max", "min")]
    doubles = ["height_admit", "weight_admit", "los", "bmi", *labs, "spo2_slope", "pao2fio2ratio_min", *vitals, "mbp_min", "ph_min", "ph_max", "tbar"]
    whole = [_KEY, "uniquepid", "admission_age", "gender", "vaso_flag", "malignant_tumor", "mechanical_vent_flag", "dialysis_flag", "mortality_28d", "pof", "composite_outcome"]
    gas, later = "chartoffset between -360 and 1440", "between 1440 and 10080"
    return f"""with {views}, aged as (select *, case when age = '> 89' then 90 when regexp_full_match(age, '[0-9]+') then age::integer else 0 end admission_age from icustay_detail),
      ranked as (select *, row_number() over (partition by uniquepid order by hospitaladmitoffset, unitadmitoffset, {_KEY}) k from aged where {_KEY} in (select {_KEY} from diagnosis where diagnosisstring ilike '%pancreatit%' and diagnosisstring not ilike '%chronic%')),
      c as (select {_KEY}, uniquepid, admission_age, gender, case when admissionheight between 120 and 250 then admissionheight end height_admit, case when admissionweight between 30 and 300 then admissionweight end weight_admit, icu_los_hours / 24 los, hosp_mort from ranked where k = 1 and icu_los_hours >= 24 and admission_age >= 18),
      cleaned as (select {_KEY}, labname, case {' '.join(ladder)} end x from lab where labresultoffset between -1440 and 1440), labs as (select {_KEY}, {panel} from cleaned group by 1),
      gas as (select *, {fi} fi from pivoted_bg where {gas}), vital as (select * from pivoted_vital where {gas}),
      gases as (select {_KEY}, min({ph(6.7)}) bg_ph_min, max({ph(6.7)}) bg_ph_max, avg(paco2) filter (paco2 between 5 and 150) bg_paco2, min(pao2 / fi) filter (pao2 > 0) pf from gas group by 1),
      sat as (select v.{_KEY}, min(spo2 / coalesce(fi, 0.21::double)) sf from vital v left join gas g using ({_KEY}, chartoffset) where spo2 between 50 and 100 group by 1),
      trend as (select {_KEY}, case when max(chartoffset) > min(chartoffset) then (arg_max(spo2, (chartoffset, spo2)) - arg_min(spo2, (chartoffset, spo2))) / ((max(chartoffset) - min(chartoffset)) / 60.0::double) else 0 end spo2_slope from vital where spo2 between 50 and 100 group by 1),
      signs as (select {_KEY}, {', '.join(own(x, e, n) for n, x in (('heart_rate', 'heartrate'), ('resp_rate', 'respiratoryrate'), ('spo2', 'spo2')) for e in ('max', 'min'))}, max({celsius}) temp_max, min({celsius}) temp_min, min(nullif(nibp_mean, -1)) mbp_min from vital group by 1),
      treated as (select {_KEY}, {flags} from treatment where treatmentoffset {later} group by 1), planned as (select distinct {_KEY}, 1 planned from careplangeneral where cplitemoffset {later} and {like('cplitemvalue', external.CARE_PLANS)}),
      tumour as (select {_KEY}, max(({like('diagnosisstring', external.TUMOURS)})::integer) tumour from diagnosis group by 1),
      w as (select * exclude (vaso_flag), coalesce(tumour, 0) malignant_tumor, coalesce(vaso_flag, 0) vaso_flag, coalesce(vent, planned, vent_treated, 0) mechanical_vent_flag, coalesce(dialysis_treated, dialysis, 0) dialysis_flag,
        coalesce(hosp_mort = 1 and hospitaldischargeoffset <= 40320, false)::integer mortality_28d, coalesce(pf, sf * 0.9::double) pao2fio2ratio_min, weight_admit / pow(height_admit / 100, 2) bmi, bilirubin_total_max / greatest(albumin_min, 1.0::double) tbar,
        case when bicarbonate_avg > 0 and coalesce(bg_paco2, lab_paco2_avg) > 0 then 6.1::double + log10(bicarbonate_avg / (0.0301::double * coalesce(bg_paco2, lab_paco2_avg))) end ph_t3, {ph(6.8)} ph_t4, coalesce(bg_ph_max, lab_ph_max, bg_ph_min, lab_ph_min) ph_top
        from c join patient using ({_KEY}) left join labs using ({_KEY}) left join gases using ({_KEY}) left join sat using ({_KEY}) left join trend using ({_KEY}) left join signs using ({_KEY}) left join treated using ({_KEY}) left join planned using ({_KEY}) left join (select {_KEY}, ph, vent, dialysis from apacheapsvar) a using ({_KEY}) left join tumour using ({_KEY})),
      y as (select *, case when bg_ph_min between 6.7 and 7.8 then bg_ph_min when lab_ph_min between 6.7 and 7.8 then lab_ph_min when ph_t3 between 6.7 and 7.8 then ph_t3 when ph_t4 between 6.7 and 7.8 then ph_t4 end ph_min, case when ph_top between 6.7 and 7.8 then ph_top end ph_max,
        case when {failed} then 1 when creatinine_max is null and pao2fio2ratio_min is null then null else 0 end pof, case when {failed} or mortality_28d = 1 then 1 else 0 end composite_outcome from w)
      select {', '.join(whole)}, {rd(*doubles)} from y where pof is not null"""


QUERIES["external_cohort"] = lambda spark, sf_dir: r6(external.external_cohort(tables_of(Views(spark, sf_dir), OFFSET_TABLES)))
ORACLES["external_cohort"] = _external_sql()
