"""One query for each operation, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive, units
from ..operators import cleaning, evaluate, events, flows, joins, models, profile, select, stats, validation
from ..sources import tables
from .registry import FEAT
from .views import Views, rounded, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMBERS = ["r_min", "r_max", "a_price", "n_price", "disc", "tax"]
LINEAR = {"r_max": 0.03, "a_price": -0.00002, "tax": 4.0, "disc": -2.5}
INTERCEPT = -0.4


def query(name: str, sql: str | None = None):
    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for publication; -0.0 as 0.0."""
    return df.select([(rounded(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rd(*columns: str, places: int = 6) -> str:
    """SQL of rounded columns: 'x' or 'expression name'."""
    out = []
    for c in columns:
        e, _, n = c.rpartition(" ")
        out.append(f"round(({e or n})::double, {places}) + 0.0::double as {n}")
    return ", ".join(out)


def stack(columns: list[str], template: str) -> str:
    """union all of a SELECT for each column; {c} is its name."""
    return " union all ".join(template.replace("{c}", c) for c in columns)


# sources and sinks


@query("csv_roundtrip", "select * from stays")
def _(v):
    path = tables.scratch(v.spark, "csv")
    tables.write_cohort_csv(v.stays, path)
    return tables.read_cohort_csv(v.spark, path, v.stays.schema)


@query("table_roundtrip", "select * from stays")
def _(v):
    path = tables.scratch(v.spark, "table")
    tables.publish_table(v.stays.where("los > 1"), path, ["segment"])
    tables.publish_table(tables.read_published(v.spark, path, v.stays.schema).unionByName(v.stays.where("los <= 1 or los is null")), path, ["segment"])
    return tables.read_published(v.spark, path, v.stays.schema).select(v.stays.columns)


@query("json_assets_roundtrip", "select event_type outcome, 'k' || (k % 5)::varchar as feature, sum(k)::double weight from (select event_type, json_extract(props, '$.k')::integer k from events) group by all")
def _(v):
    parsed = v.table("events").select("event_type", F.from_json("props", "k int").alias("p"))
    sums = parsed.groupBy(F.col("event_type").alias("outcome"), F.concat(F.lit("k"), F.col("p.k") % 5).alias("feature")).agg(F.sum("p.k").cast("double").alias("weight"))
    nested = sums.groupBy("outcome").agg(F.sort_array(F.collect_list("feature")).alias("features"), F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights"))
    path = tables.scratch(v.spark, "json")
    tables.write_assets_json(nested, path)
    return tables.explode_weights(tables.read_assets_json(v.spark, path, "outcome string, features array<string>, weights map<string,double>"), "outcome", "weights")


# selection


@query("code_cohort", "select distinct hadm from dx where (version = 'PROMO' and code = 'Brand#4') or (version = 'SMALL' and code like 'Brand#1%')")
def _(v):
    return select.code_cohort(v.dx, [("PROMO", "is", "Brand#4"), ("SMALL", "starts", "Brand#1")], ["hadm"])


@query("text_cohort", "select distinct hadm from dx where (text ilike '%RED%' or text ilike '%hot%') and text not ilike '%Plate%'")
def _(v):
    return select.text_cohort(v.dx, "text", ["RED", "hot"], ["Plate"], "hadm")


@query("ilike_any_flag", "select hadm, text, ((text ilike '%RED%' or text ilike 'old%') and text not ilike '%rod')::integer flag from dx")
def _(v):
    return v.dx.select("hadm", "text", select.ilike_any(F.col("text"), ["%RED%", "old%"], ["%rod"]).cast("int").alias("flag"))


@query("anchored_window", "select event_id, user_id, event_type, ts, t0 from events join idx using (user_id) where ts >= t0 - interval 6 hour and ts < t0 + interval 24 hour")
def _(v):
    return select.in_window(v.table("events").select("event_id", "user_id", "event_type", "ts"), v.idx, "user_id", "ts", "t0", "-6 hours", "24 hours", closed=False)


@query("plausible_or_null", "select c_custkey, case when c_acctbal between 0 and 5000 and c_acctbal not in (7.0, 8.0) then c_acctbal end clean, nullif(c_nationkey, 3) nation from customer")
def _(v):
    return v.table("customer").select("c_custkey", select.plausible(F.col("c_acctbal"), 0, 5000, (7.0, 8.0)).alias("clean"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))


@query("select_by_role", "select id, r_min, r_max, a_price, disc, tax from feat")
def _(v):
    routed = units.route_by_role(v.feat, FEAT)["id"].columns
    return v.feat.select(*routed, *units.names(FEAT, where=lambda x: x.use.in_model and x.name != "n_price"))


@query("rename_align", "select id, a_price price, any_f outcome from feat")
def _(v):
    return select.align_columns(v.feat, {"a_price": "price", "any_f": "outcome"}, ["id", "price", "absent", "outcome"])


@query("drop_sparse_columns", "select id, r_min, r_max, a_price, n_price, disc, tax, n_lines, any_f from feat")
def _(v):
    return select.drop_sparse(v.feat, 0.3)


@query("align_feature_space", "select id, tax, null::double absent, r_max from coh_b")
def _(v):
    return select.align_space(v.coh_b, ["tax", "absent", "r_max"], keep=["id"])


@query("model_matrix", "select r_max, a_price, tax, n_lines, any_f, coalesce(odd::integer, 0) odd from (select *, case when rf_qty > 25 then true end odd from feat)")
def _(v):
    wide = v.feat.withColumns({"odd": F.when(F.col("rf_qty") > 25, True), "name": F.lit("x")})
    return select.model_matrix(wide.drop("r_min", "n_price", "disc", "rf_qty"), ["id"], ["odd", "any_f"])


# joins


@query("cohort_base", """select stay_id, subject_id, los, n_name, r_name, height from stays join nation on nation = n_nationkey join region on n_regionkey = r_regionkey
  left join (select p_partkey stay_id, p_size height from part) using (stay_id) where los >= 2""")
def _(v):
    nation = v.table("nation").withColumnRenamed("n_nationkey", "nation")
    region = v.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
    height = v.table("part").select(F.col("p_partkey").alias("stay_id"), F.col("p_size").alias("height"))
    return joins.build_cohort(v.stays, [(height, "stay_id", "left")], [(nation, "nation"), (region, "n_regionkey")], F.col("los") >= 2).select("stay_id", "subject_id", "los", "n_name", "r_name", "height")


_BLOCKS = {"R": "sum", "A": "max", "N": "count"}


@query("assemble_features", """select o_orderkey id, r_value, a_value, coalesce(n_value, 0) n_value from orders
  left join (select l_orderkey o_orderkey, sum(l_quantity) r_value from lineitem where l_returnflag = 'R' group by 1) using (o_orderkey)
  left join (select l_orderkey o_orderkey, max(l_quantity) a_value from lineitem where l_returnflag = 'A' group by 1) using (o_orderkey)
  left join (select l_orderkey o_orderkey, count(l_quantity) n_value from lineitem where l_returnflag = 'N' group by 1) using (o_orderkey)""")
def _(v):
    made = {"sum": F.sum, "max": F.max, "count": F.count}
    blocks = [v.table("lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("id")).agg(made[how]("l_quantity").alias(f"{f.lower()}_value")) for f, how in _BLOCKS.items()]
    return joins.assemble(v.table("orders").select(F.col("o_orderkey").alias("id")), blocks, "id", ["n_value"])


@query("cohort_semi_join", "select l_orderkey, l_partkey, l_quantity from lineitem where l_orderkey in (select stay_id from stays where segment = 'BUILDING' and los >= 1)")
def _(v):
    cohort = v.stays.where("segment = 'BUILDING' and los >= 1").select(F.col("stay_id").alias("l_orderkey"))
    return joins.semi(v.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), cohort, "l_orderkey")


@query("window_exists_flag", "select user_id, max(case when item = 'error' and ts <= t0 + interval 12 hour then 1 else 0 end) early_error from idx left join obs using (user_id, t0) group by 1")
def _(v):
    rows = v.obs.where(F.col("ts") <= F.col("t0") + F.expr("interval 12 hours"))
    return joins.exists_in_window(v.idx.select("user_id"), rows, "user_id", "early_error", F.col("item") == "error")


def _hourly(v: Views, kind: str, name: str) -> DataFrame:
    e = v.table("events").where(F.col("event_type") == kind)
    return e.groupBy("user_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.max("value").alias(name))


_HOURLY = "(select user_id, date_trunc('hour', ts)::timestamp as hour, max(value) {1} from events where event_type = '{0}' group by all)"


@query("same_instant_join", f"select a.*, spo2 from {_HOURLY.format('click', 'po2')} a left join {_HOURLY.format('view', 'spo2')} b using (user_id, hour)")
def _(v):
    return joins.join_same_time(_hourly(v, "click", "po2"), _hourly(v, "view", "spo2"), ["user_id", "hour"])


@query("fanout_safe_min", f"""select o_orderkey id, {rd('coalesce(a, b) value')} from orders left join (select l_orderkey o_orderkey, min(l_extendedprice) a from lineitem where l_returnflag = 'A' group by 1) using (o_orderkey)
  left join (select l_orderkey o_orderkey, min(l_extendedprice) * 0.9::double b from lineitem where l_returnflag = 'N' group by 1) using (o_orderkey)""")
def _(v):
    rows = v.table("lineitem").withColumnRenamed("l_orderkey", "id")
    a, b = (rows.where(F.col("l_returnflag") == f).select("id", "l_extendedprice") for f in "AN")
    return r6(joins.combine_reduced(v.table("orders").select(F.col("o_orderkey").alias("id")), a, b, "id", "l_extendedprice", "l_extendedprice", 0.9, "value"))


# aggregations


@query("cohort_counts", "select count(*) n_rows, count(distinct stay_id) n_stay_id, count(distinct subject_id) n_subject_id, count(distinct nation) n_nation from stays")
def _(v):
    return events.attrition_counts(v.stays, ["stay_id", "subject_id", "nation"])


_PIVOT = {"click_min": (["click"], "min"), "click_max": (["click"], "max"), "web_avg": (["click", "view"], "avg"), "err_n": (["error"], "count")}


@query("pivot_by_code", f"select user_id, min(value) filter (item = 'click') click_min, max(value) filter (item = 'click') click_max, {rd('avg(value) filter (item in (\'click\', \'view\')) web_avg')}, count(value) filter (item = 'error') err_n from obs group by 1")
def _(v):
    return r6(events.pivot_codes(v.obs, "user_id", "item", "value", _PIVOT))


@query("median_per_entity", "select l_partkey, round(median(l_extendedprice), 6) median from lineitem group by 1")
def _(v):
    return r6(events.entity_median(v.table("lineitem"), "l_partkey", "l_extendedprice"))


_H = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::double"


@query("range_slope", f"select user_id, item, count(value) n, {rd(f'case when count(value) >= 3 and {_H} > 0.5 then (max(value) - min(value)) / ({_H}) end slope')} from obs group by 1, 2")
def _(v):
    return r6(events.range_slope(v.obs, ["user_id", "item"], "ts", "value"))


@query("daily_max", "select user_id, ts::date as day, max(value) filter (item = 'click') click, max(value) filter (item = 'view') as view from obs where ts < t0 + interval 7 day group by 1, 2")
def _(v):
    rows = v.obs.where(F.col("ts") < F.col("t0") + F.expr("interval 7 days"))
    return events.daily_max(rows, "user_id", "ts", {k: F.when(F.col("item") == k, F.col("value")) for k in ("click", "view")})


@query("persistence_label", """with daily as (select user_id, ts::date as day, max(value) filter (item = 'click') click, max(value) filter (item = 'view') as view from obs group by 1, 2),
  p as (select user_id, (sum((click >= 60)::integer) >= 2)::integer c, (sum((view >= 40)::integer) >= 2)::integer w from daily group by 1)
  select user_id, coalesce(c, 0) persistent_click, coalesce(w, 0) persistent_view, greatest(coalesce(c, 0), coalesce(w, 0)) persistent_any from idx left join p using (user_id)""")
def _(v):
    daily = events.daily_max(v.obs, "user_id", "ts", {k: F.when(F.col("item") == k, F.col("value")) for k in ("click", "view")})
    return events.persistence(daily, "user_id", {"click": 60, "view": 40}, 2, v.idx)


@query("prefix_flags", "select hadm, max((code like 'Brand#1%' or code like 'Brand#25%')::integer) heart, max((code like 'Brand#3%')::integer) kidney from dx group by 1")
def _(v):
    return events.prefix_flags(v.dx, "hadm", "code", {"heart": ["Brand#1", "Brand#25"], "kidney": ["Brand#3"]})


@query("text_flags", "select hadm, max((text ilike '%RING%' or text ilike 'hot%')::integer) warm, max((text ilike '%old%')::integer) aged from dx group by 1")
def _(v):
    return events.text_flags(v.dx, "hadm", "text", {"warm": ["%RING%", "hot%"], "aged": ["%old%"]})


_OUT = "(select any_f a, (r_max > 40)::integer b, (tax >= 0.08)::integer c from feat)"


@query("outcome_overlap", f"""select count(*) n, sum(a)::bigint n_a, sum(b)::bigint n_b, sum(c)::bigint n_c, {', '.join(f"count(*) filter ({x} = 1 and {y} = 1) {x}_and_{y}" for x, y in ('ab', 'ac', 'bc'))},
  {', '.join(f"count(*) filter ({x} = 1 and coalesce({y}, 0) <> 1) {x}_not_{y}" for x in 'abc' for y in 'abc' if x != y)} from {_OUT}""")
def _(v):
    flags = v.feat.select(F.col("any_f").alias("a"), (F.col("r_max") > 40).cast("int").alias("b"), (F.col("tax") >= 0.08).cast("int").alias("c"))
    return events.outcome_summary(flags, ["a", "b", "c"])


_WIDE = [*NUMBERS, "rf_qty"]


@query("fill_rates", stack(_WIDE, f"select '{{c}}' feature, count({{c}}) n, {rd('count({c}) * 100.0 / count(*) fill_rate')} from feat"))
def _(v):
    return r6(profile.fill_rates(v.feat, _WIDE))


@query("cohort_audit", "select count(*) n_rows, count(distinct id) n_entities, " + rd("avg(any_f) * 100 any_f_pct") + ", " + ", ".join(rd(f"avg({c}) {c}_mean", f"min({c}) {c}_min", f"max({c}) {c}_max", f"median({c}) {c}_median") for c in ("r_max", "n_price")) + " from feat")
def _(v):
    return r6(profile.cohort_audit(v.feat, ["any_f"], ["r_max", "n_price"], "id"))


@query("numeric_profile", stack(_WIDE, f"select '{{c}}' feature, {rd('avg(({c} is null)::integer) * 100 missing_pct', 'coalesce(median({c}), 0) median', 'coalesce(avg({c}), 0) mean', 'coalesce(max({c}), 0) max')} from feat"))
def _(v):
    return r6(profile.numeric_profile(v.feat, _WIDE))


_Z = ["r_max", "a_price", "any_f"]


@query("standardisation_audit", "with z as (select " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () {c}" for c in _Z) + " from feat) " + stack(_Z, f"select '{{c}}' feature, {rd('avg({c}) mean', 'stddev_samp({c}) std', 'abs(avg({c})) abs_mean', 'abs(stddev_samp({c}) - 1) abs_std_off')}, (count(distinct {{c}}) <= 2)::integer is_binary from z"))
def _(v):
    return r6(profile.standardisation_audit(cleaning.apply_scaler(v.feat, cleaning.fit_scaler(v.feat, _Z)), _Z))


@query("class_balance", f"select toxic as class, count(*) n, {rd('count(*) / sum(count(*)) over () rate', 'sum(count(*)) over () / (count(*) over () * count(*)) weight')} from labels where toxic is not null group by 1")
def _(v):
    return r6(profile.class_balance(v.table("labels"), "toxic"))


@query("missing_pattern", "with m as (" + stack(_WIDE, f"select '{{c}}' item, {rd('avg(({c} is null)::integer) v')} from feat") + "), p as (select " + " || ".join(f"({c} is null)::integer::varchar" for c in _WIDE) + " item, count(*) n from feat group by 1) select 'rate' kind, item, v as value, row_number() over (order by v desc, item)::integer as rank from m union all select 'pattern', item, n::double, 0 from p")
def _(v):
    rates, patterns = profile.missing_patterns(v.feat, _WIDE)
    a = rates.select(F.lit("rate").alias("kind"), F.col("feature").alias("item"), F.col("missing_rate").alias("value"), "rank")
    return r6(a.union(patterns.select(F.lit("pattern"), "pattern", F.col("n").cast("double"), F.lit(0))))


@query("importance_pivot", f"with m as (select p_brand feature, avg(x) filter (f = 'A') a, avg(x) filter (f = 'N') n, avg(x) filter (f = 'R') r from (select p_brand, l_returnflag f, l_extendedprice * (1 - l_discount) x from lineitem join part on l_partkey = p_partkey) group by 1) select feature, {rd('a A', 'n N', 'r R', '(coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0)) / 3 mean_importance', places=4)} from m order by (coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0)) / 3 desc, feature limit 10")
def _(v):
    l, p = v.table("lineitem"), v.table("part").select("p_partkey", "p_brand")
    rows = l.join(p, l.l_partkey == p.p_partkey).select("p_brand", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return r6(profile.importance_pivot(rows, "p_brand", "l_returnflag", "x", ["A", "N", "R"], 10), 4)


_SPECS = [{"name": f"{k}_{h}", "item": k, "how": h, "hours": n} for k, n in (("click", 96), ("view", 168)) for h in ("first", "last", "min", "max", "mean", "median", "slope", "trend", "count")]


def _anchored_sql() -> str:
    """Counts and first values after the first signup, and means after the first purchase."""
    h = lambda a: f"(epoch_us(ts) - epoch_us({a})) / 3600000000.0::double"
    return f"""with p as (select user_id, min(ts) t1 from events where event_type = 'purchase' group by 1), c as (select idx.user_id, t0, t1 from idx left join p using (user_id)),
      f as (select c.user_id, event_type item, value v, {h('t0')} h0, {h('t1')} h1 from events join c using (user_id) where value is not null)
      select c.user_id, {rd("arg_min(v, struct_pack(h0 := h0, v := v)) filter (item = 'click' and h0 between 0 and 96) first_click", "avg(v) filter (item = 'view' and h1 between 0 and 48) mean_view", "max(v) filter (item = 'click' and h1 between 0 and 24) max_click")}
      from c left join f using (user_id) group by 1"""


_ANCHORED = units.registry_of(*[units.Variable(n, units.Use(domain=i), units.Measure(how=how, hours=h, anchor=a)) for n, i, how, h, a in (("first_click", "click", "first", 96.0, None), ("mean_view", "view", "mean", 48.0, "t1"), ("max_click", "click", "max", 24.0, "t1"))])


@query("temporal_aggregate_anchors", _anchored_sql())
def _(v):
    facts = v.table("events").select("user_id", "ts", F.col("event_type").alias("item"), "value")
    bought = facts.where("item = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("t1"))
    cohort = v.idx.join(bought, "user_id", "left")
    return r6(events.aggregate_registry(facts, cohort, "user_id", "ts", "t0", "item", "value", _ANCHORED, {"first_click": "click", "mean_view": "view", "max_click": "click"}))


def _temporal_sql() -> str:
    made = {
        "first": "arg_min(v, struct_pack(h := h, v := v))", "last": "arg_max(v, struct_pack(h := h, v := v))", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "median(v)", "count": "count(v)",
        "slope": "case when max(h) > min(h) then (arg_max(v, struct_pack(h := h, v := v)) - arg_min(v, struct_pack(h := h, v := v))) / (max(h) - min(h)) end", "trend": "case when max(h) > min(h) then regr_slope(v, h) end",
    }
    parts = []
    for k, n in (("click", 96), ("view", 168)):
        cols = ", ".join(f"{made[s['how']]} as {s['name']}" for s in _SPECS if s["item"] == k)
        parts.append(f"(select user_id, {cols} from (select user_id, value v, (epoch_us(ts) - epoch_us(t0)) / 3600000000.0::double h from obs where item = '{k}') where h <= {n} group by 1)")
    out = ", ".join(f"coalesce({s['name']}, 0) {s['name']}" if s["how"] == "count" else rd(s["name"]) for s in _SPECS)
    return f"select user_id, {out} from (select user_id from idx) left join {parts[0]} using (user_id) left join {parts[1]} using (user_id)"


_TIMED = units.registry_of(*[units.Variable(s["name"], units.Use(domain=s["item"]), units.Measure(how=s["how"], hours=float(s["hours"]))) for s in _SPECS])


@query("temporal_aggregate_registry", _temporal_sql())
def _(v):
    out = events.aggregate_registry(v.obs.drop("t0"), v.idx, "user_id", "ts", "t0", "item", "value", _TIMED, {s["name"]: s["item"] for s in _SPECS})
    return r6(out.fillna(0, [s["name"] for s in _SPECS if s["how"] == "count"]))


@query("temporal_aggregate", _temporal_sql())
def _(v):
    out = events.temporal_aggregate(v.obs.drop("t0"), v.idx, "user_id", "ts", "t0", "item", "value", _SPECS)
    return r6(out.fillna(0, [s["name"] for s in _SPECS if s["how"] == "count"]))


# windows


@query("first_event_filter_then_rank", "select stay_id, subject_id, los, segment from (select *, row_number() over (partition by subject_id order by intime, stay_id) k from stays where los >= 1) where k = 1")
def _(v):
    return events.first_event(v.stays, "subject_id", [F.asc("intime"), F.asc("stay_id")], where=F.col("los") >= 1).select("stay_id", "subject_id", "los", "segment")


@query("first_event_rank_then_filter", "select stay_id, subject_id, los, segment from (select *, row_number() over (partition by subject_id order by priority, intime, stay_id) k from stays) where k = 1 and los >= 1")
def _(v):
    return events.first_event(v.stays, "subject_id", [F.asc("priority"), F.asc("intime"), F.asc("stay_id")], having=F.col("los") >= 1).select("stay_id", "subject_id", "los", "segment")


_ENDS = "arg_min(value, struct_pack(t := ts, v := value)) f, arg_max(value, struct_pack(t := ts, v := value)) l, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::double h"


@query("signed_slope", f"select user_id, item, {rd('case when h > 0 then (l - f) / h else 0 end slope')} from (select user_id, item, {_ENDS} from obs group by 1, 2)")
def _(v):
    return r6(events.signed_slope(v.obs, ["user_id", "item"], "ts", "value"))


@query("window_first_last", f"select user_id, item, f first_value, l last_value, {rd('h span_h')} from (select user_id, item, {_ENDS} from obs group by 1, 2)")
def _(v):
    return r6(events.window_endpoints(v.obs, ["user_id", "item"], "ts", "value"))


# derived columns

_AGE = "(select p_partkey, case when p_size > 45 then '> 89' when p_size % 7 = 0 then '' when p_size % 11 = 0 then 'abc' when p_size % 13 = 0 then null else p_size::varchar end age from part)"


@query("parse_age", f"select p_partkey, case when age = '> 89' then 90 when regexp_full_match(age, '[0-9]+') then age::integer else 0 end age, 2024 - 2000 + 3 age_at from {_AGE}")
def _(v):
    size = F.col("p_size")
    text = F.when(size > 45, "> 89").when(size % 7 == 0, "").when(size % 11 == 0, "abc").when(size % 13 == 0, F.lit(None)).otherwise(size.cast("string"))
    at = derive.age_at(F.lit("2024-05-06").cast("date"), F.lit(2000), F.lit(3))
    return v.table("part").select("p_partkey", derive.parse_age(text).alias("age"), at.alias("age_at"))


_HEIGHT = "case when p_size % 5 = 0 then 0 else p_size * 4.0::double end"


@query("guarded_bmi", f"""select p_partkey, {rd("b bmi", "case when b between 10 and 60 then b end plausible_bmi")} from (select p_partkey, w / pow(h / 100, 2) b from
  (select p_partkey, p_retailprice / 10 w, case when {_HEIGHT} > 0 then {_HEIGHT} when p_size % 2 = 0 then 170.0::double end h from part))""")
def _(v):
    h = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_size") * 4.0)
    fallback = F.when(F.col("p_size") % 2 == 0, 170.0)
    w = F.col("p_retailprice") / 10
    return r6(v.table("part").select("p_partkey", derive.bmi(w, h, fallback).alias("bmi"), derive.bmi(w, h, fallback, 10, 60).alias("plausible_bmi")))


@query("unit_convert", "select l_orderkey, " + rd(*[f"sum(l_extendedprice * {f}::double) {n}" for n, f in units.FACTORS.items()], places=7) + ", " + rd("sum((l_extendedprice - 32) * 5 / 9) fahrenheit_to_celsius", "sum(l_extendedprice) wbc_to_si", "sum(l_extendedprice) as_is", places=3) + " from lineitem group by 1")
def _(v):
    x = F.col("l_extendedprice")
    names = [*units.FACTORS, "fahrenheit_to_celsius", "wbc_to_si"]
    out = v.table("lineitem").groupBy("l_orderkey").agg(*[F.sum(units.convert(x, n, strict=True)).alias(n) for n in names], F.sum(units.convert(x, "identity")).alias("as_is"))
    exact = r6(out.select("l_orderkey", *units.FACTORS), 7)
    return exact.join(r6(out.drop(*units.FACTORS), 3), "l_orderkey")


_RULES = [
    {"patterns": ["%click%"], "lo": 1, "hi": 40},
    {"patterns": ["%view%", "%click%"], "but": ["%x%"], "passes": False, "lo": 0.1, "hi": 30, "step": {"divide": 88.4, "over": 30}},
    {"patterns": ["%er%"], "passes": False, "lo": 1.0, "hi": 6.0, "step": {"divide": 10.0, "over": 10, "lo": 1.0, "hi": 6.0}},
    {"patterns": ["%P%"], "lo": 5, "hi": 150, "not_in": [7.0, 8.0]},
]


@query("unit_ladder", f"""select event_id, {rd('''case when item ilike '%click%' and value between 1 and 40 then value
  when (item ilike '%view%' or item ilike '%click%') and item not ilike '%x%' then case when value > 30 then value / 88.4::double when value between 0.1 and 30 then value end
  when item ilike '%er%' then case when value > 10 and value / 10 between 1 and 6 then value / 10 when value between 1 and 6 then value end
  when item ilike '%p%' and value between 5 and 150 and value not in (7.0, 8.0) then value end clean''')} from obs""")
def _(v):
    return r6(derive.clean_by_names(v.obs, "item", "value", _RULES).select("event_id", "clean"))


@query("guarded_ratios", f"select id, {rd('case when disc > 0 then tax / disc end guarded', 'case when r_min is not null then r_max / greatest(r_min, 5) end floored', 'r_max / nullif(r_min, 1) nulled')} from feat")
def _(v):
    c = F.col
    return r6(v.feat.select("id", derive.ratio(c("tax"), c("disc")).alias("guarded"), derive.ratio(c("r_max"), c("r_min"), 5.0).alias("floored"), F.try_divide(c("r_max"), F.nullif(c("r_min"), F.lit(1.0))).alias("nulled")))


_TEMP = "case when value between 80 and 115 then (value - 32) * 5 / 9 when value between 30 and 45 then value end"


@query("temperature_normalise", f"select user_id, {rd(f'min({_TEMP}) temp_min', f'max({_TEMP}) temp_max')} from events group by 1")
def _(v):
    t = derive.temp_c(F.col("value"))
    return r6(v.table("events").groupBy("user_id").agg(F.min(t).alias("temp_min"), F.max(t).alias("temp_max")))


_OXY = ", ".join(f"max(value) filter (event_type = '{k}') {n}" for k, n in (("click", "pao2"), ("view", "fio2"), ("error", "spo2")))
_FIO2 = "case when fio2 >= 21 then fio2 / 100 else 0.21::double end"


@query("oxygenation_ratio", f"select user_id, hour, {rd(f'coalesce(pao2 / {_FIO2}, spo2 / {_FIO2} * 0.9) ratio')} from (select user_id, date_trunc('hour', ts)::timestamp as hour, {_OXY} from events group by 1, 2)")
def _(v):
    parts = [_hourly(v, k, n) for k, n in (("click", "pao2"), ("view", "fio2"), ("error", "spo2"))]
    hours = v.table("events").select("user_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).distinct()
    for p in parts:
        hours = joins.join_same_time(hours, p, ["user_id", "hour"])
    return r6(hours.select("user_id", "hour", derive.pf_ratio(F.col("pao2"), F.col("fio2"), F.col("spo2")).alias("ratio")))


@query("henderson_hasselbalch", f"select id, {rd('case when r_max > 0 and r_min > 0 then 6.1 + log10(r_max / (0.0301 * r_min)) end ph')} from feat")
def _(v):
    return r6(v.feat.select("id", derive.derived_ph(F.col("r_max"), F.col("r_min")).alias("ph")))


@query("tiered_coalesce", "select id, coalesce(case when rf_qty between 10 and 40 then rf_qty end, case when r_max between 10 and 40 then r_max end, case when r_min between 10 and 40 then r_min end) tiered, coalesce(rf_qty, r_max) plain from feat")
def _(v):
    return v.feat.select("id", derive.tiered([F.col("rf_qty"), F.col("r_max"), F.col("r_min")], 10, 40).alias("tiered"), F.coalesce("rf_qty", "r_max").alias("plain"))


@query("three_valued_label", "select * from (select id, case when r_max > 40 or a_price > 90000 then 1 when r_max is null and a_price is null then null else 0 end label from feat) where label is not null")
def _(v):
    label = derive.label3([F.col("r_max") > 40, F.col("a_price") > 90000], [F.col("r_max"), F.col("a_price")])
    return v.feat.select("id", label.alias("label")).where("label is not null")


@query("time_to_event_labels", """select id, died_28d, early, greatest(died_28d, early) composite, offset_28d from (select o_orderkey id, case when d between o_orderdate and o_orderdate + interval 28 day then 1 else 0 end died_28d,
  case when d between o_orderdate + interval 24 hour and o_orderdate + interval 48 hour then 1 else 0 end early, case when date_diff('minute', o_orderdate, d) between 0 and 40320 then 1 else 0 end offset_28d
  from orders left join (select l_orderkey, min(l_shipdate) d from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey)""")
def _(v):
    death = v.table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("d"))
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t0")).join(death, "id", "left")
    late, early = derive.died_within(F.col("t0"), F.col("d"), "0 days", "28 days"), derive.died_within(F.col("t0"), F.col("d"), "24 hours", "48 hours")
    minutes = F.timestamp_diff("MINUTE", F.col("t0").cast("timestamp"), F.col("d").cast("timestamp"))
    return rows.select("id", late.alias("died_28d"), early.alias("early"), F.greatest(late, early).alias("composite"), F.when(minutes.between(0, 40320), 1).otherwise(0).alias("offset_28d"))


@query("competing_risk_override", """select id, early, case when early = 1 then 1 else outcome end outcome, case when early = 1 then 1 else mortality end mortality,
  (coalesce(early = 1 or outcome = 1, false) or coalesce(early = 1 or mortality = 1, false))::integer composite from (select id, (tax >= 0.08)::integer early, (r_max > 45)::integer outcome, any_f mortality from feat)""")
def _(v):
    flags = v.feat.select("id", (F.col("tax") >= 0.08).cast("int").alias("early"), (F.col("r_max") > 45).cast("int").alias("outcome"), F.col("any_f").alias("mortality"))
    return derive.override_labels(flags, "early", "outcome", "mortality", "composite")


@query("subgroup_flag", "select id, coalesce(r_min < 1.5 and any_f = 0, false)::integer both_rules, coalesce(r_min < 1.5, false)::integer value_only from feat")
def _(v):
    return v.feat.select("id", derive.subgroup(F.col("r_min"), 1.5, F.col("any_f")).alias("both_rules"), derive.subgroup(F.col("r_min"), 1.5).alias("value_only"))


@query("recode_mode_fill", """with c as (select l_orderkey, l_linenumber, case lower(l_returnflag) when 'a' then 0 when 'n' then 1 end code from lineitem),
  m as (select code m from c where code is not null group by 1 order by count(*) desc, code limit 1) select l_orderkey, l_linenumber, coalesce(code, m) code from c, m""")
def _(v):
    return derive.recode(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", {"A": 0, "N": 1}, "code").drop("l_returnflag")


@query("log1p_floor", f"select id, {rd('case when a_price is not null then ln(1 + greatest(a_price - 50000, 0)) end price', 'case when r_max is not null then ln(1 + greatest(r_max, 0)) end qty')} from feat")
def _(v):
    return r6(v.feat.select("id", derive.log1p_floor(F.col("a_price") - 50000).alias("price"), derive.log1p_floor(F.col("r_max")).alias("qty")))


@query("ci_format_parse", """select brand, text, regexp_extract_all(text, '\\d+\\.?\\d*')[1]::double est, regexp_extract_all(text, '\\d+\\.?\\d*')[2]::double lo, regexp_extract_all(text, '\\d+\\.?\\d*')[3]::double hi from
  (select p_brand brand, printf('%.6f (%.6f-%.6f)', avg(p_size), quantile_cont(p_size, 0.025), quantile_cont(p_size, 0.975)) as text from part group by 1)""")
def _(v):
    q = lambda p: F.percentile("p_size", F.lit(p))
    text = v.table("part").groupBy(F.col("p_brand").alias("brand")).agg(derive.format_ci(F.avg("p_size"), q(0.025), q(0.975), 6).alias("text"))
    return text.select("brand", "text", derive.parse_ci(F.col("text")).alias("x")).select("brand", "text", "x.*")


# cleaning

_REPAIR = {"disc": (1.0, 10.0), "r_max": (2.0, 10.0)}


@query("median_unit_repair", f"with m as (select median(disc) d, median(r_max) r from feat) select id, {rd('case when d < 0.2 then disc * 10 else disc end disc', 'case when r < 0.4 then r_max * 10 else r_max end r_max')} from feat, m")
def _(v):
    return r6(cleaning.repair_units(v.feat.select("id", "disc", "r_max"), _REPAIR))


_BOUNDS = {n: s.prepare.bounds for n, s in FEAT.items() if s.prepare.bounds}


def _within(c: str) -> str:
    return f"{c} between {_BOUNDS[c][0]} and {_BOUNDS[c][1]}"


@query("hard_bounds", "select 'kept' kind, c feature, count(x) n, " + rd("sum(x) total", places=3) + " from (" + " union all ".join(f"select '{c}' c, case when {_within(c)} then {c} end x from feat" for c in _BOUNDS) + ") group by 2 union all " + " union all ".join(f"select 'removed', '{c}', count(*) filter (not {_within(c)}), null from feat" for c in _BOUNDS))
def _(v):
    clean, counts = cleaning.hard_bounds(v.feat, _BOUNDS)
    kept = stats.melt(clean, [], list(_BOUNDS)).groupBy("feature").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return r6(kept.select(F.lit("kept").alias("kind"), "feature", "n", "total").union(counts.select(F.lit("removed"), "feature", "removed", F.lit(None).cast("double"))), 3)


@query("clamp_bounds", "select id, " + rd(*[f"case when {c} is not null then least(greatest({c}, {lo}), {hi}) end {c}" for c, (lo, hi) in _BOUNDS.items()]) + " from feat")
def _(v):
    return r6(cleaning.clamp(v.feat, _BOUNDS).select("id", *_BOUNDS))


def _clipped(c: str) -> str:
    return f"case when {c} is not null then least(greatest({c}, quantile_cont({c}, 0.01) over ()), quantile_cont({c}, 0.99) over ()) end {c}"


@query("winsorize", f"select id, {rd(_clipped('a_price'), _clipped('n_price'), _clipped('r_max'), places=7)}, any_f, rf_qty from feat")
def _(v):
    out = cleaning.winsorize(v.feat, ["a_price", "n_price", "r_max", "any_f", "rf_qty"], exclude=("rf_qty",))
    return r6(out.select("id", "a_price", "n_price", "r_max", "any_f", "rf_qty"), 7)


_CONVERTED = {n: s for n, s in FEAT.items() if s.measure.convert and s.measure.plausible}
_FACTOR = {n: units.FACTORS[s.measure.convert] for n, s in _CONVERTED.items()}
_KIND = "case when p_inv - p_raw >= 0.3 and p_inv >= 0.7 then 'unit_si' when p_inv - p_raw <= -0.3 and p_raw >= 0.7 then 'unit' else 'ambiguous' end"
_INFER = " union all ".join(f"select '{n}' feature, avg(({n} between {s.measure.plausible[0]} and {s.measure.plausible[1]})::integer) p_raw, avg(({n} * {_FACTOR[n]} between {s.measure.plausible[0]} and {s.measure.plausible[1]})::integer) p_inv from feat" for n, s in _CONVERTED.items())


@query("infer_units", f"select feature, {rd('p_raw', 'p_inv', 'p_inv - p_raw delta_p')}, {_KIND} inferred_unit, case when {_KIND} = 'ambiguous' then 'medium' else 'high' end confidence from ({_INFER})")
def _(v):
    return r6(cleaning.infer_units(v.feat, FEAT))


@query("infer_units_inverse", f"select feature, {rd('p_raw', 'p_inv', 'p_inv - p_raw delta_p')}, {_KIND} inferred_unit, case when {_KIND} = 'ambiguous' then 'medium' else 'high' end confidence from ({_INFER.replace(' * ', ' / ')})")
def _(v):
    return r6(cleaning.infer_units(v.feat, FEAT, direction="inverse"))


def _inferred(v: Views) -> dict[str, str]:
    return {r["feature"]: r["inferred_unit"] for r in cleaning.infer_units(v.feat, FEAT).collect()}


_PATCHED = " union all ".join(f"select id, '{n}' feature, x, x * {_FACTOR[n]} again, not (x between {s.measure.plausible[0]} and {s.measure.plausible[1]}) and x * {_FACTOR[n]} between {s.measure.plausible[0]} and {s.measure.plausible[1]} fix, kind from (select id, kind, case when kind = 'unit_si' then {n} * {_FACTOR[n]} else {n} end x from feat, (select {_KIND} kind from inferred where feature = '{n}'))" for n, s in _CONVERTED.items())


@query("patch_units", f"""with inferred as ({_INFER}), patched as ({_PATCHED}) select feature, max((kind = 'unit_si')::integer) global_converted, count(*) filter (fix) inverse_patched, 0 forward_patched,
  {rd('sum(case when fix then again else x end) total', places=3)} from patched group by 1""")
def _(v):
    fixed, audit = cleaning.patch_units(v.feat, FEAT, _inferred(v))
    totals = stats.melt(fixed, [], list(_CONVERTED)).groupBy("feature").agg(F.sum("value").alias("total"))
    return r6(audit.join(totals, "feature"), 3)


@query("align_si", "select id, " + rd(*[f"{n} * {f}::double {n}" for n, f in _FACTOR.items()], places=9) + " from feat")
def _(v):
    return r6(units.align_to_si(v.feat, FEAT).select("id", *_FACTOR), 9)


_RANGES = {n: s.measure.plausible for n, s in FEAT.items() if s.measure.plausible}


@query("plausibility_audit", " union all ".join(f"select '{c}' feature, {rd(f'avg(({c} between {lo} and {hi})::integer) in_range', f'quantile_cont({c}, 0.05) p5', f'quantile_cont({c}, 0.5) p50', f'quantile_cont({c}, 0.95) p95')}, (avg(({c} between {lo} and {hi})::integer) < 0.8)::integer implausible from feat" for c, (lo, hi) in _RANGES.items()))
def _(v):
    return r6(cleaning.plausibility_audit(v.feat, _RANGES, approximate=cleaning.RANGES))


def _report_sql() -> str:
    q = lambda x: "null" if x is None else f"'{x}'"
    rows = ", ".join(f"({q(s.name)}, {q(s.use.role)}, {q(s.measure.unit_si if s.measure.convert else s.measure.unit)}, {int(s.prepare.bounds is not None)}, {int(s.prepare.log)}, {int(s.prepare.zscore)}, {q(s.prepare.impute or 'median')})" for s in FEAT.values())
    removed = " union all ".join(f"select '{c}' feature, count(*) filter (not {_within(c)}) removed from feat" for c in _BOUNDS)
    return f"""with inferred as (select feature, p_raw, p_inv, {_KIND} kind0 from ({_INFER})), kinds as (select feature, kind0 from inferred), patched as ({_PATCHED.replace(_KIND + " kind", "kind0 kind")}),
      fixes as (select feature, count(*) filter (fix) patched from patched group by 1), gone as ({removed}), reg(name, role, unit, hard_clip, log, z, impute) as (values {rows})
      select name feature, role, coalesce(kind0, 'unit') inferred_unit, case when kind0 = 'unit_si' then 'converted' else 'kept' end as action, coalesce(patched, 0) patched, coalesce(removed, 0) removed, hard_clip::integer hard_clip, log::integer as log, z::integer z, impute, unit final_unit
      from reg left join kinds k on k.feature = name left join fixes x on x.feature = name left join gone g on g.feature = name"""


@query("cleaning_report", _report_sql())
def _(v):
    inferred = cleaning.infer_units(v.feat, FEAT)
    _, audit = cleaning.patch_units(v.feat, FEAT, {r["feature"]: r["inferred_unit"] for r in inferred.collect()})
    _, removed = cleaning.hard_bounds(v.feat, _BOUNDS)
    decisions = removed.join(inferred.select("feature", "inferred_unit"), "feature", "full").join(audit.select("feature", "inverse_patched"), "feature", "full")
    return cleaning.cleaning_report(units.registry_table(v.spark, FEAT), decisions)


_METHODS = {n: s.prepare.impute or "median" for n, s in FEAT.items() if s.prepare.zscore}
_AGG = {"median": "median({c})", "mean": "avg({c})", "constant_zero": "0"}


@query("simple_impute", "with f as (select " + ", ".join(f"{_AGG[m].format(c=c)} f_{c}" for c, m in _METHODS.items()) + " from coh_a) select id, " + rd(*[f"coalesce({c}, f_{c}) {c}" for c in _METHODS]) + " from coh_b, f")
def _(v):
    fill = cleaning.fit_imputer(v.coh_a, _METHODS)
    return r6(cleaning.apply_imputer(v.coh_b, fill).select("id", *_METHODS))


@query("chained_imputation")
def _(v):
    m = cleaning.fit_mice(v.coh_a, NUMBERS, sweeps=5)
    return r6(cleaning.apply_mice(v.coh_b, m).select("id", *NUMBERS))


@query("zscore_fit_apply", "with s as (select " + ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) p_{c}, stddev_samp({c}) s_{c}" for c in NUMBERS) + " from coh_a) select id, " + rd(*[f"({c} - m_{c}) / p_{c} {c}" for c in NUMBERS], *[f"({c} - m_{c}) / s_{c} {c}_sample" for c in NUMBERS]) + " from coh_b, s")
def _(v):
    a, b = (cleaning.fit_scaler(v.coh_a, NUMBERS, d) for d in (0, 1))
    both = cleaning.apply_scaler(v.coh_b, a).join(cleaning.apply_scaler(v.coh_b, b).select("id", *[F.col(c).alias(f"{c}_sample") for c in NUMBERS]), "id")
    return r6(both.select("id", *NUMBERS, *[f"{c}_sample" for c in NUMBERS]))


def _split(source: str, y: str, key: str) -> str:
    h = f"('0x' || substr(md5({key}::varchar || ':42'), 1, 8))::ubigint / 4294967296.0::double"
    return f"(row_number() over (partition by {y} order by {h}, {key}) <= round(count(*) over (partition by {y}) * 0.8::double))::integer is_train"


@query("stratified_split", f"select stay_id, status, {_split('stays', 'status', 'stay_id')} from stays")
def _(v):
    return cleaning.stratified_split(v.stays.select("stay_id", "status"), "status", "stay_id")


_MODEL = [s.name for s in FEAT.values() if s.use.role in ("feature", "confounder") and s.use.in_model]
_SHOWN = [s for s in FEAT.values() if s.use.role in ("feature", "confounder", "outcome", "group")]
_COUNTS = ("n_lines", "any_f", "rf_qty")  # columns that aren't doubles


@query("bifurcate", f"select id, any_f, n_lines, {_split('feat', 'any_f', 'id')}, " + rd(*[c for c in _MODEL if c != "n_lines"], places=9) + " from feat")
def _(v):
    return r6(cleaning.bifurcate(v.feat, FEAT, "any_f", "id")[1], 9)


@query("bifurcate_report", "select " + ", ".join(s.name if s.name in _COUNTS else rd(f"{s.name} * {_FACTOR.get(s.name, 1.0)}::double {s.name}", places=9) for s in _SHOWN) + " from feat")
def _(v):
    return r6(cleaning.bifurcate(v.feat, FEAT, "any_f", "id")[0], 9)


def _flow_sql() -> str:
    """The flow step by step: units, bounds, split, fill, logarithm, scale."""
    kind = lambda n: f"(select {_KIND} from inferred where feature = '{n}')"
    unit, fixed, bounded = [], [], []
    for n in (c for c in _MODEL if c != "n_lines"):
        lo, hi = FEAT[n].measure.plausible or (0, 0)
        f = _FACTOR.get(n)
        unit.append(f"case when {kind(n)} = 'unit_si' then {n} * {f} else {n} end {n}" if f else n)
        fixed.append(f"case when not ({n} between {lo} and {hi}) and {n} * {f} between {lo} and {hi} then {n} * {f} else {n} end {n}" if f else n)
        bounded.append(f"case when {_within(n)} then {n} end {n}" if n in _BOUNDS else n)
    names = [c for c in _MODEL if c != "n_lines"]
    fill = {n: _AGG[FEAT[n].prepare.impute].format(c=n) for n in names if FEAT[n].prepare.impute}
    filled = [f"coalesce({n}, f_{n}, 0) {n}" if n in fill else n for n in names]  # 0 where training rows have no value
    scaled = [n for n in names if FEAT[n].prepare.zscore]
    value = {n: f"case when {n} is not null then ln(1 + greatest({n}, 0)) end" if FEAT[n].prepare.log else n for n in names}
    last = [f"({value[n]} - m_{n}) / s_{n} {n}" if n in scaled else f"{value[n]} {n}" for n in names]
    return f"""with inferred as ({_INFER}), u as (select id, any_f, n_lines, {', '.join(unit)} from feat), x as (select id, any_f, n_lines, {', '.join(fixed)} from u),
      b as (select id, any_f, n_lines, {', '.join(bounded)} from x), m as (select *, {_split('b', 'any_f', 'id')} from b where any_f is not null),
      f as (select {', '.join(f'{e} f_{n}' for n, e in fill.items())} from m where is_train = 1), i as (select id, any_f, n_lines, is_train, {', '.join(filled)} from m, f),
      s as (select {', '.join(f'avg({n}) m_{n}, coalesce(nullif(stddev_samp({n}), 0), 1) s_{n}' for n in scaled)} from i where is_train = 1)
      select id, any_f, n_lines, is_train, {rd(*last)} from i, s"""


@query("cleaning_flow", _flow_sql())
def _(v):
    return r6(flows.clean_cohort(v.feat, FEAT, "any_f", "id").model)


_LOGS = ["a_price", "n_price"]


def _assets_sql() -> str:
    logged = ", ".join(f"case when {c} is not null then ln(1 + greatest({c}, 0)) end {c}" if c in _LOGS else c for c in NUMBERS)
    fills = ", ".join(f"median({c}) f_{c}" for c in NUMBERS)
    scales = ", ".join(f"avg(coalesce({c}, f_{c})) m_{c}, stddev_pop(coalesce({c}, f_{c})) s_{c}" for c in NUMBERS)
    return f"with a as (select id, {logged} from coh_a), b as (select id, {logged}, any_f from coh_b), f as (select {fills} from a), s as (select {scales} from a, f) select id, any_f, " + rd(*[f"(coalesce({c}, f_{c}) - m_{c}) / s_{c} {c}" for c in NUMBERS]) + " from b, f, s"


@query("transfer_assets", _assets_sql())
def _(v):
    path = tables.scratch(v.spark, "assets")
    cleaning.fit_assets(v.coh_a, NUMBERS, _LOGS, approximate=cleaning.RANGES).save(v.spark, path)
    assets = cleaning.load_assets(v.spark, path)
    return r6(cleaning.replay(v.coh_b, assets, ["id"], ("any_f",)).select("id", "any_f", *NUMBERS))


_LIMITS = {"r_min": flows.Limits(2.0, 45.0), "r_max": flows.Limits(5.0, 48.0), "a_price": flows.Limits(2000.0, 90000.0), "n_price": flows.Limits(3000.0), "disc": flows.Limits(1.0, 9.0, 100.0), "r_other": flows.Limits(0.0, 1.0)}
_CHOSEN = {"any_f": ["r_max", "disc", "a_price"], "taxed": ["r_min", "n_price", "tax"]}


def _external_sql() -> str:
    frozen = _assets_sql().split(" select id, any_f, ")[0].replace("b as (select id, ", "b0 as (select id, ")
    used = [c for c in _LIMITS if c != "r_other"]
    both = {c: m for c, m in _LIMITS.items() if c in used and m.hi is not None}
    mended = ", ".join(f"{c} * (case when (select median({c}) from coh_b) < 0.2 * {m.lo} then {m.factor} else 1 end) {c}" if m.factor != 1 else c for c, m in _LIMITS.items() if c in used)
    bounded = ", ".join(f"case when {c} between {both[c].lo} and {both[c].hi} then {c} end {c}" if c in both else c for c in used)
    edges = ", ".join(f"quantile_cont({c}, 0.01) lo_{c}, quantile_cont({c}, 0.99) hi_{c}" for c in used)
    clipped = {c: f"case when {c} is not null then least(greatest({c}, lo_{c}), hi_{c}) end" for c in used}
    logged = {c: f"case when {c} is not null then ln(1 + greatest({clipped[c]}, 0)) end" if c in _LOGS else clipped[c] for c in used} | {"tax": "null::double"}
    own = "id, any_f, taxed, (r_low)::integer r_low"
    z = ", ".join(f"(coalesce({logged[c]}, f_{c}) - m_{c}) / s_{c} {c}" for fs in _CHOSEN.values() for c in fs)
    parts = " union all ".join(f"select '{o}' outcome, id, any_f, taxed, r_low, {rd(*[c if c in _CHOSEN[o] else f'null {c}' for fs in _CHOSEN.values() for c in fs])} from z" for o in _CHOSEN)
    return f"""{frozen}, u as (select id, any_f, (tax >= 0.04)::integer taxed, coalesce(r_max < 20, false) r_low, {mended} from coh_b), x as (select id, any_f, taxed, r_low, {bounded} from u), e as (select {edges} from x),
      z as (select {own}, {z} from x, e, f, s) {parts}"""


@query("external_cleaning_flow", _external_sql())
def _(v):
    """Assets and the selection of one cohort, stored and read back, prepare the other one for each outcome."""
    kept, handed = tables.scratch(v.spark, "assets"), tables.scratch(v.spark, "selection")
    cleaning.fit_assets(v.coh_a, NUMBERS, _LOGS, approximate=cleaning.RANGES).save(v.spark, kept)
    rows = [(o, f, float(len(fs) - i), 1.0, 1.0) for o, fs in _CHOSEN.items() for i, f in enumerate(fs)]
    tables.write_selection(v.spark.createDataFrame(rows, "outcome string, feature string, weight double, best_c double, best_lambda double"), handed)
    other = v.coh_b.withColumn("taxed_28d", (F.col("tax") >= 0.04).cast("int"))
    got = flows.prepare_external(other, _LIMITS, tables.read_selection(v.spark, handed), cleaning.load_assets(v.spark, kept), "id", ["any_f", "taxed"], {"taxed_28d": "taxed"}, {"r_low": F.col("r_max") < 20})
    return r6(evaluate.union_all([t.withColumn("outcome", F.lit(o)) for o, t in got.tables.items()]))


# statistics

_LONG = " union all ".join(f"select any_f g, '{c}' feature, {c}::double v from feat" for c in ("r_max", "a_price", "n_price"))
_CONT = ["r_max", "a_price", "n_price"]
_T1 = "select feature, {g} grp, count(v) n, count(*) - count(v) missing, " + rd("median(v) median", "quantile_cont(v, 0.25) q1", "quantile_cont(v, 0.75) q3") + " from l group by all"


@query("table1_continuous", f"with l as ({_LONG}) {_T1.format(g='g::varchar')} union all {_T1.format(g=chr(39) + 'overall' + chr(39))}")
def _(v):
    return r6(stats.table1_continuous(v.feat, _CONT, "any_f"))


@query("table1_continuous_by_ranges", f"with l as ({_LONG}) {_T1.format(g='g::varchar')} union all {_T1.format(g=chr(39) + 'overall' + chr(39))}")
def _(v):
    return r6(stats.table1_continuous(v.feat, _CONT, "any_f", cleaning.RANGES))


_CAT = " union all ".join(f"select status g, '{c}' feature, {c}::varchar as level from stays" for c in ("segment", "priority", "nation"))
_T2 = "select feature, level, g grp, n, " + rd("n * 100.0 / sum(n) over (partition by feature, g) pct") + " from (select feature, level, g, count(*) n from (select * from l union all select 'overall', feature, level from l) group by all)"


@query("table1_categorical", f"with l as ({_CAT}) {_T2}")
def _(v):
    return r6(stats.table1_categorical(v.stays, ["segment", "priority", "nation"], "status"))


@query("kruskal_test", f"""with l as (select * from ({_LONG}) where v is not null), r as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0::double k, count(*) over (partition by feature, v) t, count(*) over (partition by feature) n from l),
  s as (select feature, g, sum(k) * sum(k) / count(*) s, max(n) n from r group by 1, 2), t as (select feature, sum((t * t * t - t) / t::double) ties from r group by 1)
  select feature, max(n) n, count(*) as groups, {rd('(12.0 / (max(n) * (max(n) + 1)) * sum(s) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(max(n), 3) - max(n))) h')} from s join t using (feature) group by 1""")
def _(v):
    return r6(stats.kruskal(v.feat, _CONT, "any_f").drop("p"))


@query("chi2_test", f"""with c as (select toxic, quality, count(*) o from labels where toxic is not null and quality is not null group by all), e as (select a.toxic, b.quality, a.n * b.n / t.n::double e, t.n from (select toxic, sum(o) n from c group by 1) a, (select quality, sum(o) n from c group by 1) b, (select sum(o) n from c) t)
  select 'quality' feature, {rd('sum(pow(coalesce(o, 0) - e, 2) / e) statistic', places=4)}, (count(distinct quality) - 1) * (count(distinct toxic) - 1) dof from e left join c using (toxic, quality)""")
def _(v):
    return r6(stats.chi2(v.table("labels"), ["quality"], "toxic").drop("p"), 4)


_KS = """with l as ({0}), n as (select feature, count(*) filter (in_a = 1) n_a, count(*) filter (in_a = 0) n_b from l group by 1),
  c as (select distinct feature, v, sum(in_a) over w a, sum(1 - in_a) over w b from l window w as (partition by feature order by v)),
  s as (select feature, n_a, n_b, max(abs(a / n_a::double - b / n_b::double)) d from c join n using (feature) group by all),
  p as (select *, n_a * n_b / (n_a + n_b)::double * d * d t2 from s),
  ks as (select feature, n_a, n_b, d statistic, case when t2 < 0.04 then 1.0 else least(1.0::double, greatest(0.0::double, (select sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * t2)) from range(1, 41) r(k)))) end p from p)""".replace(
    "{0}", " union all ".join(f"select '{c}' feature, {c}::double v, {a} in_a from coh_{x} where {c} is not null" for c in NUMBERS for x, a in (("a", 1), ("b", 0)))
)


@query("ks_drift", f"{_KS} select feature, n_a, n_b, {rd('statistic', 'p')}, (p < 0.05)::integer significant from ks")
def _(v):
    return r6(stats.ks_drift(v.coh_a, v.coh_b, NUMBERS))


@query("ks_drift_exact")
def _(v):
    return r6(stats.ks_drift(v.coh_a, v.coh_b, NUMBERS, exact_to=10_000))


@query("drift_summary", f"{_KS} select feature, {rd('statistic')}, row_number() over (order by statistic desc, feature)::integer as rank, (select count(*) from ks) n_features, (select sum((p < 0.05)::integer)::bigint from ks) n_significant from ks")
def _(v):
    totals, top = stats.drift_summary(stats.ks_drift(v.coh_a, v.coh_b, NUMBERS))
    t = totals.first()
    return r6(top.select("feature", "statistic", "rank", F.lit(t["n_features"]).alias("n_features"), F.lit(t["n_significant"]).alias("n_significant")))


# models


def _trained(v: Views) -> DataFrame:
    cohort = tables.keep_table(v.coh_a.select("id", "any_f", *NUMBERS), "cohort")  # read by the fit and by each pass over what it returns
    scaled = cleaning.fit_assets(cohort, NUMBERS, _LOGS, approximate=cleaning.RANGES)
    return cleaning.replay(cohort, scaled, ["id"], ("any_f",))


@query("l1_select")
def _(v):
    grid = tuple(10 ** (-3 + 4 * i / 99) for i in range(100))
    return r6(models.l1_select(_trained(v), "any_f", NUMBERS, "id", grid, k=10, bins=1 << 14), 4)


@query("tune_and_fit")
def _(v):
    return r6(models.tune(_trained(v), "any_f", NUMBERS, "id")[0], 3)


@query("isotonic_calibrate")
def _(v):
    return r6(models.calibrate(_trained(v), "any_f", NUMBERS, "id")[0], 4)


_RISK = "1 / (1 + exp(-(" + f"{INTERCEPT}::double + " + " + ".join(f"coalesce({c}, 0) * ({w}::double)" for c, w in LINEAR.items()) + ")))"


@query("score_cohort", f"with s as (select id, {_RISK} p, 1 / (1 + exp(-(r_max / 50 - 0.5))) q from coh_b where r_max is not null) select id, 'linear' model, {rd('p')}, (p >= 0.45::double)::integer predicted from s union all select id, 'simple', {rd('q p')}, (q >= 0.5)::integer from s")
def _(v):
    both = {"linear": models.linear_score(LINEAR, INTERCEPT), "simple": 1 / (1 + F.exp(-(F.col("r_max") / 50 - 0.5)))}
    return r6(models.score(v.coh_b.where("r_max is not null"), both, models.thresholds_table(v.spark, {"linear": 0.45}), ["id"]))


_AUC = "(select {by}, (sum(k * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)) auc from (select *, rank() over (partition by {by} order by p) + (count(*) over (partition by {by}, p) - 1) / 2.0::double k from {t}) group by {by})"


@query("pick_best_model", f"""with m as (select 'all' outcome, grp model, auc from {_AUC.format(by='grp', t='scored')}) select outcome, model, {rd('auc')} from (select *, row_number() over (partition by outcome order by auc desc, model) k from m) where k = 1""")
def _(v):
    metrics = evaluate.auc(v.scored, "y", "p", ["grp"]).select(F.lit("all").alias("outcome"), F.col("grp").alias("model"), "auc")
    return r6(evaluate.best_model(metrics, "outcome", "model", "auc"))


_ATTR = ", ".join(f"({c} - avg({c}) over ()) * ({w}::double) s_{c}" for c, w in LINEAR.items())
_SHARES = f"with s as (select id, r_max, {_ATTR} from feat), t as (select {', '.join(f'avg(abs(s_{c})) a_{c}' for c in LINEAR)} from s)"


@query("linear_attribution", f"{_SHARES} select id, r_max raw_r_max, {rd(*[f's_{c} {c}' for c in LINEAR], *[f'a_{c} {c}_mean_abs' for c in LINEAR])} from s, t")
def _(v):
    shares, ranks = models.attribute(v.feat, LINEAR, "id")
    mean = {r["feature"]: r["mean_abs"] for r in ranks.collect()}  # one row for each feature
    out = shares.join(v.feat.select("id", F.col("r_max").alias("raw_r_max")), "id")
    return r6(out.withColumns({f"{c}_mean_abs": F.lit(mean[c]) for c in LINEAR}))


_TOP = " union all ".join(f"select '{c}' feature, a_{c} mean_abs from t" for c in LINEAR)
_RAW = "case feature " + " ".join(f"when '{c}' then {c}" for c in LINEAR) + " end"
_OWN = "case feature " + " ".join(f"when '{c}' then s_{c}" for c in LINEAR) + " end"


@query("attribution_report", f"""{_SHARES}, ranks as (select *, row_number() over (order by mean_abs desc, feature)::integer as place from ({_TOP})),
  risk as (select id, {' + '.join(f's_{c}' for c in LINEAR)} total from s), worst as (select id, total from risk where total is not null order by total desc, id limit 1)
  select place, feature, {rd('mean_abs')}, id, {rd('total', f'{_OWN} contribution', f'{_RAW} as_value')} from ranks, worst join s using (id) join (select id, {', '.join(c for c in LINEAR if c != 'r_max')} from feat) using (id) where place <= 3""")
def _(v):
    return r6(models.attribution_report(v.feat, LINEAR, "id").withColumnRenamed("value", "as_value"))


# evaluation

_ROC = """(select grp, threshold, pos, neg, sum(pos) over w cum_pos, sum(neg) over w cum_neg, sum(pos) over (partition by grp) n_pos, sum(neg) over (partition by grp) n_neg
  from (select grp, p threshold, sum(y)::bigint pos, sum(1 - y)::bigint neg from {t} group by 1, 2) window w as (partition by grp order by threshold desc))"""
_ROC_ALL = _ROC.format(t="scored")


@query("roc_points", f"select grp, threshold, pos, neg, cum_pos::bigint cum_pos, cum_neg::bigint cum_neg, n_pos::bigint n_pos, n_neg::bigint n_neg, {rd('cum_pos / n_pos tpr', 'cum_neg / n_neg fpr')} from {_ROC_ALL}")
def _(v):
    return r6(evaluate.roc_points(v.scored, "y", "p", ["grp"]))


@query("auc", f"select grp, {rd('auc')} from {_AUC.format(by='grp', t='scored')}")
def _(v):
    return r6(evaluate.auc(v.scored, "y", "p", ["grp"]))


@query("average_precision", f"select grp, {rd('sum(pos / n_pos * cum_pos / (cum_pos + cum_neg)) average_precision')} from {_ROC_ALL} group by 1")
def _(v):
    return r6(evaluate.average_precision(v.scored, "y", "p", ["grp"]))


@query("brier", f"select grp, {rd('avg(pow(p - y, 2)) brier')} from scored group by 1")
def _(v):
    return r6(evaluate.brier(v.scored, "y", "p", ["grp"]))


_CUT = "(select grp, threshold cutoff, j from (select *, row_number() over (partition by grp order by j desc, threshold desc) k from (select *, cum_pos / n_pos::double - cum_neg / n_neg::double j from {r})) where k = 1)"


@query("youden_cutoff", f"select grp, {rd('least(1.0::double, cutoff) cutoff', 'j')} from {_CUT.format(r=_ROC_ALL)}")
def _(v):
    return r6(evaluate.youden(v.scored, "y", "p", ["grp"]))


_CELLS = "count(*) filter (p >= {t} and y = 1) tp, count(*) filter (p >= {t} and y = 0) fp, count(*) filter (p < {t} and y = 0) tn, count(*) filter (p < {t} and y = 1) fn"
_RATES = rd("coalesce(tp / nullif(tp + fn, 0), 0) sensitivity", "coalesce(tn / nullif(tn + fp, 0), 0) specificity", "coalesce(tp / nullif(tp + fp, 0), 0) ppv", "coalesce(tn / nullif(tn + fn, 0), 0) npv", "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1", "coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) accuracy")


@query("threshold_metrics", f"select grp, tp, fp, tn, fn, {_RATES} from (select grp, {_CELLS.format(t='0.6::double')} from scored group by 1)")
def _(v):
    return r6(evaluate.metrics_at(v.scored, "y", "p", ["grp"], F.lit(0.6)))


_POP = "(select 'full' grp, y, p from scored union all select 'sub' grp, y, p from scored where grp in ('1-URGENT', '2-HIGH'))"


@query("subgroup_metrics", f"with pop as {_POP}, cut as {_CUT.format(r=_ROC.format(t='pop'))} select grp population, cutoff, tp, fp, tn, fn, {_RATES}, {rd('auc')} from (select grp, cutoff, {_CELLS.format(t='cutoff')} from pop join cut using (grp) group by 1, 2) join {_AUC.format(by='grp', t='pop')} using (grp)")
def _(v):
    return r6(evaluate.metrics_by_group(v.scored, "y", "p", F.col("grp").isin("1-URGENT", "2-HIGH"), []))


def _bootstrap_sql(b: int = 20) -> str:
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"(u >= {total!r}::double)::integer")
    return f"""with d as (select rep, y, p, {' + '.join(steps)} w from (select rep, y, p, ('0x' || substr(md5(id::varchar || ':' || rep::varchar || ':42'), 1, 8))::ubigint / 4294967296.0::double u from scored, range({b}) r(rep))),
      c as (select rep, p, sum(w * y) pos, sum(w * (1 - y)) neg, sum(w) n from d where w > 0 group by 1, 2),
      r as (select *, sum(pos) over x cp, sum(neg) over x cn, sum(pos) over (partition by rep) np, sum(neg) over (partition by rep) nn from c window x as (partition by rep order by p desc)),
      m as (select rep, sum(neg * (cp - pos / 2.0::double)) / max(np * nn) auc, sum(pos / np::double * cp / (cp + cn)) average_precision, (sum(pos * pow(p - 1, 2)) + sum(neg * p * p)) / sum(n) brier from r group by 1),
      l as (select * from (unpivot m on auc, average_precision, brier into name metric value score))
      select metric, count(*)::integer n_reps, {rd(f'list_sort(list(score))[{int(b * 0.025) + 1}] lo', f'list_sort(list(score))[{int(b * 0.975) + 1}] hi')} from l group by 1"""


@query("bootstrap_ci", _bootstrap_sql())
def _(v):
    return r6(evaluate.bootstrap_ci(v.scored, "y", "p", "id", 20))


@query("bootstrap_ci_vectorised")
def _(v):
    return r6(evaluate.bootstrap_ci(v.scored, "y", "p", "id", 1000, vectorised=True), 3)


_TWO = f"select id, any_f y, 'linear' model, round({_RISK}, 4) p from {{t}} union all select id, any_f, 'simple', round(1 / (1 + exp(-(r_max / 50 - 0.5::double))), 4) from {{t}} where r_max is not null"


def _validation_sql(b: int = 20) -> str:
    curve = """(select model, threshold, pos, neg, sum(pos) over w cp, sum(neg) over w cn, sum(pos) over (partition by model) np, sum(neg) over (partition by model) nn
      from (select model, p threshold, sum(y) pos, sum(1 - y) neg from {t} group by 1, 2) window w as (partition by model order by threshold desc))"""
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"(u >= {total!r}::double)::integer")
    at = lambda m, q: f"list_sort(list({m}))[{int(b * q) + 1}]"
    return f"""with a as ({_TWO.format(t='coh_a')}), x as ({_TWO.format(t='coh_b')}), ca as (select * from {curve.format(t='a')}), cx as (select * from {curve.format(t='x')}),
      own as (select model, sum(neg * (cp - pos / 2.0::double)) / max(np * nn) auc_own, least(1.0::double, max_by(threshold, (cp / np::double - cn / nn::double, threshold))) threshold from ca group by 1),
      m as (select model, (max(np) + max(nn))::bigint n, max(np)::bigint n_pos, sum(neg * (cp - pos / 2.0::double)) / max(np * nn) auc, sum(pos / np::double * cp / (cp + cn)) average_precision,
        sum(pos * pow(c.threshold - 1, 2) + neg * c.threshold * c.threshold) / sum(pos + neg) brier, max(o.threshold) threshold, max(auc_own) auc_own, max(nn) nn,
        coalesce(sum(pos) filter (c.threshold >= o.threshold), 0) tp, coalesce(sum(neg) filter (c.threshold >= o.threshold), 0) fp from cx c join own o using (model) group by 1),
      d as (select model, rep, y, p, {' + '.join(steps)} w from (select model, rep, y, p, ('0x' || substr(md5(id::varchar || ':' || rep::varchar || ':42'), 1, 8))::ubigint / 4294967296.0::double u from x, range({b}) r(rep))),
      e as (select model, rep, p, sum(w * y) pos, sum(w * (1 - y)) neg, sum(w) n from d where w > 0 group by all),
      f as (select *, sum(pos) over v cp, sum(neg) over v cn, sum(pos) over (partition by model, rep) np, sum(neg) over (partition by model, rep) nn from e window v as (partition by model, rep order by p desc)),
      g as (select model, rep, sum(neg * (cp - pos / 2.0::double)) / max(np * nn) auc, sum(pos / np::double * cp / (cp + cn)) ap, (sum(pos * pow(p - 1, 2)) + sum(neg * p * p)) / sum(n) brier from f group by all),
      h as (select model, {', '.join(f'{at(m, q)} {m}_{e}' for m in ('auc', 'ap', 'brier') for q, e in ((0.025, 'lo'), (0.975, 'hi')))} from g group by 1)
      select model, n, n_pos, {rd('auc', 'auc_lo', 'auc_hi', 'average_precision', 'ap_lo average_precision_lo', 'ap_hi average_precision_hi', 'brier', 'brier_lo', 'brier_hi', 'threshold', 'tp / n_pos sensitivity', '(nn - fp) / nn specificity', 'tp / (tp + fp) ppv', '(nn - fp) / (nn - fp + n_pos - tp) npv', 'auc_own', 'auc - auc_own auc_change')} from m join h using (model)"""


def _two_models(cohort: DataFrame) -> DataFrame:
    both = {"linear": models.linear_score(LINEAR, INTERCEPT), "simple": 1 / (1 + F.exp(-(F.col("r_max") / 50 - 0.5)))}
    return models.score(cohort, both, None, ["id", "any_f"]).select("id", F.col("any_f").alias("y"), "model", rounded(F.col("p"), 4).alias("p"))


@query("validation_flow", _validation_sql())
def _(v):
    """Cut-offs are found on the development cohort and published; the report of the other cohort reads them back."""
    path, made = tables.scratch(v.spark, "cutoffs"), tables.keep_table(_two_models(v.coh_a), "scored")  # cut-offs and own areas read it
    tables.publish_table(validation.cutoffs(made, "y", "p", ["model"]), path)
    stored = tables.read_published(v.spark, path, "model string, threshold double")
    return r6(validation.validate(_two_models(v.coh_b), "y", "p", "id", ["model"], stored, 20, vectorised=False, own=evaluate.auc(made, "y", "p", ["model"])))


_OUTCOMES = {"any_f": "any_f", "taxed": "(tax >= 0.04)::integer"}
_SELECTED = " union all ".join(f"select '{o}' outcome, '{c}' feature, round(corr({c}, {e}), 6) + 0.0::double weight, count(*) n from coh_a" for o, e in _OUTCOMES.items() for c in NUMBERS if c not in e)


@query("selection_flow", f"""with s as ({_SELECTED}), k as (select *, row_number() over (partition by outcome order by abs(weight) desc, feature)::integer place from s where weight is not null),
  t as (select *, count(*) over (partition by outcome)::integer n_features from k where place <= 3), w as (select outcome, id, sum(weight * coalesce(x, 0)) score from t join (select id, name feature, x from (unpivot coh_b on {', '.join(NUMBERS)} into name name value x)) using (feature) group by all)
  select outcome, place, feature, weight, n_features, 1.0::double best_c, {rd('1 / n::double best_lambda', places=9)}, mean_score from t join (select outcome, round(sum(score) / (select count(*) from coh_b), 6) mean_score from w group by 1) using (outcome)""")
def _(v):
    """The three features that go best with each outcome are handed over as a JSON document, and score the other cohort from it."""
    outcomes = {"any_f": F.col("any_f"), "taxed": (F.col("tax") >= 0.04).cast("int")}
    pairs = [(o, c) for o in outcomes for c in NUMBERS if not (o == "taxed" and c == "tax")]
    stats_row = v.coh_a.agg(F.count(F.lit(1)).alias("n"), *[F.corr(c, outcomes[o]).alias(f"{o}:{c}") for o, c in pairs])
    rows = stats_row.select("n", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(c).alias("feature"), (rounded(F.col(f"`{o}:{c}`"), 6) + 0.0).alias("weight")) for o, c in pairs])).alias("x")).select("n", "x.*")
    top = evaluate.top_by(rows.where("weight is not null"), "outcome", [F.desc(F.abs("weight")), F.asc("feature")], 3)
    path = tables.scratch(v.spark, "selection")
    tables.write_selection(top.select("outcome", "feature", "weight", F.lit(1.0).alias("best_c"), (1 / F.col("n")).alias("best_lambda")), path)
    chosen = tables.read_selection(v.spark, path)
    mean = v.coh_b.select([F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS]).agg(*[F.avg(c).alias(c) for c in NUMBERS]).unpivot([], NUMBERS, "feature", "mean")
    scored = chosen.join(mean, "feature").groupBy("outcome").agg(rounded(F.sum(F.col("weight") * F.col("mean")), 6).alias("mean_score"))
    return chosen.withColumn("best_lambda", rounded(F.col("best_lambda"), 9)).join(scored, "outcome")


@query("calibration_bins", f"select grp, least(floor(p * 10), 9)::integer bin, count(*) n, {rd('avg(p) mean_predicted', 'avg(y) observed')} from scored group by 1, 2")
def _(v):
    return r6(evaluate.calibration_bins(v.scored, "y", "p", ["grp"]))


@query("decision_curve", f"""with t as (select k::integer k, k * 0.01::double t from range(76) r(k)), c as (select grp, least(floor(round(p / 0.01::double, 9)), 75)::integer cell, sum(y) pos, sum(1 - y) neg from scored group by 1, 2), n as (select grp, sum(pos) np, sum(neg) nn from c group by 1)
  select grp, k, {rd('t threshold', 'coalesce(sum(pos) filter (cell >= k), 0) / (np + nn) - coalesce(sum(neg) filter (cell >= k), 0) / (np + nn) * t / (1 - t) model', 'np / (np + nn) - nn / (np + nn) * t / (1 - t) treat_all')} from t, n join c using (grp) group by grp, k, t, np, nn""")
def _(v):
    return r6(evaluate.decision_curve(v.scored, "y", "p", ["grp"]))


@query("odds_ratios")
def _(v):
    return r6(models.odds_ratios(_trained(v), "any_f", NUMBERS, "id"), 4)


_MOST = max(abs(w) for w in LINEAR.values())


@query("nomogram_points", " union all ".join(f"select '{c}' feature, {rd(f'{abs(w)} / {_MOST} * 100 points_max', places=4)}, k::integer tick, {rd(f'q[1] + (q[2] - q[1]) * k / 4.0::double as_value', f'{abs(w)} / {_MOST} * 100 * {"(1 - k / 4.0::double)" if w < 0 else "k / 4.0::double"} points', places=4)} from (select quantile_cont({c}, [0.01, 0.99]) q from feat), range(5) r(k)" for c, w in LINEAR.items()))
def _(v):
    return r6(evaluate.nomogram(v.feat, LINEAR).withColumnRenamed("value", "as_value").drop("coef"), 4)


_RISKED = f"select r::double risk, (ln(r / (1 - r)) - ({INTERCEPT}::double)) / {_MOST} * 100 total_points from (select unnest([{', '.join(f'{r}::double' for r in evaluate.RISKS)}]) r)"


@query("nomogram_risks", f"with k as ({_RISKED}), s as (select id, {' + '.join(f'coalesce({c}, 0) * ({w}::double)' for c, w in LINEAR.items())} z from feat) select risk, {rd('total_points', places=4)}, (select count(*) from s where z / {_MOST} * 100 >= total_points) n_above from k where total_points between 0 and 100")
def _(v):
    risks = evaluate.risk_points(v.spark, INTERCEPT, _MOST)
    z = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in LINEAR.items()), F.lit(0.0))
    return r6(evaluate.rows_above(v.feat, z / _MOST * 100, risks, "total_points"), 4)


# order, sets and shape


@query("ranked_report", f"select grp, n, printf('%.3f', auc) auc, place::integer place from (select grp, n, auc, row_number() over (order by n desc, auc desc, grp) place from {_AUC.format(by='grp', t='scored')} join (select grp, count(*) n from scored group by 1) using (grp))")
def _(v):
    rows = evaluate.auc(v.scored, "y", "p", ["grp"]).join(v.scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    return evaluate.ranked_report(rows, [F.desc("n"), F.desc("auc"), F.asc("grp")], {"auc": "%.3f"})


@query("feature_set_ops", "with p as (select distinct l_returnflag g, l_partkey feature from lineitem) select feature, count(*) n_groups, (count(*) = (select count(distinct g) from p))::integer in_all from p group by 1")
def _(v):
    return evaluate.feature_sets(v.table("lineitem"), "l_returnflag", "l_partkey")


@query("union_reports", f"select 'any' outcome, sum(any_f)::bigint n_any, null::bigint n_high, {rd('null low_tax')} from feat union all select 'high', null, count(*) filter (r_max > 40), null from feat union all select 'tax', null, null, {rd('avg((tax < 0.04)::integer) low_tax')} from feat")
def _(v):
    parts = [
        v.feat.agg(F.lit("any").alias("outcome"), F.sum("any_f").alias("n_any")),
        v.feat.agg(F.lit("high").alias("outcome"), F.count_if(F.col("r_max") > 40).alias("n_high")),
        v.feat.agg(F.lit("tax").alias("outcome"), F.avg((F.col("tax") < 0.04).cast("int")).alias("low_tax")),
    ]
    return r6(evaluate.union_all([p.withColumn("outcome", F.col("outcome")) for p in parts]))


@query("melt_metrics", f"with b as (select p_brand brand, avg(p_size) size, avg(p_retailprice) price from part group by 1) select brand, metric, {rd('score')} from (unpivot b on size, price into name metric value score)")
def _(v):
    wide = v.table("part").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    return r6(wide.unpivot(["brand"], ["size", "price"], "metric", "score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort in small: anchor, window, pivot, slope and persistence, assembled to one row for each patient."""
    v = Views(spark, sf_dir)
    obs = tables.keep_table(v.obs, "obs")  # three blocks read it
    wide = events.pivot_codes(obs, "user_id", "item", "value", _PIVOT)
    slope = events.signed_slope(obs.where("item = 'click'"), ["user_id"], "ts", "value")
    daily = events.daily_max(obs, "user_id", "ts", {k: F.when(F.col("item") == k, F.col("value")) for k in ("click", "view")})
    label = events.persistence(daily, "user_id", {"click": 60, "view": 40}, 2)
    names = [c for c in label.columns if c != "user_id"]
    return joins.assemble(v.idx, [wide, slope, label], "user_id", names)


@query("development_cohort", f"""with w as (select user_id, min(value) filter (item = 'click') click_min, max(value) filter (item = 'click') click_max, avg(value) filter (item in ('click', 'view')) web_avg, count(value) filter (item = 'error') err_n from obs group by 1),
  s as (select user_id, case when h > 0 then (l - f) / h else 0 end slope from (select user_id, {_ENDS} from obs where item = 'click' group by 1)),
  daily as (select user_id, ts::date as day, max(value) filter (item = 'click') click, max(value) filter (item = 'view') as view from obs group by 1, 2),
  p as (select user_id, (sum((click >= 60)::integer) >= 2)::integer c, (sum((view >= 40)::integer) >= 2)::integer v from daily group by 1)
  select user_id, t0, click_min, click_max, {rd('web_avg')}, err_n, {rd('slope')}, coalesce(c, 0) persistent_click, coalesce(v, 0) persistent_view, greatest(coalesce(c, 0), coalesce(v, 0)) persistent_any
  from idx left join w using (user_id) left join s using (user_id) left join p using (user_id)""")
def _(v):
    return r6(flagship(v.spark, v.sf_dir))
