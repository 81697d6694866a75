"""Views of the star-schema tables that stand for clinical inputs, as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import in_window

SPLIT = "1998-07-01"


def rounded(column: Column, places: int) -> Column:
    """What round(x, places) is in the statements: the double x * 10^places to the nearest whole number, halves away from zero, over
    10^places. F.round goes by the digits that a double is shown with instead, so that 0.5005 is 0.501 there and 0.5 here."""
    unit = F.lit(10.0**places)
    return F.round(column.cast("double") * unit) / unit


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def idx(self) -> DataFrame:
        """user_id, t0: the first signup."""
        return self.table("events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))

    @cached_property
    def obs(self) -> DataFrame:
        """Events within seven days of the anchor."""
        events = self.table("events").select("event_id", "user_id", "ts", F.col("event_type").alias("item"), "value")
        return in_window(events, self.idx, "user_id", "ts", "t0", "0 days", "7 days")

    @cached_property
    def stays(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("intime"), (F.col("o_totalprice") / 50000).alias("los"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"),
        )

    @cached_property
    def dx(self) -> DataFrame:
        l, p = self.table("lineitem").select("l_orderkey", "l_partkey"), self.table("part")
        return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("hadm"), F.col("p_type").alias("version"), F.col("p_brand").alias("code"), F.col("p_name").alias("text"))

    @cached_property
    def feat(self) -> DataFrame:
        flag = lambda f, c: F.when(F.col("l_returnflag") == f, F.col(c))
        both = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
            F.min(flag("R", "l_quantity")).alias("r_min"), F.max(flag("R", "l_quantity")).alias("r_max"), F.max(flag("A", "l_extendedprice")).alias("a_price"),
            F.avg(flag("N", "l_extendedprice")).alias("n_price"), F.min(F.col("l_discount") + 0.0).alias("disc"), F.max("l_tax").alias("tax"), F.count(F.lit(1)).alias("n_lines"),
            F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("any_f"), F.max(F.when(both, F.col("l_quantity"))).alias("rf_qty"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), rounded(F.least(F.col("o_totalprice") / 400000, F.lit(1.0)), 3).alias("p"), F.col("o_orderpriority").alias("grp"))

    @cached_property
    def _dated(self) -> DataFrame:
        return self.feat.join(self.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("y")), "id")

    @cached_property
    def coh_a(self) -> DataFrame:
        return self._dated.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz")).drop("o_orderdate")

    @cached_property
    def coh_b(self) -> DataFrame:
        return self._dated.where(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz")).drop("o_orderdate")


SQL = {
    "idx": "select user_id, min(ts) t0 from events where event_type = 'signup' group by user_id",
    "obs": "select e.event_id, e.user_id, e.ts, e.event_type item, e.value, i.t0 from events e join idx i using (user_id) where e.ts between i.t0 and i.t0 + interval 7 day",
    "stays": "select o_orderkey stay_id, o_custkey subject_id, o_orderdate intime, o_totalprice / 50000 los, o_orderstatus status, o_orderpriority priority, c_nationkey nation, c_mktsegment segment, c_acctbal acctbal from orders join customer on o_custkey = c_custkey",
    "dx": "select l_orderkey hadm, p_type as version, p_brand code, p_name as text from lineitem join part on l_partkey = p_partkey",
    "feat": """select l_orderkey id, min(l_quantity) filter (l_returnflag = 'R') r_min, max(l_quantity) filter (l_returnflag = 'R') r_max,
      max(l_extendedprice) filter (l_returnflag = 'A') a_price, avg(l_extendedprice) filter (l_returnflag = 'N') n_price, min(l_discount + 0.0::double) disc, max(l_tax) tax,
      count(*) n_lines, max(case when l_linestatus = 'F' then 1 else 0 end) any_f, max(l_quantity) filter (l_returnflag = 'R' and l_linestatus = 'F') rf_qty from lineitem group by l_orderkey""",
    "scored": "select o_orderkey id, (o_orderstatus = 'F')::integer y, round(least(o_totalprice / 400000, 1.0::double), 3) p, o_orderpriority grp from orders",
    "dated": "select f.*, o_orderdate, (o_orderstatus = 'F')::integer y from feat f join orders on f.id = o_orderkey",
    "coh_a": f"select * exclude (o_orderdate) from dated where o_orderdate < timestamp '{SPLIT}'",
    "coh_b": f"select * exclude (o_orderdate) from dated where o_orderdate >= timestamp '{SPLIT}'",
}


def with_views(sql: str) -> str:
    """The statement with all views before it (a `with` of its own joins in)."""
    views = ",\n".join(f"{n} as ({q})" for n, q in SQL.items())
    rest = sql.strip()
    return f"with {views},\n{rest[5:]}" if rest[:5].lower() == "with " else f"with {views}\n{rest}"
