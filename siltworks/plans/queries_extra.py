"""Extra queries: relational features that an analytics engine needs beyond the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltworks.plans.registry import query
from siltworks.sources.tables import table
from siltworks.streaming.replay import windowed_counts


@query(
    "extra_cube", "extra",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "extra_ranks", "extra",
    "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)",
)
def ranks(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate")
    v = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(v).alias("q"))
    return o.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("r", "d", "q")])


@query(
    "extra_as_of", "extra",
    """SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.event_id < a.event_id) AS last_view FROM events a WHERE a.event_type = 'purchase'""",
)
def as_of(spark, sf_dir):
    """The last view before each purchase: one ordered pass over each user's events, no pairs."""
    line = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(line))
    return e.where("event_type = 'purchase'").select("event_id", "last_view")


@query(
    "extra_windowed_counts", "extra",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def windowed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "extra_revenue_by_nation", "extra",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return c.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))
