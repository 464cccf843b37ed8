"""Queries of aggregation, window, order and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions.hashing import draw
from siltworks.operators import aggregate as A
from siltworks.operators import joins as J
from siltworks.operators import window as W
from siltworks.operators.prefix import with_running
from siltworks.plans.registry import duck_draw, query
from siltworks.sources.tables import table


@query(
    "named_agg", "A1 A15 A27",
    """SELECT lang, source, count(*) AS items, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 1000) AS long_items, bool_and(n_chars > 20) AS all_real
    FROM documents GROUP BY lang, source""",
)
def named_agg(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_items"),
        F.bool_and(F.col("n_chars") > 20).alias("all_real"),
    )


@query(
    "group_mean", "A2 A3 F11",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL",
)
def group_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    drop = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"}
    metrics = [c for c in A.metric_columns(rows) if c not in drop]
    means = A.group_means(rows, ["l_returnflag", "l_linestatus"], metrics)
    return means.select("l_returnflag", "l_linestatus", *[F.round(m, 6).alias(m) for m in metrics])


@query("group_median", "A4", "SELECT source, median(n_chars)::DOUBLE AS n_chars FROM documents GROUP BY source")
def group_median(spark, sf_dir):
    return A.group_medians(table(spark, sf_dir, "documents"), ["source"], ["n_chars"])


@query(
    "group_stats_long", "A5",
    """WITH l AS (UNPIVOT (SELECT l_shipmode, l_quantity, CASE WHEN l_linenumber > 1 THEN l_tax END AS l_tax FROM (SELECT l_returnflag AS l_shipmode, * FROM lineitem))
      ON l_quantity, l_tax INTO NAME metric VALUE value)
    SELECT l_shipmode, metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM l WHERE value IS NOT NULL GROUP BY ALL""",
)
def group_stats_long(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("l_shipmode"), "l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_tax")).otherwise(float("nan")).alias("l_tax")
    )
    return A.group_stats(rows, ["l_shipmode"], ["l_quantity", "l_tax"]).withColumn("mean", F.round("mean", 6))


@query(
    "keyed_values", "A29 A31 X9",
    """WITH g AS (SELECT lower(replace(p_brand, '#', '_')) AS b, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY p_brand)
    SELECT 'run.part.' || trim(regexp_replace(b, '[^a-z0-9_-]+', '_', 'g'), '_') || '.p_size' AS key, round(size, 6) AS number FROM g
    UNION ALL SELECT 'run.part.' || trim(regexp_replace(b, '[^a-z0-9_-]+', '_', 'g'), '_') || '.price', round(price, 6) FROM g""",
)
def keyed_values(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("p_size"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    return A.keyed_values(g, "run.part", ["p_brand"])


@query(
    "history_summary", "A6",
    """SELECT user_id, 'value' AS metric, count(*) AS n, arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max FROM events WHERE event_id % 3 <> 0 GROUP BY user_id""",
)
def history_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(float("nan")).alias("value"))
    return A.history_summary(e, "user_id", "event_id", ["value"])


@query(
    "ratio_of_sums", "A7",
    "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS a, sum(l_quantity)::BIGINT AS b, round(sum(l_linenumber) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY l_returnflag",
)
def ratio_of_sums(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("a"), F.sum("l_quantity").cast("long").alias("b"))
    return g.withColumn("ratio", F.round(F.col("a") / F.col("b"), 6))


@query(
    "crosstab_fill", "A8 O7",
    "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'xx') AS xx FROM documents GROUP BY source",
)
def crosstab_fill(spark, sf_dir):
    return A.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "xx"])


@query(
    "value_counts_wide", "A9 A10",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def value_counts_wide(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "pivot_sum", "A11",
    """SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS F, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS O FROM orders GROUP BY o_orderpriority""",
)
def pivot_sum(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.na.fill(0.0)


@query(
    "dense_histogram", "A12",
    """SELECT v::BIGINT AS value, (SELECT count(*) FROM part WHERE p_size = v) AS n FROM (SELECT unnest(range(0, 65)) AS v)""",
)
def dense_histogram(spark, sf_dir):
    return A.dense_histogram(table(spark, sf_dir, "part"), "p_size", 64)


@query(
    "component_sizes", "A13",
    "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT max(n) AS largest, count(*) AS groups FROM s",
)
def component_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups"))


@query(
    "width_histogram", "A14",
    """WITH b AS (SELECT l_returnflag, least(floor((l_quantity - 1) / (49 / 32.0::DOUBLE))::INT, 31) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50)
    SELECT l_returnflag, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM b GROUP BY l_returnflag, bin""",
)
def width_histogram(spark, sf_dir):
    h = A.width_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 1.0, 50.0, 32)
    return h.withColumn("share", F.round("share", 6))


@query(
    "worst_and_median", "A16",
    "SELECT event_type, round(max(value), 6) AS worst, round(median(value), 6) AS middle FROM events GROUP BY event_type",
)
def worst_and_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.max("value"), 6).alias("worst"), F.round(F.median("value"), 6).alias("middle"))


@query(
    "linear_quantiles", "A17 A19",
    """SELECT p AS point, round(quantile_cont(o_totalprice, p), 4) AS value FROM orders, (SELECT unnest([0.001, 0.02, 0.5, 0.95, 0.999]::DOUBLE[]) AS p) GROUP BY p"""
    .replace("quantile_cont(o_totalprice, p)", "CASE p WHEN 0.001 THEN quantile_cont(o_totalprice, 0.001) WHEN 0.02 THEN quantile_cont(o_totalprice, 0.02) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) WHEN 0.95 THEN quantile_cont(o_totalprice, 0.95) ELSE quantile_cont(o_totalprice, 0.999) END"),
)
def linear_quantiles(spark, sf_dir):
    q = A.linear_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.001, 0.02, 0.5, 0.95, 0.999])
    return q.withColumn("value", F.round("value", 4))


@query(
    "index_quantile", "A18",
    "WITH s AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS r, count(*) OVER () AS n FROM events) SELECT value FROM s WHERE r = floor(0.99::DOUBLE * (n - 1))::BIGINT + 1",
)
def index_quantile(spark, sf_dir):
    return A.index_quantile(table(spark, sf_dir, "events"), "value", "event_id", 0.99)


@query(
    "confusion_rates", "A20",
    """WITH x AS (SELECT quality = 1 AS good, n_chars >= 200 AS found FROM labels JOIN documents USING (doc_id))
    SELECT round(count(*) FILTER (good AND found) / greatest(count(*) FILTER (found), 1), 6) AS precision, round(count(*) FILTER (good AND found) / greatest(count(*) FILTER (good), 1), 6) AS recall,
    count(*) FILTER (NOT good AND found) AS false_positives FROM x""",
)
def confusion_rates(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    c = A.confusion(x, F.col("quality") == 1, F.col("n_chars") >= 200)
    return c.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "false_positives")


@query(
    "roc_curve", "A21 O4 W5",
    """WITH x AS (SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id)), s AS (
      SELECT row_number() OVER o AS rank, sum((quality = 0)::INT) OVER o AS f, sum((quality = 1)::INT) OVER o AS t,
        count(*) OVER () AS n, count(*) FILTER (quality = 0) OVER () AS q, count(*) FILTER (quality = 1) OVER () AS p
      FROM x WINDOW o AS (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT rank, round(f / greatest(q, 1), 6) AS fpr, round(t / greatest(p, 1), 6) AS tpr FROM s WHERE (rank - 1) % greatest(1, n // 100) = 0""".replace(
        "count(*) FILTER (quality = 0) OVER ()", "sum((quality = 0)::INT) OVER ()").replace("count(*) FILTER (quality = 1) OVER ()", "sum((quality = 1)::INT) OVER ()"),
)
def roc_curve(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    c = A.roc_curve(x, "n_chars", "quality", "doc_id", 100)
    return c.select("rank", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "variation", "A22",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(stddev_pop(value) / avg(value), 6) AS cv FROM events GROUP BY event_type",
)
def variation(spark, sf_dir):
    s, m = F.stddev_pop("value"), F.avg("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(m, 6).alias("mean"), F.round(s, 6).alias("deviation"), F.round(s / m, 6).alias("cv"))


@query("distinct_count", "A23", "SELECT p_brand, count(DISTINCT p_type) FILTER (p_type <> 'mean') AS types FROM part GROUP BY p_brand")
def distinct_count(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_type <> 'mean'").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"))


@query(
    "mean_of_means", "A24 A25",
    """SELECT round((avg(l_tax) FILTER (l_returnflag = 'R') + avg(l_tax) FILTER (l_returnflag = 'N')) / 2, 6) AS score, round(avg(l_tax) FILTER (l_returnflag IN ('R', 'N')), 6) AS pooled FROM lineitem""",
)
def mean_of_means(spark, sf_dir):
    of = lambda *f: F.avg(F.when(F.col("l_returnflag").isin(*f), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").agg(F.round((of("R") + of("N")) / 2, 6).alias("score"), F.round(of("R", "N"), 6).alias("pooled"))


@query("least_side", "A26", "SELECT l_orderkey, min(least(l_quantity, l_linenumber * 10.0))::DOUBLE AS side FROM lineitem GROUP BY l_orderkey")
def least_side(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.least(F.col("l_quantity"), F.col("l_linenumber") * F.lit(10.0))).alias("side"))


@query(
    "tri_state_groups", "A30",
    """SELECT CASE lower(l_returnflag) WHEN 'r' THEN 'with' WHEN 'n' THEN 'without' END AS prior, count(*) AS n, round(avg(l_tax), 6) AS mean FROM lineitem WHERE lower(l_returnflag) IN ('r', 'n') GROUP BY 1""",
)
def tri_state_groups(spark, sf_dir):
    prior = F.when(F.lower("l_returnflag") == "r", "with").when(F.lower("l_returnflag") == "n", "without")
    rows = table(spark, sf_dir, "lineitem").select(prior.alias("prior"), "l_tax").where("prior IS NOT NULL")
    return rows.groupBy("prior").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax"), 6).alias("mean"))


@query("key_prefix_counts", "A28", "SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def key_prefix_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "largest_fitting", "F17",
    "SELECT p_brand, coalesce(max(p_size) FILTER (p_retailprice < 1200 AND p_size <= 37), min(p_size)) AS batch FROM part GROUP BY p_brand",
)
def largest_fitting(spark, sf_dir):
    fits = (F.col("p_retailprice") < 1200) & (F.col("p_size") <= 37)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.coalesce(F.max(F.when(fits, F.col("p_size"))), F.min("p_size")).alias("batch"))


@query(
    "head_per_group", "W1 O5",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 2 ORDER BY doc_id LIMIT 16",
)
def head_per_group(spark, sf_dir):
    return W.head_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 2, 16)


@query("cumcount", "W2", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events")
def cumcount(spark, sf_dir):
    return W.ordinal(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], [F.col("event_id")])


@query("lag_change", "W3", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS change FROM events")
def lag_change(spark, sf_dir):
    e = W.with_change(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    return e.select("event_id", F.round("change", 6).alias("change"))


@query(
    "series_gaps", "W4",
    """WITH s AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY r) AS gap FROM s WHERE r > n // 10""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"),
)
def series_gaps(spark, sf_dir):
    from pyspark.sql import Window

    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumns({"r": F.row_number().over(line), "n": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    after = e.where(F.col("r") > F.floor(F.col("n") / 10))
    gap = F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(Window.partitionBy("user_id").orderBy("r"))
    return after.select("event_id", gap.alias("gap"))


@query(
    "running_sum", "W5",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS total FROM orders",
)
def running_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("price"))
    return with_running(o, [F.col("o_orderdate"), F.col("o_orderkey")], {"total": F.col("price")}).select("o_orderkey", "rank", "total")


@query(
    "argmax_row", "W6 K8",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE event_id % 4 <> 0) WHERE n = 1",
)
def argmax_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).otherwise(float("nan")).alias("value"))
    return W.best_row(e, ["user_id"], "value", "event_id")


@query(
    "running_best", "W7",
    """SELECT event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_best(spark, sf_dir):
    return W.running_best(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id").select("event_id", "best", "improved")


@query(
    "sliding_windows", "W8",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(range(0, n - 4 + 1, 2)) AS start FROM n WHERE n >= 4""",
)
def sliding_windows(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return W.sliding_windows(n, "n", 4).select("conv_id", "start")


@query(
    "planned_windows", "W8 O6 P3",
    f"""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 4), c AS (SELECT count(*) AS c FROM n),
    r AS (SELECT conv_id, n, unnest(range(0, ((150 + c - 1) // c)::BIGINT)) AS round FROM n, c)
    SELECT conv_id, round::INT AS round, (floor({duck_draw("'13/' || conv_id || '/' || round")} * ((n - 4) // 2 + 1)) * 2)::BIGINT AS start
    FROM r ORDER BY round, {duck_draw("'13/' || conv_id")}, conv_id LIMIT 150""",
)
def planned_windows(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return W.plan_windows(n, "conv_id", "n", 4, 150, 13)


@query(
    "keyframes", "W10 D2",
    """SELECT doc_id, unnest(CASE WHEN n_chars = 1 THEN [0::BIGINT] WHEN n_chars >= 24 THEN [n_chars // 10, n_chars // 2, n_chars - 1 - n_chars // 10] ELSE [n_chars // 2] END) AS position FROM documents""",
)
def keyframes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(W.key_positions(F.col("n_chars"))).alias("position"))


@query(
    "backwards", "W11",
    "SELECT vec_id, 0.0::DOUBLE AS first, round(embedding[63]::DOUBLE, 6) AS second, round(embedding[1]::DOUBLE, 6) AS last FROM embeddings",
)
def backwards(spark, sf_dir):
    b = W.backwards(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", b.alias("b"))
    return e.select("vec_id", F.get("b", F.lit(0)).alias("first"), F.round(F.get("b", F.lit(1)), 6).alias("second"), F.round(F.element_at("b", -1), 6).alias("last"))


@query("sampled_rows", "W12", "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN length(text) END AS chars FROM conversations WHERE turn >= 1")
def sampled_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn >= 1").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.length("text")).cast("long").alias("chars"))


@query(
    "rate_schedule", "W13",
    """SELECT p_partkey, round(CASE WHEN p < 0.1 THEN 0.002 * p / 0.1 ELSE 0.002 * (0.05 + 0.95 * 0.5 * (1 + cos(pi() * least(greatest((p - 0.1) / 0.9, 0), 1)))) END, 9) AS rate
    FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS p FROM part)""",
)
def rate_schedule(spark, sf_dir):
    from siltworks.operators.sequence import rate_at

    return table(spark, sf_dir, "part").select("p_partkey", F.round(rate_at(F.col("p_size") / 50.0, 0.002, 0.1, 0.05), 9).alias("rate"))


@query(
    "top_k_scores", "O3 O4",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3",
)
def top_k_scores(spark, sf_dir):
    return W.head_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("hash_shuffle", "O6 P3", f"SELECT doc_id, row_number() OVER (ORDER BY {duck_draw(chr(39) + '4/' + chr(39) + ' || doc_id')}, doc_id) AS place FROM documents")
def hash_shuffle(spark, sf_dir):
    return with_running(table(spark, sf_dir, "documents").select("doc_id"), [draw(F.col("doc_id"), 4), F.col("doc_id")], rank="place")


@query("listed_order", "O7", "SELECT lang, list_position(['fr', 'en', 'de'], lang)::BIGINT AS place, count(*) AS n FROM documents WHERE lang IN ('fr', 'en', 'de') GROUP BY lang")
def listed_order(spark, sf_dir):
    names = F.array(F.lit("fr"), F.lit("en"), F.lit("de"))
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.select("lang", F.array_position(names, F.col("lang")).alias("place"), "n").where("place > 0")


@query(
    "union_keep_first", "U2 U1",
    """WITH u AS (SELECT doc_id % 100 AS k, n_chars, 0 AS origin, doc_id FROM documents UNION ALL SELECT item_id % 100, length(text), 1, item_id FROM benchmark)
    SELECT k, n_chars, origin FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY origin, doc_id) AS n FROM u) WHERE n = 1""",
)
def union_keep_first(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("k"), "n_chars", F.lit(0).alias("origin"), "doc_id")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 100).alias("k"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("origin"), F.col("item_id").alias("doc_id"))
    u = a.unionByName(b)
    first = F.min_by(F.struct("n_chars", "origin"), F.struct("origin", "doc_id"))
    return u.groupBy("k").agg(first.alias("x")).select("k", "x.n_chars", "x.origin")


@query("distinct_rows", "U3", "SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(
    "change_report", "U4 J17",
    """WITH a AS (SELECT p_partkey AS key, p_size AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 4 <> 0)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS status, a.v AS old, b.v AS new
    FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.v <> b.v""",
)
def change_report(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    after = part.where("key % 4 <> 0").withColumn("v", F.when(F.col("key") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return J.change_report(part.where("key % 5 <> 0"), after, "key", "v")


@query(
    "overlapping_sets", "U5",
    "SELECT conv_id, bool_or(role = 'system') AS rejected FROM conversations GROUP BY conv_id",
)
def overlapping_sets(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return g.select("conv_id", F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("tool"))).alias("rejected"))
