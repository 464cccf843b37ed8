"""Importance resampling towards a target: documents whose hashed words look like the target's are drawn more often.

Texts that are equal are grouped first; features and weight are computed once a distinct text, its counts are multiplied
by its copies, and the weight is joined back to every document before noise of its own decides the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.scale import attach_by_key, scratch_table
from siltworks.llm.text import LOWER, UPPER, ascii_lower
from siltworks.operators.prefix import with_running

BUCKETS = 10_000
#: What stands between words: ASCII without digits and lower-case letters, after lower-casing.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _feature_buckets(text: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""
    bucket = lambda feature: F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")
    if longest == 1:
        return F.transform(_words(text), bucket)
    runs = lambda ws, k: F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: bucket(F.array_join(F.slice(ws, i, k), " ")))
    some = lambda ws, k: F.when(F.size(ws) >= k, runs(ws, k)).otherwise(F.array().cast("array<int>"))
    whole = F.transform(F.array(_words(text)), lambda ws: F.concat(*[some(ws, k) for k in range(1, longest + 1)]))
    return whole.getItem(0)


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def distinct_texts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``digest, copies, n_words, features``: one row a distinct lower-cased text, with the bucket of each of its features.

    Whole texts are the grouping key, counted in each task before they shuffle, so a text that a third of all documents
    share moves once a task.
    """
    grouped = docs.groupBy(_normal(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    out = grouped.select(_digest(F.col("t")).alias("digest"), "copies", _feature_buckets(F.col("t"), longest, buckets).alias("features"))
    # of r words, longest n: the runs number n*r - n*(n-1)/2 where r >= n; short texts have their own count
    return scratch_table(out if longest > 1 else out.withColumn("n_words", F.size("features").cast("long")), "distinct-texts")


def bucket_gains(texts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A thousand times the log of each bucket's smoothed share in ``target`` over that in ``texts``, as floors.

    Both tables have ``copies`` and ``features``. What comes to the driver is one number a bucket, whatever the tables hold.
    """
    counts = lambda df, name: df.select("copies", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))
    both = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(counts(texts, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = scratch_table(both, "bucket-counts")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    real = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    ratio = (real(F.col("t") + 1) * real(whole["S"] + buckets)) / (real(F.col("s") + 1) * real(whole["T"] + buckets))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    gains = [0] * buckets
    for r in rows:
        gains[r["bucket"]] = int(r["gain"])
    return gains


def _weight(features: Column, gains: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one constant
    return F.aggregate(features, F.lit(0).cast("bigint"), lambda total, b: total + F.get(table, b))


def _noise(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))`` of a uniform number that belongs to the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_report(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank``: a row a document, ``rank`` for those that the draw takes.

    The highest ``percent`` of scores among documents with ``least_words`` or more are drawn, ties to the smaller id; the
    rest has no rank. Null and empty texts have no features and weight 0. A null id draws the noise of the empty id and
    comes last in a tie; rows that repeat are rows each, ranked side by side. Texts of any length count whole. Empty tables
    give no rows; an empty target leaves the smoothed shares. Other columns, whatever their names, are left out.
    """
    docs = docs.select("doc_id", "text")
    rows = scratch_table(docs.select("doc_id", _digest(_normal(F.col("text"))).alias("digest")), "digests")
    texts = _with_words(distinct_texts(docs, longest, buckets), docs, longest)
    # what stands in the target counts once a row: it is grouped too, and copies multiply
    gains = bucket_gains(texts, distinct_texts(target.select("text"), longest, buckets), buckets)
    weights = texts.select("digest", "copies", "n_words", F.size("features").cast("long").alias("n_features"), _weight(F.col("features"), gains).alias("weight"))
    weights = scratch_table(weights, "text-weights")
    scored = attach_by_key(rows, weights, "digest", "copies", rows.count())
    scored = scratch_table(scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    take = eligible.count() * percent // 100
    ranked = with_running(eligible, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("digest")], {}, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")).cast("bigint"))
    out = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def _with_words(texts: DataFrame, docs: DataFrame, longest: int) -> DataFrame:
    """Number of words by number of runs: with r words of which n = ``longest`` make the longest run."""
    if "n_words" in texts.columns:
        return texts
    n, m = longest, F.size("features")
    short = n * (n + 1) // 2  # runs of a text of exactly n words
    long = (m + n * (n - 1) // 2) / n
    few = F.floor((F.sqrt(8.0 * m + 1) - 1) / 2)
    return texts.withColumn("n_words", F.when(m >= short, long).otherwise(few).cast("bigint"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """The documents that ``importance_report`` draws, with all their columns.

    The draw's last score and id are two numbers: rows are kept or left where they lie, by their own score against those,
    and no text shuffles. Rows that repeat the last id and score all stay.
    """
    report = scratch_table(importance_report(docs, target, percent, least_words, longest, buckets, seed), "importance")
    drawn = report.where("rank IS NOT NULL")
    last = drawn.orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.where(F.lit(False))
    texts = distinct_texts(docs.select("text"), longest, buckets)
    gains = bucket_gains(texts, distinct_texts(target.select("text"), longest, buckets), buckets)
    whole = _normal(F.col("text"))
    score = _weight(_feature_buckets(whole, longest, buckets), gains) + _noise(F.col("doc_id"), seed)
    before = F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("doc_id") <= last["doc_id"], F.lit(False))
    chosen = (score > last["score"]) | ((score == last["score"]) & before)
    return docs.where((F.size(_words(whole)) >= least_words) & chosen)


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark),
n AS (SELECT row_number() OVER () AS r, doc_id, ws FROM d),
u AS (SELECT r, unnest(ws) AS word FROM n),
v AS (SELECT word FROM u UNION SELECT word FROM b),
bits AS (SELECT word, list_transform(range(4 * length(hex(word))),
    lambda k: (('0x' || substr(hex(word), 2 * (k // 8) + 1, 2))::BIGINT >> (k % 8)::BIGINT) & 1) AS bs FROM v),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bits),
s AS (SELECT bucket, count(*) AS s FROM u JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(gain) AS weight FROM u JOIN crc USING (word) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT n.*, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM n LEFT JOIN w USING (r)),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM k WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, n_features::BIGINT AS n_words, weight, score,
    CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM e) THEN rank END AS rank
FROM k LEFT JOIN e USING (r)
"""
