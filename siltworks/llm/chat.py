"""Multi-party chat formatting by perspective rotation. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.scale import attach_by_key, scratch_table
from siltworks.operators.prefix import with_running

#: Characters of a dialogue in one rendered row; only longer dialogues have several rows.
SEGMENT_CHARS = 8_000_000
#: What a turn counts besides its text and its speaker's name.
TURN_CHARS = 32
ASSISTANT = "<|assistant|>\n"
USER = ("<|user:", "|>\n")
END = "<|end|>\n"
UNKNOWN = "unknown"


def escape(text: Column) -> Column:
    """Text that holds no control string: a backslash (one more, where some stand there) parts ``<`` from ``|``."""
    return F.when(F.instr(text, "<") > 0, F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def _segments(rows: DataFrame, segment_chars: int) -> DataFrame:
    """``rows`` with ``segment``: 0 but in dialogues of more than ``segment_chars``.

    Those are cut by the running sum of their characters in order, over range partitions: a dialogue that is a third
    of all rows is neither sorted nor collected in one task.
    """
    sizes = rows.groupBy("key").agg(F.sum("chars").alias("all_chars"), F.count(F.lit(1)).alias("n"))
    long = scratch_table(sizes.where(F.col("all_chars") > segment_chars).select("key", "n"), "long-dialogues")
    if not long.limit(1).count():
        return rows.withColumn("segment", F.lit(0).cast("long"))
    marked = scratch_table(attach_by_key(rows, long, "key", "n", max(1, rows.count())), "dialogue-rows")
    some = marked.where("n IS NOT NULL").drop("n")
    line = [F.asc("key"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    some = scratch_table(with_running(some, line, {"upto": F.col("chars")}, "rank"), "dialogue-sums")
    starts = scratch_table(some.groupBy("key").agg(F.min(F.col("upto") - F.col("chars")).alias("start"), F.count(F.lit(1)).alias("n")), "dialogue-starts")
    some = attach_by_key(some, starts, "key", "n", max(1, some.count()))
    segment = F.floor((F.col("upto") - F.col("chars") - F.col("start")) / segment_chars).cast("long")
    some = some.withColumn("segment", segment).select(*rows.columns, "segment")
    return marked.where("n IS NULL").drop("n").withColumn("segment", F.lit(0).cast("long")).unionByName(some)


def _render(turns: Column, participant: Column) -> Column:
    """Text, turn mask and character spans of a segment, seen by ``participant``.

    ``at`` is where a turn would start if all were named users. Each earlier turn of the participant's own moves it by
    the same difference of the two heads, so that the k-th own turn has its place without a running sum.
    """
    own_head = F.length(F.lit(ASSISTANT))
    moved = own_head - (F.length(participant) + len("".join(USER)))
    mine = F.filter(turns, lambda t: t["role"] == participant)

    def turn(t: Column) -> Column:
        head = F.when(t["role"] == participant, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER[0]), t["role"], F.lit(USER[1])))
        return F.concat(head, t["text"], F.lit(END))

    def span(t: Column, k: Column) -> Column:
        start = t["at"] + k * moved + own_head
        return F.concat_ws("-", start.cast("string"), (start + F.length(t["text"]) + len(END)).cast("string"))

    masked = F.aggregate(mine, F.lit(0).cast("long"), lambda s, t: s + F.length(t["text"]) + len(END))
    return F.struct(
        F.array_join(F.transform(turns, turn), "").alias("text"),
        F.array_join(F.transform(turns, lambda t: F.when(t["role"] == participant, "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.transform(mine, span), ",").alias("spans"),
        masked.alias("masked_chars"),
        F.size(turns).cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_own"),
    )


def rotate_perspectives(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """One row for each conversation and participant: the dialogue with that speaker as the assistant.

    The participant's turns are rendered as the assistant's, all others as a named user's. ``mask`` has a digit
    a turn, 1 where the assistant speaks; ``spans`` are the character ranges of ``text`` to learn from (its turns
    with their end marks, ``start-end`` joined by commas), ``masked_chars`` their length. Control strings inside a
    text or a name are escaped (see ``escape``), so that no turn can forge another.

    A dialogue is one row a participant, ``segment`` 0, unless it is longer than ``segment_chars`` (texts, names and
    ``TURN_CHARS`` a turn): then it is cut where a turn starts beyond a multiple of that, in rows that hold one
    segment each, and every participant appears in each. That bounds a row whatever a conversation holds.

    Defined results: a null role is the speaker ``unknown``, a null text is empty, a null conversation is one
    conversation, null turns come last; turns that tie are in order of role and text; rows that repeat are turns
    that repeat; texts of any length are rendered whole; an empty table gives an empty table; other columns are
    not read.
    """
    conv = F.col(conv_col)
    rows = df.select(
        conv.alias("conv_id"),
        F.struct(conv.isNull().alias("none"), F.coalesce(conv.cast("string"), F.lit("")).alias("key")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"),
        escape(F.coalesce(F.col(role_col), F.lit(UNKNOWN))).alias("role"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    ).withColumn("chars", (F.length("text") + F.length("role") + TURN_CHARS).cast("long"))
    rows = _segments(rows, segment_chars)
    line = Window.partitionBy("key", "segment").orderBy(F.asc_nulls_last("turn"), "role", "text")
    as_user = F.length("role") + F.length("text") + len("".join(USER) + END)
    before = F.sum(as_user).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)).cast("long"))
    turns = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    parts = rows.groupBy("key", "segment").agg(F.first("conv_id").alias("conv_id"), turns.alias("turns"))
    parts = scratch_table(parts, "segments")
    said = parts.select("key", F.array_distinct(F.transform("turns", lambda t: t["role"])).alias("roles"))
    speakers = said.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("speakers"), F.count(F.lit(1)).alias("n"))
    speakers = scratch_table(speakers, "speakers")
    views = attach_by_key(parts, speakers, "key", "n", max(1, parts.count()))
    views = views.withColumn("participant", F.explode("speakers"))
    views = views.select("conv_id", "participant", "segment", _render(F.col("turns"), F.col("participant")).alias("v"))
    return views.select("conv_id", "participant", "segment", "v.*")


def chat_report(conversations: DataFrame) -> DataFrame:
    return rotate_perspectives(conversations)


ORACLE = rf"""
WITH e AS (
  SELECT conv_id, turn, regexp_replace(coalesce(role, '{UNKNOWN}'), '<(\\*)\|', '<\\\1|', 'g') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM conversations
), l AS (
  SELECT *, length(text) + length(role) + {TURN_CHARS} AS chars, row_number() OVER () AS id FROM e
), r AS (
  SELECT *, ((sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text, id ROWS UNBOUNDED PRECEDING) - chars)
         // {SEGMENT_CHARS})::BIGINT AS segment
  FROM l
), s AS (
  SELECT DISTINCT conv_id, role AS participant FROM r
), p AS (
  SELECT r.conv_id, s.participant, r.segment, r.turn, r.role, r.text, r.id, r.role = s.participant AS mine,
         CASE WHEN r.role = s.participant THEN '<|assistant|>' || chr(10) ELSE '<|user:' || r.role || '|>' || chr(10) END AS head,
         r.text || '<|end|>' || chr(10) AS body
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER w AS stop FROM p
  WINDOW w AS (PARTITION BY conv_id, participant, segment ORDER BY turn NULLS LAST, role, text, id ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, participant, segment,
       string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text, id) AS text,
       string_agg(CASE WHEN mine THEN '1' ELSE '0' END, '' ORDER BY turn NULLS LAST, role, text, id) AS mask,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY turn NULLS LAST, role, text, id) FILTER (mine), '') AS spans,
       sum(CASE WHEN mine THEN length(body) ELSE 0 END)::BIGINT AS masked_chars,
       count(*) AS n_turns, count(*) FILTER (mine) AS n_own
FROM o GROUP BY conv_id, participant, segment
"""
