"""Queries p1, p3 and p4 over the archive tables, and what DuckDB must give for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators import incremental, references, timestamps
from quaystone.session import shared_folder, table

#: The time up to which the first of two runs sees the archive.
CUT = "2024-10-01T00:00:00Z"


def _sync(spark: SparkSession, base: str) -> incremental.SyncRun:
    return incremental.SyncRun(spark, shared_folder(spark, f"sync-{uuid.uuid4().hex}"), table(spark, base, "crawl_watermark"))


def next_sync(spark: SparkSession, base: str) -> DataFrame:
    """What one committed run puts out; its watermarks start from the crawl log."""
    run = _sync(spark, base)
    run.run(table(spark, base, "post"))
    return run.output()


class _Lost(RuntimeError):
    pass


def _lose(*_):
    raise _Lost


def two_syncs(spark: SparkSession, base: str) -> DataFrame:
    """``(run, channel, message_id)`` of two runs, the first over what was fetched by CUT, with a run that is lost before its commit in between."""
    run, posts = _sync(spark, base), table(spark, base, "post")
    run.run(posts.where(F.col("fetched_at") <= F.lit(CUT).cast("timestamp")))
    try:
        run.run(posts, _lose)
    except _Lost:
        pass
    run.run(posts)
    run.run(posts)  # nothing is due any more
    return run.output(1).select(F.lit(1).alias("run"), "*").unionByName(run.output(2).select(F.lit(2).alias("run"), "*"))


def rows_once(spark: SparkSession, base: str) -> DataFrame:
    """``(row_id, fetched)``: every row of post by two runs along (fetched_at, row_id) with a lost one in between."""
    run = incremental.IncrementalRun(spark, shared_folder(spark, f"rows-{uuid.uuid4().hex}"), ["fetched_at", "row_id"])
    posts, kept = table(spark, base, "post"), lambda df: df.select("row_id", F.unix_micros("fetched_at").alias("fetched"))
    run.run(posts.where(F.col("fetched_at") <= F.lit(CUT).cast("timestamp")), kept)
    try:
        run.run(posts, _lose)
    except _Lost:
        pass
    run.run(posts, kept)
    found = run.output()
    return found if found is not None else kept(posts)


QUERIES = {
    "p1_found": next_sync,
    "p1_pending_by_channel": lambda s, d: incremental.pending_counts(next_sync(s, d)),
    "p1_two_syncs": two_syncs,
    "p1_rows_once": rows_once,
    "p1_pending_uncommitted": lambda s, d: incremental.pending_posts(table(s, d, "post"), table(s, d, "crawl_watermark")),
    "p3_found": lambda s, d: references.orphan_rows(table(s, d, "post"), table(s, d, "channel")),
    "p3_orphans_by_month": lambda s, d: references.orphan_report(table(s, d, "post"), table(s, d, "channel")),
    "p4_found": lambda s, d: timestamps.dirty_instants(table(s, d, "post"), table(s, d, "link"), table(s, d, "channel")),
    "p4_by_month": lambda s, d: timestamps.instants_by_month(table(s, d, "post"), table(s, d, "link"), table(s, d, "channel")),
    "p4_findings": lambda s, d: timestamps.findings(table(s, d, "post"), table(s, d, "link"), table(s, d, "channel")),
}

_PENDING = """
WITH mark AS (
  SELECT DISTINCT ON (channel) channel, finished_at, lowest_message_id AS low, highest_message_id AS high, coalesce(is_backfill_complete, false) AS complete
  FROM crawl_watermark
  WHERE outcome = 'succeeded' AND lowest_message_id IS NOT NULL AND highest_message_id IS NOT NULL AND finished_at IS NOT NULL
  ORDER BY channel, finished_at DESC, walk_id DESC),
rows AS (
  SELECT p.*, coalesce(p.fetched_at <= m.finished_at AND p.message_id <= m.high AND (m.complete OR p.message_id >= m.low), false) AS handled
  FROM post p LEFT JOIN mark m USING (channel)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY channel, message_id ORDER BY fetched_at DESC, row_id DESC) AS rn,
         row_number() OVER (PARTITION BY channel, message_id, handled ORDER BY fetched_at DESC, row_id DESC) AS rh
  FROM rows),
pending AS (
  SELECT n.channel, n.message_id
  FROM ranked n LEFT JOIN ranked h ON h.channel = n.channel AND h.message_id = n.message_id AND h.handled AND h.rh = 1
  WHERE n.rn = 1 AND (h.row_id IS NULL OR n.text IS DISTINCT FROM h.text OR n.is_edited IS DISTINCT FROM h.is_edited OR n.deleted_at IS DISTINCT FROM h.deleted_at))
"""

_ORPHANS = """
WITH newest AS (
  SELECT DISTINCT ON (channel, message_id) channel, message_id, media_count, deleted_at FROM post ORDER BY channel, message_id, fetched_at DESC, row_id DESC),
living AS (
  SELECT lower(channel) AS channel, unnest(range(message_id, message_id + greatest(coalesce(media_count, 1), 1))) AS id FROM newest WHERE deleted_at IS NULL),
refs AS (
  SELECT row_id, 'reply_to' AS field, 'post' AS parent_table, strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m') AS period, lower(channel) AS channel, reply_to AS id FROM post WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT row_id, 'forward', 'channel', strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m'), lower(regexp_replace(forward_channel, '^@+', '')), NULL FROM post WHERE forward_channel IS NOT NULL
  UNION ALL
  SELECT row_id, 'forward', 'post', strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m'), lower(regexp_replace(forward_channel, '^@+', '')), forward_message_id FROM post WHERE forward_channel IS NOT NULL AND forward_message_id IS NOT NULL),
orphan AS (
  SELECT * FROM refs r
  WHERE (parent_table = 'post' AND NOT EXISTS (SELECT 1 FROM living l WHERE l.channel = r.channel AND l.id = r.id))
     OR (parent_table = 'channel' AND NOT EXISTS (SELECT 1 FROM channel c WHERE lower(c.channel) = r.channel)))
"""

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONED = r"((?:UTC)?[+-]\d{2}(?::?\d{2})?|Z|[A-Z]{2,5})?"
_SPELLED = [
    (rf"^(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})[T ]{_CLOCK} ?{_ZONED}$", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK} ?{_ZONED}$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONED}$", r"\1|\2|\3|\4|\5|\6|||\7"),
    (rf"^(?:\p{{L}}{{2,4}}, )?(\d{{1,2}})(?:\.|º|er)? (?:de )?(\p{{L}}+)\.? (?:de )?(\d{{4}})(?: [гр]\.)?,? {_CLOCK} ?{_ZONED}$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^(\p{{L}}+)\.? (\d{{1,2}}), (\d{{4}}),? {_CLOCK}[ \x{{202F}}]?([AP]M)$", r"\3|\1|\2|\4|\5|\6|\7|\8|"),
]


def _map(values: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


_INSTANTS = f"""
WITH vals AS (
  SELECT 'post' AS src, row_id AS src_id, channel, date AS v FROM post
  UNION ALL SELECT 'link', link_id, channel, preview.observed_at FROM link),
zones AS (SELECT channel, max(time_zone) AS zone FROM channel GROUP BY channel),
texts AS (SELECT DISTINCT src, src_id, channel, zone, trim(regexp_replace(v, '[\\s\\x{{A0}}]+', ' ', 'g')) AS t FROM vals LEFT JOIN zones USING (channel) WHERE v IS NOT NULL AND NOT regexp_matches(v, '{timestamps.CANONICAL}')),
cut AS (SELECT *, string_split(CASE {" ".join(f"WHEN regexp_matches(t, '{a}') THEN regexp_replace(t, '{a}', '{b}')" for a, b in _SPELLED)} END, '|') AS f FROM texts),
parts AS (
  SELECT *, try_cast(f[1] AS INTEGER) AS y, coalesce(try_cast(f[2] AS INTEGER), {_map(timestamps.MONTHS)}[lower(f[2])]) AS mo, try_cast(f[3] AS INTEGER) AS d,
    CASE WHEN f[8] = '' THEN try_cast(f[4] AS INTEGER) WHEN try_cast(f[4] AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(f[4] AS INTEGER) % 12 + CASE WHEN f[8] = 'PM' THEN 12 ELSE 0 END END AS h,
    try_cast(f[5] AS INTEGER) AS mi, CASE WHEN f[6] = '' THEN 0 ELSE try_cast(f[6] AS INTEGER) END AS s, CAST(rpad(f[7][1:6], 6, '0') AS BIGINT) AS us, regexp_replace(f[9], '^UTC([+-])', '\\1') AS given FROM cut),
walls AS (
  SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE) + to_hours(h) + to_minutes(mi) + to_seconds(s) + to_microseconds(us) END AS wall,
    CASE WHEN regexp_matches(given, '^[+-]') THEN (CASE WHEN given[1] = '-' THEN -1 ELSE 1 END) * (CAST(given[2:3] AS INTEGER) * 60 + coalesce(try_cast(replace(given, ':', '')[4:5] AS INTEGER), 0)) ELSE {_map(timestamps.ABBREVIATIONS)}[given] END AS shift FROM parts),
placed AS (
  SELECT *, CASE WHEN given = '' AND zone IS NOT NULL AND wall IS NOT NULL THEN wall AT TIME ZONE zone END AS local_at FROM walls),
instants AS (
  SELECT src, src_id, CASE WHEN regexp_matches(t, '^\\d{{10}}$') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_matches(t, '^\\d{{13}}$') THEN CAST(t AS BIGINT) * 1000 WHEN regexp_matches(t, '^\\d{{16}}$') THEN CAST(t AS BIGINT)
    WHEN given <> '' THEN epoch_us(wall) - CAST(shift AS BIGINT) * 60000000
    WHEN (local_at - INTERVAL 1 HOUR) AT TIME ZONE zone = wall THEN epoch_us(local_at - INTERVAL 1 HOUR) WHEN (local_at AT TIME ZONE zone) = wall THEN epoch_us(local_at) END AS us,
    given = '' AND wall IS NOT NULL AS by_wall, zone, wall IS NOT NULL AND (local_at AT TIME ZONE zone) = wall AND (((local_at - INTERVAL 1 HOUR) AT TIME ZONE zone) = wall OR ((local_at + INTERVAL 1 HOUR) AT TIME ZONE zone) = wall) AS twice FROM placed)
"""

SQL = {
    "p4_found": _INSTANTS + "SELECT DISTINCT src, src_id, CAST(floor(us / 1000.0) AS BIGINT) AS utc_ms FROM instants WHERE us IS NOT NULL",
    "p4_findings": _INSTANTS + """SELECT src, finding, count(*) AS "values" FROM (SELECT DISTINCT src, src_id, CASE WHEN twice THEN 'ambiguous' WHEN us IS NOT NULL THEN 'instant' WHEN NOT coalesce(by_wall, false) THEN 'unreadable' WHEN zone IS NULL THEN 'no_zone' ELSE 'nonexistent' END AS finding FROM instants) GROUP BY src, finding""",
    "p4_by_month": _INSTANTS + "SELECT src, strftime(make_timestamp(us), '%Y-%m') AS month, count(*) AS values FROM (SELECT DISTINCT src, src_id, us // 1000 AS ms, min(us) AS us FROM instants WHERE us IS NOT NULL GROUP BY ALL) GROUP BY src, month".replace("AS values", 'AS "values"'),
    "p1_found": _PENDING + "SELECT channel, message_id FROM pending",
    "p1_pending_by_channel": _PENDING + "SELECT channel, count(*) AS pending, min(message_id) AS lowest, max(message_id) AS highest FROM pending GROUP BY channel",
    "p1_pending_uncommitted": _PENDING + "SELECT channel, message_id FROM pending",
    "p1_two_syncs": f"""WITH first_run AS ({_PENDING.replace("FROM post p", f"FROM (SELECT * FROM post WHERE fetched_at <= TIMESTAMPTZ '{CUT}') p")} SELECT 1 AS run, channel, message_id FROM pending),
second_run AS ({_PENDING.replace(" AS handled", f" OR coalesce(p.fetched_at <= TIMESTAMPTZ '{CUT}', false) AS handled")} SELECT 2 AS run, channel, message_id FROM pending)
SELECT * FROM first_run UNION ALL SELECT * FROM second_run""",
    "p1_rows_once": "SELECT row_id, epoch_us(fetched_at) AS fetched FROM post WHERE fetched_at IS NOT NULL AND row_id IS NOT NULL",
    "p3_found": _ORPHANS + "SELECT DISTINCT row_id, field FROM orphan",
    "p3_orphans_by_month": _ORPHANS + "SELECT field, parent_table, period, count(*) AS refs, count(DISTINCT (channel, coalesce(id, -1))) AS keys FROM orphan GROUP BY field, parent_table, period",
}
