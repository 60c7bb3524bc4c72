"""Registered log-table queries; the log lines are derived from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableguard.operators.logs import (
    context_preview,
    entry_by_id,
    latest_entries,
    level_counts,
    newest_log,
    parse_log,
)
from tableguard.plans.registry import register, table
from tableguard.session import scratch_path
from tableguard.sources.logs import read_json_log, read_log_lines, stream_json_log
from tableguard.streaming.logs import read_latest, read_level_counts, write_latest, write_level_counts
from tableguard.streaming.redact import parquet_stream


def log_lines(spark, sf_dir):
    """``(id, line)``: one JSON log line per event; blank lines, broken ones and JSON lists
    where the event's ``k`` is 13, 7 or 17.  ``id`` = 1-based line number."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    level = (F.when(F.col("event_type") == "error", F.lit('"level_name":"ERROR"'))
             .when(F.col("event_type") == "purchase", F.lit('"level_name":"notice"'))
             .when(F.col("event_type") == "signup", F.lit('"level_name":"INFO"'))
             .when(F.col("event_type") == "click", F.lit('"level":"debug"'))
             .otherwise(F.lit('"level":"WARNING"')))
    ctx = (F.when(F.col("event_type") == "view", F.lit("{}"))
           .when(F.col("event_type") == "signup", F.concat(F.lit('{"user_id":'), u, F.lit(',"k":'), k.cast("string"),
                                                            F.lit("}")))
           .otherwise(F.concat(F.lit('{"user_id":'), u, F.lit(',"event_id":'), e, F.lit(',"k":'), k.cast("string"),
                               F.lit(',"note":"'), F.repeat(F.lit("x"), k), F.lit(' end"}'))))
    dt = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = (F.when(k == 13, F.lit("")).when(k == 7, F.lit('{"message": broken')).when(k == 17, F.concat(F.lit('["by user",'), u, F.lit("]")))
            .otherwise(F.concat(F.lit('{"message":"'), F.col("event_type"), F.lit(" by user "), u,
                                F.lit('","channel":"'), F.col("event_type"), F.lit('",'), level,
                                F.lit(',"datetime":"'), dt, F.lit('","context":'), ctx, F.lit(',"extra":{}}'))))
    return ev.select((F.col("event_id") + 1).alias("id"), line.alias("line"))


LINES_SQL = """(SELECT event_id + 1 AS id, CASE
  WHEN k = 13 THEN '' WHEN k = 7 THEN '{"message": broken' WHEN k = 17 THEN '["by user",' || CAST(user_id AS VARCHAR) || ']'
  ELSE '{"message":"' || event_type || ' by user ' || CAST(user_id AS VARCHAR) || '","channel":"' || event_type || '",' ||
    CASE event_type WHEN 'error' THEN '"level_name":"ERROR"' WHEN 'purchase' THEN '"level_name":"notice"'
      WHEN 'signup' THEN '"level_name":"INFO"' WHEN 'click' THEN '"level":"debug"' ELSE '"level":"WARNING"' END ||
    ',"datetime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","context":' ||
    CASE event_type WHEN 'view' THEN '{}'
      WHEN 'signup' THEN '{"user_id":' || CAST(user_id AS VARCHAR) || ',"k":' || CAST(k AS VARCHAR) || '}'
      ELSE '{"user_id":' || CAST(user_id AS VARCHAR) || ',"event_id":' || CAST(event_id AS VARCHAR) || ',"k":' ||
        CAST(k AS VARCHAR) || ',"note":"' || repeat('x', k) || ' end"}' END || ',"extra":{}}'
  END AS line
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

PARSED_SQL = f"""(SELECT id, valid,
  CASE WHEN valid THEN coalesce(json_extract_string(line, '$.message'), '') END AS message,
  CASE WHEN valid THEN coalesce(json_extract_string(line, '$.channel'), '') END AS channel,
  CASE WHEN valid THEN upper(coalesce(json_extract_string(line, '$.level_name'), json_extract_string(line, '$.level'), '')) END AS level,
  CASE WHEN valid THEN coalesce(json_extract_string(line, '$.datetime'), '') END AS datetime,
  CASE WHEN valid THEN CAST(json_extract(line, '$.context') AS VARCHAR) END AS context,
  CASE WHEN valid THEN CAST(json_extract(line, '$.extra') AS VARCHAR) END AS extra
FROM (SELECT id, line, CASE WHEN json_valid(line) THEN json_type(line) IN ('OBJECT', 'ARRAY') ELSE false END AS valid
      FROM {LINES_SQL} WHERE trim(line) <> ''))"""

# a string as it is, true as 1, false as nothing, numbers and null as JSON, lists with their index as key,
# nested values as JSON; longer than 50 bytes: the first 47 bytes (a cut character shows as U+FFFD)
PREVIEW_SQL = """CASE WHEN context IS NULL OR json_type(context) NOT IN ('OBJECT', 'ARRAY') THEN '' ELSE
  (SELECT coalesce(string_agg(CASE WHEN i > 3 THEN '...' ELSE key || ': ' ||
      CASE WHEN strlen(v) > 50 THEN cut || '...' ELSE v END END, chr(10) ORDER BY i), '') FROM (
    SELECT i, key, v, coalesce(try(decode(encode(v)[1:47])), try(decode(encode(v)[1:46])) || chr(65533), try(decode(encode(v)[1:45])) || chr(65533),
        try(decode(encode(v)[1:44])) || chr(65533)) AS cut FROM (
      SELECT row_number() OVER (ORDER BY id) AS i, key, CASE type WHEN 'VARCHAR' THEN json_extract_string(value, '$') WHEN 'BOOLEAN'
        THEN CASE WHEN CAST(value AS VARCHAR) = 'true' THEN '1' ELSE '' END ELSE CAST(value AS VARCHAR) END AS v
      FROM json_each(context)) WHERE i <= 4)) END"""


def _parsed(spark, sf_dir):
    return parse_log(log_lines(spark, sf_dir), "id", "line")


@register("log_parse", f"SELECT * FROM {PARSED_SQL}")
def q_log_parse(spark, sf_dir):
    return _parsed(spark, sf_dir)


@register("log_latest", f"SELECT id, message, channel, level, datetime, {PREVIEW_SQL} AS context_preview "
          f"FROM {PARSED_SQL} WHERE valid ORDER BY id DESC LIMIT 100")
def q_log_latest(spark, sf_dir):
    return latest_entries(_parsed(spark, sf_dir), 100).select(
        "id", "message", "channel", "level", "datetime", context_preview(F.col("context")).alias("context_preview"))


@register("log_by_id", f"SELECT * FROM {PARSED_SQL} WHERE id = (SELECT max(id) FROM {PARSED_SQL} "
          f"WHERE valid AND level = 'ERROR')")
def q_log_by_id(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    target = parsed.where(F.col("valid") & (F.col("level") == "ERROR")).agg(F.max("id")).first()[0]
    count = log_lines(spark, sf_dir).count()
    return entry_by_id(parsed, int(target), count)


@register("log_level", f"SELECT id, level FROM {PARSED_SQL} WHERE valid")
def q_log_level(spark, sf_dir):
    return _parsed(spark, sf_dir).where("valid").select("id", "level")


_COUNTS_SQL = (f"SELECT level, date_trunc('hour', TRY_CAST(datetime AS TIMESTAMP)) AS hour, count(*) AS entries "
               f"FROM {PARSED_SQL} WHERE valid GROUP BY ALL")


@register("log_level_counts", _COUNTS_SQL)
def q_log_level_counts(spark, sf_dir):
    return level_counts(_parsed(spark, sf_dir))


@register("log_context_preview", f"SELECT id, {PREVIEW_SQL} AS context_preview FROM {PARSED_SQL} WHERE valid")
def q_log_context_preview(spark, sf_dir):
    return _parsed(spark, sf_dir).where("valid").select("id", context_preview(F.col("context")).alias(
        "context_preview"))


def _write_lines(spark, sf_dir, name: str) -> str:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    log_lines(spark, sf_dir).select("line").write.mode("overwrite").text(path)
    return path


@register("json_log_scan", f"SELECT message, channel, level, datetime, context FROM {PARSED_SQL} WHERE valid")
def q_json_log_scan(spark, sf_dir):
    path = _write_lines(spark, sf_dir, "log")
    return (read_json_log(spark, path, with_ids=False).where("valid")
            .select("message", "channel", "level", "datetime", "context"))


_FILE_SQL = f"SELECT id, valid, message, channel, level, datetime, context FROM {PARSED_SQL}"


@register("json_log_ids", _FILE_SQL)
def q_json_log_ids(spark, sf_dir):
    """A log in several part files, its lines numbered by the line-offset index."""
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    log_lines(spark, sf_dir).repartitionByRange(5, "id").sortWithinPartitions("id").select("line").write.text(path)
    return read_json_log(spark, path, with_ids=True).select("id", "valid", "message", "channel", "level", "datetime", "context")


@register("log_file_by_id", f"{_FILE_SQL} WHERE id = (SELECT max(id) FROM {PARSED_SQL} WHERE valid AND level = 'ERROR')")
def q_log_file_by_id(spark, sf_dir):
    """The last error of a log file, looked up in the file by its line number."""
    parsed = q_json_log_ids(spark, sf_dir)
    target = parsed.where(F.col("valid") & (F.col("level") == "ERROR")).agg(F.max("id")).first()[0]
    return entry_by_id(parsed, int(target))


_NEWEST_TYPE = "error"


@register("log_newest_file", f"SELECT p.valid, p.message, p.channel, p.level, p.datetime FROM {PARSED_SQL} p "
          f"JOIN events e ON p.id = e.event_id + 1 WHERE e.event_type = '{_NEWEST_TYPE}'")
def q_log_newest_file(spark, sf_dir):
    """A folder of rotated logs ``prod-<type>.log`` in several parts each, the current
    ``prod.log`` (written last) and an unrelated log; the newest of ``prod`` wins, and of
    logs with the same modification time the last by name, which is ``prod.log``."""
    base = scratch_path(spark, f"logdir-{uuid.uuid4().hex}")
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"), "event_type")
    lines = log_lines(spark, sf_dir).join(events, "id")
    rotated = F.when(F.col("event_type") == _NEWEST_TYPE, "other.log").otherwise(F.concat(F.lit("prod-"), "event_type", F.lit(".log")))
    lines.select("line", rotated.alias("log")).repartition(3).write.partitionBy("log").text(base)
    lines.where(F.col("event_type") == _NEWEST_TYPE).select("line", F.lit("prod.log").alias("log")).repartition(4).write.mode("append").partitionBy("log").text(base)
    raw = read_log_lines(spark, f"{base}/log=*/*")
    newest = newest_log(raw, "prod", name_of=lambda path: F.regexp_extract(path, "log=([^/]*)/[^/]*$", 1))
    return parse_log(newest.withColumn("id", F.lit(None).cast("long")), "id", "line").select(
        "valid", "message", "channel", "level", "datetime")


@register("log_tail_stream", _COUNTS_SQL)
def q_log_tail_stream(spark, sf_dir):
    """Level counts per hour from a streaming read of the log folder, in several micro-batches."""
    path = scratch_path(spark, f"logstream-{uuid.uuid4().hex}")
    log_lines(spark, sf_dir).select("line").repartition(6).write.text(path)
    out = scratch_path(spark, f"logcounts-{uuid.uuid4().hex}")
    write_level_counts(stream_json_log(spark, path, max_files_per_trigger=2), out, f"{out}-ckpt")
    return read_level_counts(spark, out)


@register("log_tail_latest", f"SELECT id, message, channel, level, datetime, context FROM {PARSED_SQL} WHERE valid ORDER BY id DESC LIMIT 100")
def q_log_tail_latest(spark, sf_dir):
    """The newest 100 entries of a stream of log lines, after several micro-batches."""
    lines = log_lines(spark, sf_dir)
    path, out = (scratch_path(spark, f"{x}-{uuid.uuid4().hex}") for x in ("logstream", "loglatest"))
    lines.repartition(6).write.parquet(path)
    parsed = parse_log(parquet_stream(spark, path, lines, max_files_per_trigger=2), "id", "line")
    write_latest(parsed, out, f"{out}-ckpt")
    return read_latest(spark, out, parsed).select("id", "message", "channel", "level", "datetime", "context")
