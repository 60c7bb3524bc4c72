"""JSON-lines log tables: parse, latest, by id, levels, context preview, newest file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: must equal the reference's limits ---
DEFAULT_LIMIT = 100        # latest rows shown; <= 0 means this
PREVIEW_KEYS = 3           # context keys shown
PREVIEW_MAX_BYTES = 50     # longer values are cut ...
PREVIEW_CUT = 47           # ... to this many, then "..."
# --- end of fixed values ---

LOG_SCHEMA = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("level_name", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("context", T.StringType()),   # nested objects kept as JSON text
    T.StructField("extra", T.StringType()),
])


def log_level(level_name: Column, level: Column) -> Column:
    """``level_name``, else ``level``, upper-cased ('' when both are missing)."""
    return F.upper(F.coalesce(level_name, level, F.lit("")))


def parse_log(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """``(id, valid, message, channel, level, datetime, context, extra)`` per non-blank line.

    A line is valid when it is a JSON object or list (a list has none of the fields);
    invalid lines keep their id with null fields.  Blank lines are dropped.
    """
    line = F.col(line_col)
    nonblank = df.where(F.btrim(line, F.lit(" \t\n\r\x00\x0b")) != F.lit(""))
    listed = line.rlike(r"^[ \t\r\n]*\[")      # only such a line is read as a list, and only others as objects
    parsed = nonblank.select(F.col(id_col).alias("id"), F.json_object_keys(F.when(~listed, line)).isNotNull().alias("__object"),
                             F.json_array_length(F.when(listed, line)).isNotNull().alias("__list"),
                             F.from_json(F.when(~listed, line), LOG_SCHEMA).alias("__e"))
    parsed = parsed.withColumn("valid", F.col("__object") | F.col("__list"))
    e = lambda f: F.when(F.col("__object"), F.col(f"__e.{f}"))
    text = lambda f: F.when(F.col("valid"), F.coalesce(e(f), F.lit("")))
    return parsed.select("id", "valid", text("message").alias("message"), text("channel").alias("channel"),
                         F.when(F.col("valid"), log_level(e("level_name"), e("level"))).alias("level"),
                         text("datetime").alias("datetime"), e("context").alias("context"), e("extra").alias("extra"))


def latest_entries(parsed: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest ``limit`` valid entries, newest first (a top-k, not a full sort)."""
    n = limit if limit > 0 else DEFAULT_LIMIT
    return parsed.where(F.col("valid")).orderBy(F.col("id").desc()).limit(n)


def entry_by_id(parsed_all: DataFrame, line_id: int, line_count: int | None = None) -> DataFrame:
    """One entry by its 1-based line id.

    Out-of-range ids and lines that are no valid entry (broken or blank) raise
    ``ValueError``; the line is looked up for that, one row.
    """
    if line_id < 1 or (line_count is not None and line_id > line_count):
        raise ValueError(f"Invalid id {line_id}. Valid range is 1..{line_count}.")
    entry = parsed_all.where(F.col("id") == F.lit(line_id))
    row = entry.select("valid").first()
    if row is None or not row["valid"]:
        raise ValueError(f"Line {line_id} is not a valid JSON log entry.")
    return entry


def level_counts(parsed: DataFrame) -> DataFrame:
    """Entries per (level, hour): map-side partial counts, one small shuffle.

    The hour of an entry without a readable time is null.
    """
    hour = F.date_trunc("hour", F.try_to_timestamp(F.col("datetime")))
    return (parsed.where(F.col("valid")).groupBy("level", hour.alias("hour"))
            .agg(F.count(F.lit(1)).alias("entries")))


def _shown(value: Column, kind: Column) -> Column:
    """A context value as text: true is 1, false nothing; strings bare, all else as JSON."""
    return (F.when(kind == "BOOLEAN", F.when(value.cast("string") == "true", "1").otherwise(""))
            .otherwise(F.coalesce(value.cast("string"), F.lit("null"))))


def _cut_bytes(text: Column) -> Column:
    """Longer than ``PREVIEW_MAX_BYTES`` bytes: the first ``PREVIEW_CUT``, then dots.

    The cut counts bytes; a character cut in two shows as U+FFFD.
    """
    data = F.encode(text, "utf-8")
    return F.when(F.octet_length(text) > PREVIEW_MAX_BYTES,
                  F.concat(F.make_valid_utf8(F.substring(data, 1, PREVIEW_CUT).cast("string")), F.lit("..."))).otherwise(text)


def context_preview(context: Column) -> Column:
    """First three ``key: value`` lines of a JSON object or list, long values cut, '...' if more.

    Values are read as variants, so keys may hold any character; a list's keys are 0, 1, 2, ...
    """
    variant = F.try_parse_json(context)
    fields = F.try_variant_get(variant, "$", "map<string,variant>")
    items = F.try_variant_get(variant, "$", "array<variant>")
    keys = F.coalesce(F.json_object_keys(context), F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i.cast("string")))

    def line(k, i):
        v = F.coalesce(F.element_at(fields, k), F.get(items, i))
        return F.concat(k, F.lit(": "), _cut_bytes(_shown(v, F.schema_of_variant(v))))

    shown = F.transform(F.slice(keys, 1, PREVIEW_KEYS), line)
    more = F.when(F.size(keys) > PREVIEW_KEYS, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    none = F.coalesce(F.size(keys), F.lit(0)) <= 0
    none = none | (items.isNotNull() & (F.size(items) == 0))
    return F.when(none, F.lit("")).otherwise(F.array_join(F.concat(shown, more), "\n"))


def newest_log(df: DataFrame, base: str, path_col: str = "file_path", mtime_col: str = "file_modification_time",
               name_of=None) -> DataFrame:
    """The lines of the most recently modified log among ``base.log`` and ``base-*.log``.

    A log may be a folder of part files: ``name_of`` gives a line's log name from its
    file path (default: the last folder or file name that ends in ``.log``), and the log
    is as new as its newest part.  One row per log is compared.
    """
    name = name_of(F.col(path_col)) if name_of else F.regexp_extract(F.col(path_col), r"([^/]*\.log)(?:/[^/]*)?$", 1)
    rows = df.withColumn("__log", name)
    quoted = "".join("\\" + c if not c.isalnum() else c for c in base)
    rows = rows.where(F.col("__log").rlike(f"^{quoted}(-.*)?\\.log$"))
    newest = (rows.groupBy("__log").agg(F.max(mtime_col).alias("m")).orderBy(F.desc("m"), F.desc("__log")).limit(1).select("__log"))
    return rows.join(F.broadcast(newest), "__log", "left_semi").drop("__log")     # one row
