"""Log lines: parsing, levels, protocol entries, and sessions by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions.text import log_level
from lodewell.plans import scan

#: Line formats with time, level, source and message.
FORMATS = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,.:]\d{3})\s+\[?(\w+)\]?\s+\[?(\w+)\]?\s*[-:]?\s*(.*)",
    r"^\[(\d{2}:\d{2}:\d{2})\]\s+\[?(\w+)\]?\s+\[?(\w+)\]?\s*[-:]?\s*(.*)",
)
#: Words of protocol traffic.
PROTOCOL_WORDS = ("send", "recv", "tx", "rx", "packet", "frame", "cmd", "ack", "nack", "connect", "disconnect", "publish", "subscribe", "ble", "can", "mqtt", "dp_", "data_point", "payload", "protocol", "0x", "frame_id")


def parse_lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per non-blank line: key, line_number (from 1), timestamp, level, source, message, raw_line, id, legacy_id."""
    rows = files.select(F.col(key), F.posexplode(F.split(F.col(content), "\n", -1)).alias("n", "line"))
    rows = rows.select(key, (F.col("n") + 1).alias("line_number"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("raw_line")).where("raw_line != ''")
    line = F.col("raw_line")

    def part(i: int, other: Column) -> Column:
        return F.when(line.rlike(FORMATS[0]), F.regexp_extract(line, FORMATS[0], i)).when(line.rlike(FORMATS[1]), F.regexp_extract(line, FORMATS[1], i)).otherwise(other)

    return rows.select(key, "line_number", part(1, F.lit(None)).alias("timestamp"), part(2, log_level(line)).alias("level"), part(3, F.lit("unknown")).alias("source"), part(4, line).alias("message"), "raw_line", F.concat_ws(":", F.lit("log"), F.col(key).cast("string"), F.col("line_number").cast("string")).alias("id"), F.concat(F.lit("log:"), F.col("line_number").cast("string")).alias("legacy_id"))


def parse_timestamp(ts: Column) -> Column:
    """The first of the known formats that reads; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(ts, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss.SSS", "HH:mm:ss", "yyyy/MM/dd HH:mm:ss")])


def protocol_entries(entries: DataFrame) -> DataFrame:
    return entries.where(F.lower("raw_line").rlike("|".join(PROTOCOL_WORDS)) | F.lower("message").rlike("|".join(PROTOCOL_WORDS)))


def _begins(ts: Column, has: Column, before: Column, had: Column, seconds: float) -> Column:
    """1 where a row begins a session, seen from the row before it."""
    gap = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return F.when(has & had & (gap.isNull() | (gap > int(seconds * 1_000_000))), 1).otherwise(0)


def gap_sessions(entries: DataFrame, keys: list[str], order: list[str], ts: str, seconds: float = 5.0, present: Column | None = None, parts: int | None = None) -> DataFrame:
    """entries with `session` (from 0 in each key): a gap over `seconds` begins a new one.

    A row without time joins the session it meets, as does the row after it; so does a row that goes back in
    time. A time that is present but cannot be read begins a session of its own. With `parts`, a key's rows are
    worked through in that many ranges or so, by as many tasks (`plans.scan`): for few keys with very many rows.
    """
    rows = entries.withColumn("_has", present if present is not None else F.col(ts).isNotNull())
    if parts:
        ranges = scan.before(scan.dealt(rows, keys, order, parts), keys, order, {"_before": F.col(ts), "_had": F.col("_has")})
        flagged = ranges.withColumn("_new", _begins(F.col(ts), F.col("_has"), F.col("_before"), F.col("_had"), seconds)).drop("_before", "_had", "_first")
        return scan.running_sum(flagged, keys, order, "_new", "session").select(*entries.columns, "session")
    w = Window.partitionBy(*keys).orderBy(*order)
    new = _begins(F.col(ts), F.col("_has"), F.lag(F.col(ts)).over(w), F.lag("_has").over(w), seconds)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_has")


def session_totals(sessions: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return sessions.groupBy(*keys, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
