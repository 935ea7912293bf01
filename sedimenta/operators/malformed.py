"""Rows that fail to parse: valid rows come out typed, the others apart with the reason.

Records of both kinds are read permissively under an explicit schema that retains the raw text of what
didn't fit; only such records, and those where the permissive reader would gloss over an error, are
looked at again one by one.  Casts are checked by native expressions for all.
"""

from __future__ import annotations

import json
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the two kinds of record.
CSV_COLUMNS = ("id", "name", "role", "department", "start_year", "active")
JSON_KEYS = ("event", "user_id", "ts")

_TIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.,][0-9]+)?(?:Z|[+-]([0-9]{2})(?::?([0-9]{2}))?)\Z")


def csv_cells(line: str) -> list[str] | None:
    """The cells of one record; None if its quoting is broken.

    A quoted value must be closed and end at a comma or the end of the record; an unquoted value must
    not hold a quote.  Commas and line breaks inside quotes are content.
    """
    cells, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            parts, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                parts.append(line[at:end])
                at = end + 1
                if at < n and line[at] == '"':
                    parts.append('"')
                    at += 1
                else:
                    break
            cells.append("".join(parts))
            if at < n and line[at] != ",":
                return None
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            cell = line[at:end]
            if '"' in cell:
                return None
            cells.append(cell)
            at = end
        if at >= n:
            return cells
        at += 1


def _reject(name: str):
    raise ValueError(name)


def json_reason(line: str) -> tuple[str | None, tuple]:
    """Reason why a JSONL record fails, its time apart, or None with the values of JSON_KEYS."""
    try:
        # numbers are only told from strings: their size doesn't matter
        value = json.loads(line, parse_constant=_reject, parse_int=bool, parse_float=bool)
    except (ValueError, RecursionError):
        return "quoting", ()
    if not isinstance(value, dict):
        return "quoting", ()
    if any(k not in value for k in JSON_KEYS):
        return "columns", ()
    if any(not isinstance(value[k], str) or not value[k].strip() for k in JSON_KEYS):
        return "value", ()
    # half of a surrogate pair can't be written as UTF-8
    return None, tuple(value[k].encode("utf-8", "replace").decode() for k in JSON_KEYS)


def existing_time(text: str) -> bool:
    """An ISO 8601 date and time with seconds and zone that exists in the calendar; ``instant`` tells the same natively."""
    m = _TIME.match(text)
    if not m:
        return False
    try:
        date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return False
    return int(m[4]) < 24 and int(m[5]) < 60 and int(m[6]) < 60 and int(m[7] or 0) < 24 and int(m[8] or 0) < 60


_AGAIN = T.StructType().add("quoting", T.BooleanType()).add("cells", T.ArrayType(T.StringType()))
_JUDGED = T.StructType().add("judged", T.BooleanType()).add("reason", T.StringType()).add("event", T.StringType()).add("user_id", T.StringType()).add("ts", T.StringType())


@F.arrow_udf(_AGAIN)
def _read_again(line: pa.Array) -> pa.Array:
    got = [None if x is None else csv_cells(x) for x in line.to_pylist()]
    bad = [None if x is None else g is None for x, g in zip(line.to_pylist(), got)]
    return pa.StructArray.from_arrays([pa.array(bad, pa.bool_()), pa.array(got, pa.list_(pa.string()))], ["quoting", "cells"])


@F.arrow_udf(_JUDGED)
def _judge_json(line: pa.Array) -> pa.Array:
    got = [(None, ()) if x is None else json_reason(x) for x in line.to_pylist()]
    values = [[v[1][i] if v[1] else None for v in got] for i in range(3)]
    return pa.StructArray.from_arrays([line.is_valid(), pa.array([v[0] for v in got], pa.string()), *(pa.array(v, pa.string()) for v in values)], ["judged", "reason", *JSON_KEYS])


def classify_records(records: DataFrame) -> DataFrame:
    """Every record with its typed values or the reason why it has none.

    Columns: row_id, file_kind, line_no, raw_line, reason (null if valid; ``quoting``, ``columns`` or
    ``value``), id, name, role, department, start_year, active (CSV), event, user_id, ts (JSONL).
    The CSV header (line_no 1) and blank or null records come out neither way; a byte order mark
    opens line 1 only; one carriage return at the end is dropped.  Of an id delivered twice one row
    stays.  Kinds other than csv and jsonl (or null) are left out.
    """
    line = F.regexp_replace("raw_line", r"\r?\n?\z", "")
    line = F.when(F.col("line_no") == 1, F.regexp_replace(line, "\\A\ufeff", "")).otherwise(line)
    kept = (
        records.select("row_id", "file_kind", "line_no", "raw_line")
        .dropDuplicates(["row_id"])
        .withColumn("line", line)
        .filter(F.col("line").rlike(r"[^\s\u00a0\ufeff]"))
    )
    return _csv(kept).unionByName(_jsonl(kept), allowMissingColumns=True)


def _once(c: Column) -> Column:
    """The same value, behind which filters aren't pushed: pushed down, they would parse every record many times over."""
    return F.when(F.spark_partition_id() >= 0, c)


def _csv(kept: DataFrame) -> DataFrame:
    schema = ", ".join(f"{c} STRING" for c in CSV_COLUMNS) + ", corrupt STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "sep": ",", "maxCharsPerColumn": "-1"}
    rows = kept.filter((F.col("file_kind") == "csv") & (F.coalesce("line_no", F.lit(0)) != 1)).withColumn("p", F.from_csv("line", schema, options))
    # the permissive reader glosses over stray quotes and stops at line breaks: such records count as corrupt, too
    corrupt = F.col("p.corrupt").isNotNull() | F.col("p").isNull() | F.col("line").rlike('["\\n\\r\\\\]') | ~F.col("line").rlike(r"\A[^,]*+(?:,[^,]*+){5}\z")
    rows = rows.withColumn("a", _read_again(F.when(corrupt, F.col("line"))))
    again = F.col("a.quoting").isNotNull()
    rows = rows.withColumn("c", F.when(again, F.col("a.cells")).otherwise(F.array(*[F.coalesce(F.col(f"p.{c}"), F.lit("")) for c in CSV_COLUMNS])))
    cell = lambda i: F.get(F.col("c"), i)
    blank = r"\A[\s\u00a0]+|[\s\u00a0]+\z"
    rows = rows.withColumn("i", F.regexp_replace(F.regexp_replace(cell(0), blank, ""), r"\A0+(?=[0-9])", ""))
    big = F.expr("try_cast(i as decimal(20,0))") <= F.lit("9223372036854775807").cast("decimal(20,0)")
    ok = F.col("i").rlike(r"\A[1-9][0-9]{0,18}\z") & big & cell(4).rlike(r"\A(?:19[0-9][0-9]|20[0-9][0-9]|2100)\z") & cell(5).isin("true", "false")
    reason = F.when(F.col("a.quoting"), "quoting").when(F.size("c") != len(CSV_COLUMNS), "columns").when(~F.coalesce(ok, F.lit(False)), "value")
    good = F.col("reason").isNull()
    return rows.withColumn("reason", _once(reason)).select(
        "row_id", "file_kind", "line_no", "raw_line", "reason",
        F.when(good, F.expr("try_cast(i as bigint)")).alias("id"), *[F.when(good, cell(k)).alias(CSV_COLUMNS[k]) for k in (1, 2, 3)],
        F.when(good, F.expr("try_cast(c[4] as int)")).alias("start_year"), F.when(good, cell(5) == "true").alias("active"),
    )


#: A JSON object without nesting, and a key of it that occurs once with a string as value (Java patterns, all possessive).
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_PAIR = rf'{_STRING}[ \t\n\r]*+:[ \t\n\r]*+(?:{_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+|true|false|null)[ \t\n\r]*+'
FLAT_OBJECT = rf"\A[ \t\n\r]*+\{{[ \t\n\r]*+(?:{_PAIR}(?:,[ \t\n\r]*+{_PAIR})*+)?+\}}[ \t\n\r]*+\z"
_TIME_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)\z"
_FRACTION, _ZONE = r"[.,]([0-9]+)", r"([+-])([0-9]{2}):?([0-9]{2})?\z"


def instant(ts: Column) -> Column:
    """The timestamp that an ISO 8601 date and time with seconds and zone denotes, null if there is none; any zone of less than a day."""
    second = F.concat(F.substring(ts, 1, 19), F.lit("Z")).try_cast("timestamp")
    fraction = F.rpad(F.substring(F.regexp_extract(ts, _FRACTION, 1), 1, 6), 6, "0").try_cast("long")
    local = F.when(F.length(ts) == 20, second).otherwise(F.timestamp_micros(F.unix_micros(second) + F.coalesce(fraction, F.lit(0))))
    hours, minutes = (F.coalesce(F.regexp_extract(ts, _ZONE, k).try_cast("long"), F.lit(0)) for k in (2, 3))
    sign = F.when(F.regexp_extract(ts, _ZONE, 1) == "-", F.lit(-60_000_000)).otherwise(F.lit(60_000_000)).cast("long")
    moved = F.when((hours < 24) & (minutes < 60), F.timestamp_micros(F.unix_micros(local) - (hours * 60 + minutes) * sign))
    # most times are in universal time: the others alone are taken apart
    return F.when(ts.rlike(_TIME_SHAPE) & ~ts.startswith("0000"), F.when(ts.endswith("Z"), local).otherwise(moved))


def _jsonl(kept: DataFrame) -> DataFrame:
    schema = ", ".join(f"{k} STRING" for k in JSON_KEYS) + ", corrupt STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    rows = kept.filter(F.col("file_kind") == "jsonl").withColumn("p", F.from_json("line", schema, options))
    line = F.col("line")
    # the permissive reader makes a string of every value and stops behind the first object: only flat objects with each key once, as a string, and without numbered characters are left to it
    corrupt = F.col("p.corrupt").isNotNull() | F.col("p").isNull() | F.contains(line, F.lit("\\u")) | ~line.rlike(FLAT_OBJECT)
    for k in JSON_KEYS:
        twice = F.expr(f"locate('\"{k}\"', line, locate('\"{k}\"', line) + 1) > 0")
        corrupt = corrupt | twice | ~line.rlike(rf'"{k}"[ \t\n\r]*+:[ \t\n\r]*+"')
    # the judge tells which records it got, so that what makes a record corrupt is evaluated once
    rows = rows.withColumn("a", _judge_json(F.when(corrupt, line)))
    value = lambda k: F.when(F.col("a.judged"), F.col(f"a.{k}")).otherwise(F.col(f"p.{k}"))
    rows = rows.select("row_id", "file_kind", "line_no", "raw_line", F.col("a.reason").alias("found"), *[value(k).alias(k) for k in JSON_KEYS]).withColumn("at", instant(F.col("ts")))
    said = lambda k: F.col(k).rlike(r"(?U)[^\s\x1c-\x1f]")
    ok = said("event") & said("user_id") & F.col("at").isNotNull()
    reason = F.coalesce("found", F.when(~F.coalesce(ok, F.lit(False)), "value"))
    good = F.col("reason").isNull()
    return rows.withColumn("reason", _once(reason)).select(
        "row_id", "file_kind", "line_no", "raw_line", "reason", F.when(good, F.col("event")).alias("event"), F.when(good, F.col("user_id")).alias("user_id"), F.when(good, F.col("at")).alias("ts"),
    )


def failed_records(records: DataFrame) -> DataFrame:
    """``row_id, reason`` of the records that fail."""
    return classify_records(records).filter(F.col("reason").isNotNull()).select("row_id", "reason")


def valid_records(records: DataFrame) -> DataFrame:
    """The valid records, typed."""
    return classify_records(records).filter(F.col("reason").isNull()).drop("reason")
