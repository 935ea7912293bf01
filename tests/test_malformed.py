import csv
import io
import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.operators.malformed import classify_records, csv_cells, existing_time, failed_records, instant, valid_records

SCHEMA = "row_id long, source_path string, file_kind string, line_no int, raw_line string, line string, reason string"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, "f", k, n, t, "extra", "extra") for i, (k, n, t) in enumerate(rows)], SCHEMA)
    got = {r["row_id"]: r["reason"] for r in classify_records(df).collect()}
    return [got.get(i, "left out") for i in range(len(rows))]


def test_csv(spark):
    cases = [
        ("1,a,b,c,2000,true", None), (" 7 ,a,b,,2000,false\r", None), ('"1",a,"x, ""y""\nz",c,"2000","true"', None), ("007,,,,1900,true", None), ("9223372036854775807,a,b,c,2100,true", None),
        ('1,"a,b,c,2000,true', "quoting"), ('1,"a"x,b,c,2000,true', "quoting"), ('1,a"b,b,c,2000,true', "quoting"), ('1,"a" ,b,c,2000,true', "quoting"),
        ("1,a,b,c,2000", "columns"), ("1,a,b,c,2000,true,", "columns"), ("x", "columns"),
        ("0,a,b,c,2000,true", "value"), ("-1,a,b,c,2000,true", "value"), ("9223372036854775808,a,b,c,2000,true", "value"), ("٤٢,a,b,c,2000,true", "value"), ("1e3,a,b,c,2000,true", "value"), (",a,b,c,2000,true", "value"),
        ("1,a,b,c,1899,true", "value"), ("1,a,b,c,2101,true", "value"), ("1,a,b,c, 2000,true", "value"), ("1,a,b,c,2000,TRUE", "value"), ("1,a,b,c,2000,", "value"), ("\ufeff1,a,b,c,2000,true", "value"),
        ("", "left out"), ("\r", "left out"), ("  ", "left out"), (None, "left out"), ('"' + "x" * 300_000, "quoting"), ("1," + "x" * 300_000 + ",b,c,2000,true", None), ('1,"' + '""' * 50_000 + '",b,c,2000,true', None),
    ]
    assert reasons(spark, [("csv", 2, t) for t, _ in cases]) == [r for _, r in cases]
    assert reasons(spark, [("csv", 1, "id,name"), ("tsv", 2, "1"), (None, 2, "1")]) == ["left out"] * 3


def test_jsonl(spark):
    ok = '{"event":"e","user_id":"u","ts":"2025-02-28T23:59:59Z"}'
    cases = [
        (ok, None), (ok + "\r", None), ('{"x":{"y":[1,2]},"ts":"2024-02-29T00:00:00.25+05:30","event":"e","user_id":"u"}', None), (" " + ok + " ", None),
        ("42", "quoting"), (ok + ok, "quoting"), (ok[:-1], "quoting"), (ok[:-1] + ",}", "quoting"), ("{event:1}", "quoting"), ("[" + ok + "]", "quoting"), ('{"event":NaN}', "quoting"), ("[" * 100_000, "quoting"), ("\ufeff" + ok, "quoting"),
        ('{"event":"e","user_id":"u"}', "columns"), ('{"Event":"e","user_id":"u","ts":"x"}', "columns"), ("{}", "columns"),
        (ok.replace('"e"', "true"), "value"), (ok.replace('"u"', '" "'), "value"), (ok.replace("02-28", "02-30"), "value"), (ok.replace("23:59:59", "24:00:00"), "value"), (ok.replace("Z", ""), "value"), (ok.replace(":59Z", "Z"), "value"), (ok.replace('"2025-02-28T23:59:59Z"', "null"), "value"),
        ("", "left out"),
    ]
    assert reasons(spark, [("jsonl", 2, t) for t, _ in cases]) == [r for _, r in cases]
    assert reasons(spark, [("jsonl", 1, "\ufeff" + ok)]) == [None]


    again = lambda t: ok[:-1] + t + "}"
    more = [
        (again(',"n":{"event":1}'), None), (again(',"event":2'), "value"), (again(',"x":"event"'), None), (again(r',"x":"\ud800"'), None), (ok.replace('"event"', r'"\u0065vent"'), None), (ok.replace('"e"', r'"\u00a0\u001c"'), "value"),
        (ok.replace('"u"', r'"\ud83d\ude00"'), None), (ok.replace('"u"', r'"\ud83d"'), None), (again(",'x':1"), "quoting"), (again(',"x":01'), "quoting"), (again(',"x":1.'), "quoting"), (again(',"x":-Infinity'), "quoting"), (again(',"x":"\t"'), "quoting"),
        (again(',"x":' + "9" * 5000), None), (again(',"x":"' + "\\n" * 100_000 + '"'), None), (again("".join(f',"k{i}":{i}' for i in range(20_000))), None),
    ]
    assert reasons(spark, [("jsonl", 2, t) for t, _ in more]) == [r for _, r in more]


TIMES = [
    ("2025-01-02T03:04:05,5Z", "2025-01-02 03:04:05.5"), ("2025-01-02T03:04:05+23:30", "2025-01-01 03:34:05"), ("2025-01-02T03:04:05-2330", "2025-01-03 02:34:05"), ("2025-01-02T03:04:05.123456789+05", "2025-01-01 22:04:05.123456"),
    ("0001-01-01T00:00:00Z", "0001-01-01 00:00:00"), ("2024-02-29T23:59:59Z", "2024-02-29 23:59:59"), ("2025-01-02T03:04:05+00:00", "2025-01-02 03:04:05"),
    *((t, None) for t in ("0000-01-01T00:00:00Z", "2025-02-29T00:00:00Z", "2025-01-02T24:00:00Z", "2025-01-02T03:60:05Z", "2025-01-02T03:04:60Z", "2025-01-02T03:04:05+24:00", "2025-01-02T03:04:05+05:60", "2025-01-02T03:04:05", "2025-01-02 03:04:05Z", "2025-01-02T03:04:05Z ", "x", "", "2025-13-01T00:00:00Z", "2025-00-10T00:00:00Z", "2025-01-02T03:04:05.Z", "20250102T030405Z")),
]


def test_every_valid_time_has_a_value(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string").select("i", instant(F.col("t")).cast("string").alias("at"))
    got = {r["i"]: r["at"] for r in df.collect()}
    assert [got[i] for i in range(len(TIMES))] == [at for _, at in TIMES]
    assert [existing_time(t) for t, _ in TIMES] == [at is not None for _, at in TIMES]
    rows = [(i, "f", "jsonl", 2, json.dumps({"event": "e", "user_id": "u", "ts": t, "more": {"x": i} if i % 2 else i}), "x", "y") for i, (t, _) in enumerate(TIMES)]
    classified = classify_records(spark.createDataFrame(rows, SCHEMA)).select("row_id", "reason", F.col("ts").cast("string").alias("ts")).collect()
    assert {r["row_id"]: r["ts"] is not None for r in classified} == {i: at is not None for i, (_, at) in enumerate(TIMES)}
    assert all((r["reason"] is None) == (r["ts"] is not None) for r in classified)


def test_typed_once_and_empty(spark):
    rows = [(1, "f", "csv", 2, '5,"A, B",r,d,1999,false', "x", "y")] * 2 + [(2, "f", "csv", 3, "nope", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    (r,) = valid_records(df).collect()
    assert (r["id"], r["name"], r["role"], r["department"], r["start_year"], r["active"]) == (5, "A, B", "r", "d", 1999, False)
    assert [tuple(x) for x in failed_records(df).collect()] == [(2, "columns")]
    assert failed_records(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.text(alphabet='ab,"\n ', max_size=6), min_size=1, max_size=5))
def test_round_trip(cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    if out.getvalue():
        assert csv_cells(out.getvalue()) == cells


def test_times():
    assert existing_time("2000-02-29T00:00:00Z") and existing_time("2025-01-01T00:00:00,5-0330")
    assert not existing_time("1900-02-29T00:00:00Z") and not existing_time("2025-01-01 00:00:00Z") and not existing_time("2025-01-01T00:00Z")
