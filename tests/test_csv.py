"""CSV import/export: dialect options, bad lines kept whole, skip/max rows, limits."""

from __future__ import annotations

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from sensorlake.functions.time import strftime_to_spark
from sensorlake.operators.keys import token_splits
from sensorlake.sources.csv import ParseErrorLimitExceeded, export_csv, import_csv

SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("v", DoubleType()),
        StructField("b", BooleanType()),
        StructField("ts", TimestampType()),
    ]
)

LINES = [
    "id;v;b;ts",
    '1;"1.234,5";yes;2024-01-01 10:00:00+0000',  # quoted number with thousands dot and decimal comma
    "2;;NO;",  # empty = NULL, style boolean case-insensitive
    "3;7,25;maybe;2024-01-01 10:00:00+0000",  # boolean not in the style
    "4;5;yes;2024-01-01 10:00:00+0000;extra",  # one column too many
    "5;6",  # one too few
    '6;"8,5";no;2024-01-02 11:30:00+0100',
    "7;abc;yes;2024-01-01 10:00:00+0000",  # not a number
]


def write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_import_options_and_bad_lines(spark, scratch):
    write(scratch, "a.csv", LINES)
    good, bad = import_csv(
        spark, f"{scratch}/*.csv", SCHEMA, delimiter=";", decimalsep=",", thousandssep=".",
        boolstyle="yes,no", header=True,
    )
    g = {r.id: r for r in good.collect()}
    assert set(g) == {1, 2, 6}
    assert g[1].v == 1234.5 and g[1].b is True and g[1].ts == datetime(2024, 1, 1, 10, 0)
    assert g[2].v is None and g[2].b is False and g[2].ts is None
    assert g[6].v == 8.5 and g[6].ts == datetime(2024, 1, 2, 10, 30)
    b = {r.line.split(";")[0]: r for r in bad.collect()}
    assert set(b) == {"3", "4", "5", "7"}
    assert sorted(r.line for r in b.values()) == sorted([LINES[3], LINES[4], LINES[5], LINES[7]])  # as in the file
    assert b["4"].reason == "malformed_line" and b["3"].reason == "bad_value:b"
    assert b["7"].reason == "bad_value:v"
    assert all(r.source.endswith("a.csv") for r in bad.collect())


def test_maxparseerrors_and_errfile(spark, scratch):
    write(f"{scratch}/in", "a.csv", LINES)
    opts = dict(delimiter=";", decimalsep=",", thousandssep=".", boolstyle="yes,no", header=True)
    with pytest.raises(ParseErrorLimitExceeded):
        import_csv(spark, f"{scratch}/in", SCHEMA, maxparseerrors=3, **opts)
    good, _ = import_csv(spark, f"{scratch}/in", SCHEMA, maxparseerrors=4, errfile=f"{scratch}/err", **opts)
    assert good.count() == 3
    import_csv(spark, f"{scratch}/in", SCHEMA, maxparseerrors=4, errfile=f"{scratch}/err", **opts)
    err = sorted(r.value for r in spark.read.text(f"{scratch}/err").collect())
    assert err == sorted(2 * [LINES[3], LINES[4], LINES[5], LINES[7]])


def test_columns_skipcols_and_names(spark, scratch):
    write(scratch, "a.csv", ["x,10", "y,20"])
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    good, bad = import_csv(spark, scratch, schema, columns=['"name"', "ID"], skipcols=("name",))
    assert good.columns == ["id"]
    assert sorted(r.id for r in good.collect()) == [10, 20]


def test_skiprows_maxrows_over_files_sorted_by_path(spark, scratch):
    write(scratch, "b.csv", [str(i) for i in range(50, 100)])
    write(scratch, "a.csv", [str(i) for i in range(0, 50)])
    schema = StructType([StructField("n", LongType())])
    good, _ = import_csv(spark, [f"{scratch}/b.csv", f"{scratch}/a.csv"], schema, skiprows=45, maxrows=10)
    assert sorted(r.n for r in good.collect()) == list(range(45, 55))
    good, _ = import_csv(spark, scratch, schema, skiprows=95)
    assert sorted(r.n for r in good.collect()) == list(range(95, 100))
    good, _ = import_csv(spark, scratch, schema, maxrows=3)
    assert sorted(r.n for r in good.collect()) == [0, 1, 2]


def test_export_import_round_trip_each_option(spark, scratch):
    rows = [(1, 1234.5, True, datetime(2024, 1, 1, 10, 0, 0, 123456)), (2, None, False, None), (3, -0.25, None, datetime(2024, 2, 29, 23, 59, 59))]
    df = spark.createDataFrame(rows, SCHEMA)
    variants = [
        {},
        {"delimiter": "|", "quote": "'", "header": True},
        {"decimalsep": ",", "thousandssep": ".", "delimiter": ";"},
        {"boolstyle": "1,0", "null": "NULL"},
        {"datetimeformat": "%Y-%m-%d %H:%M:%S.%f%z"},
    ]
    for i, opts in enumerate(variants):
        path = f"{scratch}/rt{i}"
        export_csv(df, path, **opts)
        good, bad = import_csv(spark, path, SCHEMA, **opts)
        assert bad.count() == 0, opts
        got = sorted(map(tuple, good.collect()), key=repr)
        want = sorted(map(tuple, df.collect()), key=repr)
        if "%f" not in opts.get("datetimeformat", ""):
            want = [(a, b, c, d.replace(microsecond=0) if d else d) for a, b, c, d in want]
        assert got == want, opts


def test_maxoutputsize_and_token_range(spark, scratch):
    df = spark.range(10).selectExpr("id", "cast(id as double) as v", "id % 2 = 0 as b", "cast(null as timestamp) as ts").coalesce(1)
    export_csv(df, f"{scratch}/o", maxoutputsize=4)
    assert len(glob.glob(f"{scratch}/o/*.csv")) == 3
    total = 0
    for i, (b, e) in enumerate(token_splits(3)):
        export_csv(df, f"{scratch}/tr{i}", begintoken=b, endtoken=e, token_keys=["id"])
        total += spark.read.csv(f"{scratch}/tr{i}").count()
    assert total == 10


def test_strftime_translation():
    assert strftime_to_spark("%Y-%m-%d %H:%M:%S%z") == "yyyy-MM-dd HH:mm:ssxx"
    assert strftime_to_spark("%d/%m/%Y") == "dd/MM/yyyy"
    assert strftime_to_spark("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        strftime_to_spark("%a %Y")


def test_ttl_adds_expiry(spark, scratch):
    write(scratch, "a.csv", ["1,2.5,true,"])
    good, _ = import_csv(spark, scratch, SCHEMA, ttl=3600, boolstyle="true,false")
    r = good.selectExpr("expires_at - current_timestamp() AS left").first()
    assert 3500 < r.left.total_seconds() <= 3600


def test_streaming_import_rate(spark, scratch):
    for i in range(4):
        write(f"{scratch}/in", f"p{i}.csv", [f"{i}1,1.5,True,", f"{i}2,x,True,", f"{i}3,2.5,False,"])
    good, bad = import_csv(spark, f"{scratch}/in", SCHEMA, stream=True, max_files_per_trigger=1)
    assert good.isStreaming
    qg = good.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c1").trigger(availableNow=True).start(f"{scratch}/g")
    qb = bad.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c2").trigger(availableNow=True).start(f"{scratch}/b")
    qg.awaitTermination()
    qb.awaitTermination()
    assert len(qg.recentProgress) >= 4  # one file per micro-batch
    assert spark.read.parquet(f"{scratch}/g").count() == 8
    b = spark.read.parquet(f"{scratch}/b").collect()
    assert len(b) == 4 and all(r.reason == "bad_value:v" for r in b)
    with pytest.raises(ValueError):
        import_csv(spark, f"{scratch}/in", SCHEMA, stream=True, maxrows=3)


def test_decimal_and_integer_export_keep_every_digit(spark, scratch):
    from decimal import Decimal

    schema = StructType([StructField("n", LongType()), StructField("d", DecimalType(38, 4))])
    df = spark.createDataFrame([(9007199254740993, Decimal("12345678901234567890.1234")), (-5, Decimal("-0.5000"))], schema)
    export_csv(df, f"{scratch}/o", delimiter=";", decimalsep=",", thousandssep=".")
    lines = sorted(r.value for r in spark.read.text(f"{scratch}/o").collect())
    assert lines == ["-5;-0,5000", "9.007.199.254.740.993;12.345.678.901.234.567.890,1234"]
    good, bad = import_csv(spark, f"{scratch}/o", schema, delimiter=";", decimalsep=",", thousandssep=".")
    assert bad.count() == 0
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, df.collect()))


def test_skip_and_max_rows_exact_when_files_are_split(spark, scratch):
    write(scratch, "big.csv", [f"{i},{i * 0.5}" for i in range(3000)])
    write(scratch, "small.csv", [f"{i},{i * 0.5}" for i in range(3000, 3100)])
    schema = StructType([StructField("n", LongType()), StructField("v", DoubleType())])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    old_open = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # ~15 splits of big.csv
        spark.conf.set("spark.sql.files.openCostInBytes", "0")  # several splits share a task
        for skip, mx in [(0, 10), (1234, 500), (2990, 50), (3050, 1000), (5, -1)]:
            good, _ = import_csv(spark, scratch, schema, skiprows=skip, maxrows=mx)
            got = sorted(r.n for r in good.collect())
            stop = 3100 if mx < 0 else min(3100, skip + mx)
            assert got == list(range(skip, stop)), (skip, mx)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", old_open)


def test_bad_lines_keep_their_quotes_and_spaces(spark, scratch):
    lines = ['"x, y" ,"q""r",  notnum ', '"plain",b,zz', "ok,b,5"]
    write(scratch, "a.csv", lines)
    schema = StructType([StructField(n, StringType()) for n in "ab"] + [StructField("n", LongType())])
    good, bad = import_csv(spark, scratch, schema, escape='"')
    assert good.count() == 1 and sorted(r.line for r in bad.collect()) == sorted(lines[:2])


def test_header_encoding_and_row_range_agree(spark, scratch):
    for name, ids in (("a", range(0, 40)), ("b", range(40, 45)), ("c", range(45, 100))):
        with open(os.path.join(scratch, f"{name}.csv"), "w", encoding="latin-1") as f:
            f.write("n;t\n" + "".join(f"{i};é{i}ü\n" for i in ids))
    schema = StructType([StructField("n", LongType()), StructField("t", StringType())])
    for skip, most in ((0, -1), (0, 1000), (7, 50), (40, 5), (44, 3), (99, 9), (100, 5), (0, 0)):
        good, bad = import_csv(spark, scratch, schema, delimiter=";", header=True, encoding="latin1", skiprows=skip, maxrows=most)
        want = [(i, f"é{i}ü") for i in range(100)][skip : None if most < 0 else skip + most]
        assert sorted(map(tuple, good.collect())) == want and bad.count() == 0, (skip, most)


def test_row_range_does_not_move_with_the_splits(spark, scratch):
    write(scratch, "big.csv", [f"{i},{i * 0.5}" for i in range(5000)])
    schema = StructType([StructField("n", LongType()), StructField("v", DoubleType())])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("2048", "0")):
            spark.conf.set(n, v)
        good, _ = import_csv(spark, scratch, schema, skiprows=1250, maxrows=3000)
        for n, v in zip(names, ("9000", "100")):
            spark.conf.set(n, v)
        assert sorted(r.n for r in good.collect()) == list(range(1250, 4250))
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_quoted_line_breaks(spark, scratch):
    schema = StructType([StructField("t", StringType()), StructField("u", StringType())])
    rows = [("a\nb", "c"), ("plain", 'q"x'), ("x\n\ny,z", "w")]
    export_csv(spark.createDataFrame(rows, schema), f"{scratch}/o", header=True)
    good, bad = import_csv(spark, f"{scratch}/o", schema, header=True, multiline=True)
    assert bad.count() == 0 and sorted(map(tuple, good.collect())) == sorted(rows)
    good, _ = import_csv(spark, f"{scratch}/o", schema, header=True, multiline=True, skiprows=1, maxrows=1)
    assert good.count() == 1


def test_columns_with_dots(spark, scratch):
    schema = StructType([StructField("PM2.5", DoubleType()), StructField("n", LongType())])
    df = spark.createDataFrame([(1.5, 1), (None, 2)], schema)
    export_csv(df, f"{scratch}/o")
    good, _ = import_csv(spark, f"{scratch}/o", schema)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_lines_are_parsed_and_converted_once(spark, scratch):
    """Neither the fields nor the filter on the reason copy the parse or a conversion."""
    lines = ["1.5,2024-01-01 00:00:00+0000", "x,2024-01-01 00:00:00+0000", "2,3,4"]
    with open(f"{scratch}/f.csv", "w") as f:
        f.write("\n".join(lines))
    schema = StructType([StructField("v", DoubleType()), StructField("t", TimestampType())])
    good, bad = import_csv(spark, f"{scratch}/f.csv", schema)
    for side in (good, bad):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == plan.count("gettimestamp(") == plan.count("cast(trim(") == 1, plan
    assert [r.v for r in good.collect()] == [1.5]
    assert sorted(r.reason for r in bad.collect()) == ["bad_value:v", "malformed_line"]
