"""CSV records over several lines, cut into many splits, against Python's reader."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sensorlake.sources.csv import import_csv
from sensorlake.sources.multiline import ends_inside

SCHEMA = StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("c", StringType())])
BITS = ["x", "word", ",", '"', "\n", "\n\n", " ", "é", ";", "a,b\nc", '""', "\n,\n", '",', ',"']


@pytest.fixture()
def tiny_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for n, v in zip(names, (size, 0, 1), strict=True):
            spark.conf.set(n, str(v))

    yield cut
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def some_rows(seed, n=60):
    rng = random.Random(seed)
    return [[str(i), "".join(rng.choices(BITS, k=rng.randrange(1, 7))), "".join(rng.choices(BITS, k=rng.randrange(1, 4))) + "."] for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("seed,size", [(0, 16), (1, 40), (2, 90), (3, 300), (4, 10**9)])
def test_every_split_size_gives_the_same_rows(spark, scratch, tiny_splits, seed, size):
    rows = some_rows(seed)
    for name in ("one", "two"):
        with open(f"{scratch}/{name} f.csv", "w", newline="", encoding="utf-8") as f:
            f.write(written([["h1", "h\n2", "h3"], *rows]) if name == "one" else written([["h1", "h2", "h3"], *[[str(int(r[0]) + 1000), *r[1:]] for r in rows]]))
    tiny_splits(size)
    good, bad = import_csv(spark, scratch, SCHEMA, escape='"', header=True, multiline=True)
    assert bad.collect() == []
    assert rows_of(good) == [tuple(r) for r in rows] + [(str(int(r[0]) + 1000), *r[1:]) for r in rows]


def test_same_as_one_task_with_other_escapes_and_line_ends(spark, scratch, tiny_splits):
    lines = ['1,"a \\"q\\"\r\n, b",x', '2,mid"quote,y', '3,"back\\\\",z', "", '4,"two\r\n\r\n\r\nbreaks",""', '5,"closed" rest,w', '6,plain,"last\r\n"']
    with open(f"{scratch}/f.csv", "w", newline="", encoding="utf-8") as f:
        f.write("\r\n".join(lines) + "\r\n")
    text = StructType([*SCHEMA.fields, StructField("_corrupt", StringType())])
    one = spark.read.schema(text).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("escape", "\\").csv(scratch)
    wanted = rows_of(one.drop("_corrupt"))
    assert len(wanted) == 6
    for size in (10, 25, 10**9):
        tiny_splits(size)
        good, _ = import_csv(spark, scratch, SCHEMA, multiline=True)
        assert rows_of(good) == wanted


def test_bad_records_come_back_as_they_stand(spark, scratch, tiny_splits):
    with open(f"{scratch}/f.csv", "w", newline="", encoding="utf-8") as f:
        f.write('1,"a\nb",2\n"x\n\ny","too\nfew"\n3,"not\n,a number",x\n')
    schema = StructType([StructField("a", LongType()), StructField("b", StringType()), StructField("c", LongType())])
    tiny_splits(5)
    good, bad = import_csv(spark, scratch, schema, multiline=True)
    assert [tuple(r) for r in good.collect()] == [(1, "a\nb", 2)]
    assert {(r.line, r.reason) for r in bad.collect()} == {
        ('"x\n\ny","too\nfew"', "malformed_line"), ('3,"not\n,a number",x', "bad_value:c"),
    }


@pytest.mark.parametrize("skip,most", [(0, 7), (13, 20), (55, 10), (3, -1)])
def test_row_ranges(spark, scratch, tiny_splits, skip, most):
    rows = some_rows(9)
    for k in range(3):
        with open(f"{scratch}/{k} [x].csv", "w", newline="", encoding="latin-1") as f:
            f.write(written([["a", "b", "c"], *rows[20 * k : 20 * k + 20]]))
    tiny_splits(50)
    good, _ = import_csv(
        spark, scratch, SCHEMA, escape='"', header=True, multiline=True, skiprows=skip, maxrows=most, encoding="latin1"
    )
    assert rows_of(good) == [tuple(r) for r in rows[skip : skip + most if most >= 0 else None]]


def test_quotes_of_a_line(spark):
    cases = [
        ("", False, True), ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('a,"', True, False), ('"a"', False, False),
        ('""', False, True), ('","', False, True), ('a""b', False, True), ('"a""', True, False),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = df.select("t", *[ends_inside(F.col("t"), i, ",", '"', '"').alias(f"i{i:d}") for i in (False, True)]).collect()
    assert [tuple(r) for r in got] == cases
