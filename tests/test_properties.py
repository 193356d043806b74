"""Property checks with generated inputs (many values per DataFrame to keep Spark
overhead per example low)."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorlake.functions import clamp, format_bool, format_number, parse_bool, parse_number
from sensorlake.operators.report import page

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

finite = st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False)
two_places = st.integers(min_value=-10**11, max_value=10**11).map(lambda n: n / 100)


@SETTINGS
@given(st.lists(two_places, min_size=1, max_size=200), st.sampled_from([(".", ""), (",", "."), (".", ","), (",", " ")]))
def test_format_then_parse_is_identity_for_two_place_numbers(spark, values, seps):
    dec, thou = seps
    df = spark.createDataFrame([(v,) for v in values], "v double")
    back = df.select("v", parse_number(format_number("v", 2, dec, thou), dec, thou).alias("w")).collect()
    assert all(r.v == r.w for r in back), [(r.v, r.w) for r in back if r.v != r.w][:3]


@SETTINGS
@given(st.lists(st.one_of(st.none(), finite), min_size=1, max_size=200), finite, finite)
def test_clamp_is_idempotent_and_bounded(spark, values, a, b):
    lo, hi = min(a, b), max(a, b)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", clamp("v", lo, hi).alias("c"), clamp(clamp("v", lo, hi), lo, hi).alias("cc")).collect()
    for r in rows:
        assert r.c == r.cc
        assert (r.v is None) == (r.c is None)
        if r.c is not None:
            assert lo <= r.c <= hi


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.booleans()), min_size=1, max_size=50), st.sampled_from(["True,False", "yes,no", "1,0", "Y,N"]))
def test_bool_style_round_trip(spark, values, style):
    df = spark.createDataFrame([(v,) for v in values], "b boolean")
    rows = df.select("b", parse_bool(format_bool("b", style), style).alias("back")).collect()
    assert all(r.b == r.back for r in rows)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 10**6)), min_size=1, max_size=300, unique=True), st.integers(1, 50))
def test_keyset_pages_concatenate_to_the_sorted_input(spark, rows, size):
    df = spark.createDataFrame(rows, "a int, b long")
    got, after = [], None
    while True:
        chunk = page(df, ["a", "b"], size=size, after=after).collect()
        if not chunk:
            break
        got += [(r.a, r.b) for r in chunk]
        after = (chunk[-1].a, chunk[-1].b)
    assert got == sorted(rows)
