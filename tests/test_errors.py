"""error_summary against a brute-force computation: several reasons, ties, NULLs."""

from __future__ import annotations

import random

import pytest

from sensorlake.operators.errors import error_summary


@pytest.mark.parametrize("orders", [1000, 7])  # distinct orders, and many ties
def test_error_summary_matches_brute_force(spark, orders):
    rnd = random.Random(11)
    reasons = ["null_body"] * 3 + ["malformed_json"] * 500 + ["bad_timestamp"] * 40 + ["rare"] + [None] * 4
    rows = [
        (None if rnd.random() < 0.05 else i % orders, r, f"body{i}")
        for i, r in enumerate(rnd.sample(reasons, len(reasons)))
    ]
    df = spark.createDataFrame(rows, "offset long, reason string, body string")
    got = {r.reason: r for r in error_summary(df, n_samples=3).collect()}
    assert set(got) == set(reasons)
    for reason, g in got.items():
        mine = sorted(((o, b) for o, r, b in rows if r == reason), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        assert g.errors == len(mine)
        assert g.suppressed == max(len(mine) - 3, 0)
        samples = [(g[f"sample_{i}_order"], g[f"sample_{i}"]) for i in (1, 2, 3)]
        assert samples == mine[:3] + [(None, None)] * (3 - len(mine[:3])), reason


def test_equal_errors_all_count_as_samples(spark):
    df = spark.createDataFrame([(5, "r", "b")] * 3, "offset long, reason string, body string")
    r = error_summary(df, n_samples=2).first()
    assert (r.errors, r.sample_1, r.sample_2, r.suppressed) == (3, "b", "b", 1)
