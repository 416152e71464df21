"""Report calculations, worked by hand: exact decimals, half up, and what counts as an error."""

from decimal import Decimal as D

from quillspan.operators import compare

RECORD = "metric_id string, period string, geography string, value decimal(20,0)"
SHARE = "part string, period string, value decimal(18,2)"


def test_percent_is_exact_and_half_up(spark):
    data = [
        ("a", "1", "x", 1_000_000), ("a", "2", "x", 1_050_500),  # 5.05 is a tie
        ("b", "1", "x", 1_000_000), ("b", "2", "x", 949_500),  # so is -5.05
        ("c", "1", "x", 30_000_000_000_000_000), ("c", "2", "x", 30_000_000_000_000_001),
        ("d", "1", "x", 1), ("d", "1", "x", 1), ("d", "2", "x", 5),
        ("e", "1", "x", 0), ("e", "2", "x", 5),
        ("f", "2", "x", 5),
        ("g", "1", "x", 5), ("g", "2", "x", None),
    ]
    got = {r.metric_id: (r.delta, r.percent, r.error) for r in compare.pct_change_report(spark.createDataFrame([(*r[:3], None if r[3] is None else D(r[3])) for r in data], RECORD), "1", "2").collect()}
    assert got == {
        "a": (50_500, D("5.1"), None),
        "b": (-50_500, D("-5.1"), None),
        "c": (1, D("0.0"), None),
        "d": (None, None, "NOT_EXACTLY_ONE_RECORD"),
        "e": (5, None, "ZERO_BASELINE"),
        "f": (None, None, "NOT_EXACTLY_ONE_RECORD"),
        "g": (None, None, "MISSING_VALUE"),
    }


def test_points_come_from_unrounded_shares(spark):
    parts = spark.createDataFrame([("t", "1", D("10.005")), ("t", "2", D("10.014")), ("u", "1", D("1"))], SHARE.replace("18,2", "18,3"))
    wholes = spark.createDataFrame([("1", D("100")), ("2", D("100"))], "period string, value decimal(18,2)")
    got = {r.part: (r.share_before, r.share_after, r.points) for r in compare.concentration_share(parts, wholes, "1", "2").collect()}
    assert got == {"t": (D("10.01"), D("10.01"), D("0.01")), "u": (D("1.00"), None, None)}  # not 10.01 - 10.01
