"""One test for each edge of the surveillance analytics, on rows written out here."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from cedarledger.operators import analytics as A

ONE = "property_name string, property_type_code string, state string, at_securitization struct<valuation_amount:decimal(20,8),physical_occupancy_percentage:decimal(20,8)>, most_recent struct<net_operating_income_amount:decimal(20,8)>"
SCHEMA = f"""cik string, doc_position int, asset_number string, period_ending_date date, paid_through_date date, original_loan_amount decimal(20,8), actual_balance_amount decimal(20,8),
scheduled_balance_amount decimal(20,8), payment_status_code string, properties array<struct<{ONE.replace(' string', ':string').replace(' struct', ':struct')}>>, raw_fields map<string,string>"""
D = Decimal


def loan(
    asset, status="0", actual="100", scheduled="100", properties=(), raw=None, end=dt.date(2026, 5, 31), paid=None,
    original="200", cik="1"
):
    n = lambda x: None if x is None else D(x)
    props = [
        (
            p[0], p[1] if len(p) > 1 else None, p[2] if len(p) > 2 else None, None, None if len(p) < 4 else (n(p[3]),)
        ) for p in properties
    ]
    return [cik, 0, asset, end, paid, n(original), n(actual), n(scheduled), status, props, raw or {}]


def frame(spark, loans):
    for i, x in enumerate(loans):
        x[1] = i
    return spark.createDataFrame([tuple(x) for x in loans], SCHEMA)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_summary(spark):
    s = A.paydown(
        A.deal_summary(
            frame(spark, [loan("1", properties=[("a",), ("b",)]), loan("2", actual=None, end=dt.date(2020, 1, 1))])
        )
    ).first()
    assert (
        s["loan_count"], s["property_count"], s["total_actual_balance_amount"], s["reporting_period_ending_date"],
        s["paydown_percentage"]
    ) == (2, 2, D(100), dt.date(2026, 5, 31), 75.0)


def test_summary_of_nothing(spark):
    s = A.paydown(A.deal_summary(frame(spark, []), by=())).first()
    assert (
        s["loan_count"], s["property_count"], s["total_actual_balance_amount"], s["reporting_period_ending_date"],
        s["paydown_percentage"]
    ) == (0, 0, 0, None, None)


@pytest.mark.parametrize(
    "before,after,severity",
    [("0", "B", 2), ("B", "0", 0), ("A", "B", 1), (None, "B", 1), ("0", None, 2), (None, "0", 0)]
)
def test_severity(spark, before, after, severity):
    assert rows(
        A.status_changes(frame(spark, [loan("7", before)]), frame(spark, [loan("7", after)])), "status_before",
        "status_after", "severity_rank"
    ) == [(before, after, severity)]


def test_unchanged_status_is_left_out(spark):
    assert rows(
        A.status_changes(
            frame(spark, [loan("1", None), loan("2", "B")]), frame(spark, [loan("1", None), loan("2", "B")])
        ),
        "asset_number"
    ) == []


def test_status_ranks_by_severity_then_asset_as_text(spark):
    a = [loan(x, s) for x, s in (("4", "B"), ("16", "B"), ("39", "0"), ("100", "A"), ("gone", "0"))]
    b = [loan(x, s) for x, s in (("4", "0"), ("16", "0"), ("39", "B"), ("100", "B"), ("new", "B"))]
    assert rows(
        A.status_changes(frame(spark, a), frame(spark, b)).orderBy("rank"), "asset_number"
    ) == [("39",), ("100",), ("16",), ("4",)]


def test_no_earlier_period_gives_nothing(spark):
    assert A.status_changes(frame(spark, []), frame(spark, [loan("1", "B")])).count() == 0


def test_repeated_loans(spark):
    a = frame(spark, [loan("1", "0"), loan("1", "A")])
    b = frame(spark, [loan("1", "B"), loan("1", "C")])
    assert sorted(rows(A.status_changes(a, b), "status_before", "status_after")) == [("A", "B"), ("A", "C")]


def test_comparison_has_five_fields_in_order(spark):
    k = A.ADVANCES
    a = loan("1", "0", "10", "10", raw={k: "0"}, paid=dt.date(2026, 1, 1))
    b = loan("1", "B", "11", None, raw={k: "44695.31"}, paid=dt.date(2026, 2, 1))
    got = rows(
        A.compare_periods(frame(spark, [a]), frame(spark, [b])).orderBy("field_order"), "field_name", "value_before",
        "value_after"
    )
    assert [g[0] for g in got] == [f for f, _ in A.tracked_fields()]
    assert got[2] == (
        "reportPeriodEndScheduledLoanBalanceAmount", "10.00000000", None
    ) and got[4][1:] == ("0.00000000", "44695.31000000")


def test_scale_is_no_change(spark):
    a, b = loan("1", actual="1.0", raw={A.ADVANCES: "5"}), loan("1", actual="1.00", raw={A.ADVANCES: "5.00"})
    assert A.compare_periods(frame(spark, [a]), frame(spark, [b])).count() == 0


def test_unreadable_advances_are_unknown(spark):
    assert A.compare_periods(frame(spark, [loan("1", raw={A.ADVANCES: "n/a"})]), frame(spark, [loan("1")])).count() == 0


def test_drift(spark):
    d = A.balance_drift(
        frame(
            spark,
            [
                loan("1", actual="90"), loan("2", actual="110"), loan("10", actual="5", scheduled="0"), loan("3"),
                loan("4", actual=None), loan("5", scheduled=None)
            ]
        )
    )
    assert rows(d.orderBy("rank"), "asset_number", "drift_amount", "drift_percentage") == [
        ("1", D(-10), -10.0), ("2", D(10), 10.0), ("10", D(5), None), ("3", D(0), 0.0)
    ]
    assert rows(A.movers(d, 2), "asset_number") == [("1",), ("2",)]


def test_history_puts_unknown_dates_first(spark):
    h = A.loan_history(
        frame(
            spark,
            [
                loan("1", actual="10", end=dt.date(2026, 7, 1)), loan("1", actual="30", end=None),
                loan("1", actual="20", end=dt.date(2026, 5, 1)), loan("2")
            ]
        )
    )
    assert rows(
        h.filter("asset_number = '1'").orderBy("entry"), "actual_balance_amount", "balance_step"
    ) == [(D(30), None), (D(20), D(-10)), (D(10), D(-10))]


def test_profile_takes_the_first_of_a_name(spark):
    p = frame(spark, [loan("1", properties=[("x", "OF"), ("x", "RT"), ("y", "MF")])])
    assert rows(A.property_profiles(p, asset_number="1", property_name="x"), "property_type_code") == [("OF",)]
    assert A.property_profiles(p, asset_number="9", property_name="x").count() == A.property_profiles(p, asset_number="1", property_name="z").count() == 0


def test_income_changes(spark):
    a = frame(
        spark,
        [
            loan(
                "1",
                properties=[
                    ("drop", "", "", "50"), ("gone", "", "", "9"), ("first", "", ""), ("same", "", "", "1"),
                    ("rise", "", "", "1"), ("dup", "", "", "1"), ("dup", "", "", "7"), ("silent", "", "")
                ]
            )
        ]
    )
    b = frame(
        spark,
        [
            loan(
                "1",
                properties=[
                    ("rise", "", "", "4"), ("drop", "", "", "20"), ("gone", "", ""), ("first", "", "", "3"),
                    ("same", "", "", "1.0"), ("dup", "", "", "8"), ("new", "", "", "5"), ("silent", "", "")
                ]
            )
        ]
    )
    assert rows(
        A.noi_changes(a, b).orderBy("rank"), "property_name", "noi_change"
    ) == [("drop", D(-30)), ("dup", D(1)), ("rise", D(3))]
    s = A.noi_summary(a, b).first()
    assert (s["entries"], s["excluded_first_report_count"], s["reason"]) == (3, 1, None)


def test_no_income_change_has_a_reason(spark):
    a, b = frame(spark, [loan("1", properties=[("p", "", "")])]), frame(
        spark, [loan("1", properties=[("p", "", "", "5")])]
    )
    s = A.noi_summary(a, b).first()
    assert (
        s["entries"], s["excluded_first_report_count"]
    ) == (0, 1) and "genuine NOI change" in s["reason"] and A.noi_changes(a, b).count() == 0


def test_distributions_count_missing_codes(spark):
    p = frame(
        spark,
        [
            loan(
                "1",
                properties=[("a", "SS", "NY"), ("b", "SS", None), ("c", "", "CA"), ("d", "CH", "NY"), ("e", None, "CA")]
            )
        ]
    )
    assert rows(
        A.property_types(p).orderBy("rank"), "code", "property_count", "total_property_count", "missing_count"
    ) == [("SS", 2, 5, 2), ("CH", 1, 5, 2)]
    assert rows(A.geography(p).orderBy("rank"), "code", "property_percentage") == [("CA", 40.0), ("NY", 40.0)]
    assert A.property_types(frame(spark, [])).count() == 0


def test_deals_stay_apart(spark):
    a, b = frame(spark, [loan("1", "0", cik="x"), loan("1", "A", cik="y")]), frame(
        spark, [loan("1", "B", cik="x"), loan("1", "0", cik="y")]
    )
    assert sorted(rows(A.status_changes(a, b), "cik", "severity_rank", "rank")) == [("x", 2, 1), ("y", 0, 1)]


def test_random_snapshots_against_plain_python(spark):
    r = random.Random(1)
    make = lambda: [
        loan(
            str(r.randrange(30)), r.choice(["0", "A", "B", None]), r.choice([None, str(r.randrange(50))]),
            r.choice([None, "0", str(r.randrange(50))])
        ) for _ in range(60)
    ]
    a, b = make(), make()
    last = {x[2]: x for x in a}
    grade = lambda p, q: 2 if p == "0" and q != "0" else 0 if q == "0" else 1
    want = [
        (x[2], last[x[2]][8], x[8], grade(last[x[2]][8], x[8])) for x in b if x[2] in last and last[x[2]][8] != x[8]
    ]
    assert sorted(
        rows(
            A.status_changes(frame(spark, a), frame(spark, b)), "asset_number", "status_before", "status_after",
            "severity_rank"
        ),
        key=str
    ) == sorted(want, key=str)
    drift = sorted(
        ((x[2], x[6] - x[7]) for x in b if x[6] is not None and x[7] is not None), key=lambda d: (-abs(d[1]), d[0])
    )
    assert rows(A.balance_drift(frame(spark, b)).orderBy("rank"), "asset_number", "drift_amount") == drift
