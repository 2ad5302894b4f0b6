"""The dashboard and quality queries: results, order, and physical plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import physical
from millrace import plans
from millrace.functions import json_value
from millrace.schemas import EVENTS_RAW
from millrace.sinks import write_events
from workload import messages as M

TODAY = dt.date(2024, 1, 30)


def table(spark, rows):
    """Rows of (id, type, user, payload, processed_at, version)."""
    full = [(i, t, u, p, at, at.date(), v) for i, t, u, p, at, v in rows]
    return spark.createDataFrame(full, EVENTS_RAW)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, 30)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("1", "click", "u1", "{}", at(30, 1), "1.0.0"),
        ("2", "click", "u1", "{}", at(30, 1), "1.1.0"),
        ("3", "error", "u2", '{"error_code":"500"}', at(30, 1), "1.0.0"),
        ("4", "error", None, '{"error_code":404}', at(30, 2), "1.0.0"),
        ("5", "error", "u2", '{"error_code":"404"}', at(30, 3), "1.0.0"),
        ("6", "error", "u2", '{"error_code":{"a":1}}', at(30, 3), "1.0.0"),
        ("7", "purchase", "u3", '{"amount_usd":10.005}', at(29, 5), "1.0.0"),
        ("8", "purchase", "u3", '{"amount_usd":"0.1"}', at(29, 5), "1.0.0"),
        ("9", "purchase", "u4", '{"amount_usd":null}', at(28, 5), "1.0.0"),
        ("10", "click", "u4", "{}", at(20, 5), "1.0.0"),
    ]
    return table(spark, rows)


def test_hourly_volume(events):
    got = [tuple(r) for r in plans.hourly_volume(events, TODAY).collect()]
    hour = lambda d, h: dt.datetime(2024, 1, d, h)
    assert got == [
        (hour(30, 3), "error", 2), (hour(30, 2), "error", 1),
        (hour(30, 1), "click", 2), (hour(30, 1), "error", 1), (hour(29, 5), "purchase", 2),
    ]


def test_daily_active_users(events):
    got = [tuple(r) for r in plans.daily_active_users(events, TODAY).collect()]
    assert got == [(dt.date(2024, 1, 30), 2), (dt.date(2024, 1, 29), 1), (dt.date(2024, 1, 28), 1)]


def test_purchase_revenue(events):
    got = [tuple(r) for r in plans.purchase_revenue(events, TODAY).collect()]
    # Rounded once, after summing; a day without amounts has no revenue.
    assert got == [(dt.date(2024, 1, 29), 2, 10.11), (dt.date(2024, 1, 28), 1, None)]


def test_an_amount_that_is_no_number(spark):
    rows = [("1", "purchase", "u", f'{{"amount_usd":{v}}}', at(30), "1") for v in ('"free"', "2")]
    events = table(spark, rows)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        plans.purchase_revenue(events, TODAY).collect()
    assert plans.purchase_revenue(events, TODAY, lenient=True).first().revenue_usd == 2.0


def test_ingest_health(events):
    got = {tuple(r) for r in plans.ingest_health(events, TODAY).collect()}
    assert got == {
        (dt.date(2024, 1, 30), "1.0.0", 5), (dt.date(2024, 1, 30), "1.1.0", 1),
        (dt.date(2024, 1, 29), "1.0.0", 2), (dt.date(2024, 1, 28), "1.0.0", 1),
    }


def test_top_error_codes(events):
    got = [tuple(r) for r in plans.top_error_codes(events, TODAY).collect()]
    assert got == [("404", 2), (None, 1), ("500", 1)]
    assert len(plans.top_error_codes(events, TODAY, top=1).collect()) == 1


def test_type_counts(events):
    assert [tuple(r) for r in plans.type_counts(events, TODAY).collect()] == [("error", 4), ("click", 2)]


def test_today_is_the_default(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    events = table(spark, [("1", "click", "u", "{}", now, "1")])
    assert plans.type_counts(events).count() == 1
    assert plans.hourly_volume(events).count() == 1


def test_json_value_returns_scalars_only(spark):
    text = '{"s":"x","b":"[x]","n":1.5,"t":true,"z":null,"o":{"a":1},"l":[1]}'
    row = spark.createDataFrame([(text,)], "p string").select(
        *[json_value("p", f"$.{k}").alias(k) for k in "sbntzol"], json_value("p", "$.q").alias("q"),
        json_value("p", "$.o.a").alias("oa"),
    ).first()
    assert row.asDict() == {"s": "x", "b": "[x]", "n": "1.5", "t": "true", "z": None,
                            "o": None, "l": None, "q": None, "oa": "1"}


def test_quality_check_passes_on_one_good_row(spark, events):
    assert plans.quality_check(events, TODAY).first().ok is True
    assert plans.quality_check(events, dt.date(2024, 1, 1)).first().ok is False


def loose(spark, rows):
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENTS_RAW.fields)
    return spark.createDataFrame(rows, types)


def test_quality_report_sees_null_ids(spark, events):
    assert plans.quality_report(events, TODAY).first().asDict() == {
        "row_count": 6, "null_event_ids": 0, "null_event_types": 0, "passed": True}
    bad = loose(spark, [(None, "click", None, "{}", at(30), TODAY, "1"),
                        ("a", "click", None, "{}", at(30), TODAY, "1")])
    row = plans.quality_report(bad, TODAY).first()
    assert (row.null_event_ids, row.passed) == (1, False)
    assert plans.quality_check(bad, TODAY).first().ok is True
    assert plans.quality_report(bad, dt.date(2024, 1, 1)).first().passed is False


def test_partition_ready(events):
    assert plans.partition_ready(events, TODAY).first().ready is True
    assert plans.partition_ready(events, dt.date(2024, 1, 31)).first().ready is False


def test_missing_days(events):
    got = [tuple(r) for r in plans.missing_days(events, dt.date(2024, 1, 31), days=3).collect()]
    assert got == [
        (dt.date(2024, 1, 31), 0, True), (dt.date(2024, 1, 30), 6, False),
        (dt.date(2024, 1, 29), 2, False), (dt.date(2024, 1, 28), 1, False),
    ]


def test_require(spark, events):
    plans.require(plans.quality_check(events, TODAY), "no events")
    plans.require(plans.quality_report(events, TODAY), "bad events")
    with pytest.raises(Exception, match="no events today"):
        plans.require(plans.quality_check(events, dt.date(2024, 1, 1)), "no events today")


AGGREGATES = {
    "q1": lambda e: plans.hourly_volume(e, TODAY),
    "q2": lambda e: plans.daily_active_users(e, TODAY),
    "q3": lambda e: plans.purchase_revenue(e, TODAY),
    "q4": lambda e: plans.ingest_health(e, TODAY),
    "q5": lambda e: plans.top_error_codes(e, TODAY),
    "q6": lambda e: plans.type_counts(e, TODAY),
    "missing": lambda e: plans.missing_days(e, TODAY),
}


@pytest.mark.parametrize("name", AGGREGATES)
def test_messages_are_parsed_once_and_counted_before_the_shuffle(spark, sf_dir, name):
    plan = physical(AGGREGATES[name](M.enriched(spark, sf_dir)))
    assert plan.count("parseJson(concat(") == plan.count("FileScan") == 1
    assert "HashAggregate" in plan.split("Exchange hashpartitioning")[-1]
    assert "Join" not in plan
    # The date bound reaches the scan, also through the round-robin exchange.
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_amounts_beyond_the_decimal(spark):
    amounts = ["1e18", "-0.000000000001", "0.123456789012", "12345678901234.5", "1e-20", '"2.50"']
    rows = [("1", "purchase", "u", f'{{"amount_usd":{v}}}', at(30), "1") for v in amounts]
    row = plans.purchase_revenue(table(spark, rows), TODAY).first()
    assert row.purchase_count == 6
    assert row.revenue_usd == pytest.approx(1e18 + 12345678901234.5 + 2.62, rel=1e-15)
    tiny = [("1", "purchase", "u", f'{{"amount_usd":{v}}}', at(30), "1") for v in ["0.004999999999"] * 2]
    assert plans.purchase_revenue(table(spark, tiny), TODAY).first().revenue_usd == 0.01
    huge = [("1", "purchase", "u", '{"amount_usd":9999999999.999999999999}', at(30), "1")] * 1000
    assert plans.purchase_revenue(table(spark, huge), TODAY).first().revenue_usd == 1e13


def test_a_query_over_the_table_lists_only_its_days(spark, events, tmp_path):
    root = str(tmp_path / "events")
    write_events(events, root, "b")
    for plan, days in ((plans.top_error_codes, 0), (plans.type_counts, 0), (plans.quality_check, 0),
                       (plans.hourly_volume, 1), (plans.daily_active_users, 7)):
        rows = plans.over_table(plan, spark, root, TODAY)
        listed = {f.split("ingest_date=")[1][:10] for f in rows.inputFiles()}
        assert listed == {str(TODAY - dt.timedelta(days=d)) for d in range(days + 1)} & {
            "2024-01-30", "2024-01-29", "2024-01-28", "2024-01-20"}
        assert sorted(map(str, rows.collect())) == sorted(map(str, plan(events, TODAY).collect()))
    assert plans.over_table(plans.ingest_health, spark, root, TODAY, days=1).count() == 3
    assert plans.over_table(plans.type_counts, spark, root).count() == 0


def test_top_k_is_not_a_global_sort(events):
    assert "TakeOrderedAndProject" in physical(plans.top_error_codes(events, TODAY))


def test_unused_payload_is_not_built(spark, sf_dir):
    assert "StructsToJson" not in physical(plans.hourly_volume(M.enriched(spark, sf_dir), TODAY)).split("Generate")[0]


def test_no_python_in_any_plan(spark, sf_dir):
    rows = M.enriched(spark, sf_dir).withColumn("code", json_value("payload", "$.error_code"))
    plan = physical(rows.where(F.col("code").isNotNull()))
    assert "Python" not in plan and "Arrow" not in plan
