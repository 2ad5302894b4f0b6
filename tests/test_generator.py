import json
import uuid

from pyspark.sql import functions as F

from millrace.operators import accepted, parse_events, validate_events
from millrace.sources import (
    generate_envelopes,
    generate_events,
    read_envelopes,
    start_publishing,
)
from millrace.sources.generator import ERROR_CODES, EVENT_TYPES, PAGES



def clock():
    return F.lit("2024-01-15 12:00:00.5").cast("timestamp")
FIELDS = {
    "page_view": {"page", "referrer"},
    "purchase": {"amount_usd", "product_id"},
    "error": {"error_code"},
}


def bodies(envelopes):
    return [json.loads(bytes(r.value)) for r in envelopes.select("value").collect()]


def test_same_seed_same_events_whatever_the_partitions(spark):
    one = generate_events(spark.range(300, numPartitions=1), seed=5, clock=clock())
    many = generate_events(spark.range(300, numPartitions=7), seed=5, clock=clock())
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    other = generate_events(spark.range(300), seed=6, clock=clock())
    assert one.select("event_id").intersect(other.select("event_id")).count() == 0


def test_fields_per_type(spark):
    seen = set()
    for event in bodies(generate_envelopes(spark.range(2000), clock=clock())):
        kind = event["event_type"]
        seen.add(kind)
        base = {"event_id", "event_type", "user_id", "timestamp"}
        assert set(event) == base | FIELDS.get(kind, set())
        assert uuid.UUID(event["event_id"]).version == 4
        assert str(uuid.UUID(event["event_id"])) == event["event_id"]
        assert 1000 <= int(event["user_id"].removeprefix("user_")) <= 9999
        assert event["timestamp"] == "2024-01-15T12:00:00.500000+00:00"
        if kind == "page_view":
            assert event["page"] in PAGES
        if kind == "purchase":
            assert 10 <= event["amount_usd"] <= 500
            assert round(event["amount_usd"], 2) == event["amount_usd"]
            assert 100 <= int(event["product_id"].removeprefix("prod_")) <= 999
        if kind == "error":
            assert event["error_code"] in ERROR_CODES
    assert seen == set(EVENT_TYPES)


def test_types_are_uniform(spark):
    counts = generate_events(spark.range(60000)).groupBy("event_type").count().collect()
    assert len(counts) == 6 and all(9500 < r["count"] < 10500 for r in counts)


def test_ids_are_unique(spark):
    rows = generate_events(spark.range(20000))
    assert rows.select("event_id").distinct().count() == 20000


def test_type_can_be_fixed(spark):
    rows = generate_envelopes(spark.range(50), event_type="error")
    assert {e["event_type"] for e in bodies(rows)} == {"error"}
    assert {r.attributes["event_type"] for r in rows.collect()} == {"error"}


def test_generated_messages_pass(spark):
    rows = generate_envelopes(spark.range(500))
    assert accepted(validate_events(parse_events(rows))).count() == 500


def test_publishing_at_a_steady_rate(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    query = start_publishing(spark, src, cp, per_second=50)
    query.awaitTermination(8)
    query.stop()
    sent = read_envelopes(spark, src)
    assert sent.count() >= 50
    assert sent.select("message_id").distinct().count() == sent.count()
    assert accepted(validate_events(parse_events(sent))).count() == sent.count()
