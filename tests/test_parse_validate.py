"""What a message must look like, case by case."""

import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import (
    accepted,
    dead_letters,
    enrich_events,
    parse_events,
    redrive,
    reject_summary,
    validate_events,
)

GOOD = '{"event_id":"a","event_type":"click"}'


def outcome(spark, envelopes):
    rows = validate_events(parse_events(envelopes)).orderBy(F.col("message_id").cast("int")).collect()
    return [(r.reason, r.event_id, r.event_type, r.user_id) for r in rows]


def with_id(value):
    return f'{{"event_id":{value},"event_type":"click"}}'


def with_type(value):
    return f'{{"event_id":"a","event_type":{value}}}'


CASES = [
    # body, reason, id
    (GOOD, None, "a"),
    (f" \t\r\n{GOOD}\n ", None, "a"),
    ("{bad", "malformed", None),
    ("", "malformed", None),
    ("   ", "malformed", None),
    (None, "malformed", None),
    (GOOD + " xyz", "malformed", None),
    (GOOD + "]", "malformed", None),
    (GOOD + "}", "malformed", None),
    (GOOD + "],[" + GOOD, "malformed", None),
    (GOOD + "," + GOOD, "malformed", None),
    (GOOD + GOOD, "malformed", None),
    (GOOD + ',"x"]', "malformed", None),
    (GOOD + ',"' + "0" * 16 + '"]', "malformed", None),
    ("{'event_id':'a','event_type':'click'}", "malformed", None),
    ('{"event_id":"a","event_type":"click","n":01}', "malformed", None),
    ('{"event_id":"a","event_type":"click",}', "malformed", None),
    ('{"event_id":"a","event_type":"click","t":"x\ny"}', "malformed", None),
    ('{"event_id":"a","event_type":"click","v":NaN}', "malformed", None),
    ('﻿' + GOOD, "malformed", None),
    ('{"event_id":"a","event_id":"b","event_type":"click"}', None, "b"),
    (b"ok\xff\xe2\x82x", "bad_utf8", None),
    (b'{"event_id":"a","event_type":"click","x":"\xff"}', "bad_utf8", None),
    ('{"event_id":"a"}', "missing_required", None),
    ('{"event_type":"click"}', "missing_required", None),
    ("{}", "missing_required", None),
    ('{"o":{"event_id":"a","event_type":"click"}}', "missing_required", None),
    (with_id("null"), "bad_event_id", None),
    (with_id("0"), "bad_event_id", None),
    (with_id("-0"), "bad_event_id", None),
    (with_id("0.0"), "bad_event_id", None),
    (with_id("-0.00"), "bad_event_id", None),
    (with_id("0e7"), "bad_event_id", None),
    (with_id("false"), "bad_event_id", None),
    (with_id('""'), "bad_event_id", None),
    (with_id("[]"), "bad_event_id", None),
    (with_id("{}"), "bad_event_id", None),
    (with_id('["a"]'), "bad_event_id", None),
    (with_id('{"x":1}'), "bad_event_id", None),
    (with_id('"0"'), None, "0"),
    (with_id('"0.0"'), None, "0.0"),
    (with_id('"false"'), None, "false"),
    (with_id('"[]"'), None, "[]"),
    (with_id('"{a"'), None, "{a"),
    (with_id('" "'), None, " "),
    (with_id("5"), None, "5"),
    (with_id("0.5"), None, "0.5"),
    (with_id("true"), None, "true"),
    ("5", "not_an_object", None),
    ("null", "not_an_object", None),
    ('["event_id","event_type"]', "not_an_object", None),
    ('"event_id event_type"', "not_an_object", None),
    (with_type('"Click"'), "unknown_event_type", "a"),
    (with_type('""'), "unknown_event_type", "a"),
    (with_type("null"), "unknown_event_type", "a"),
    (with_type('["click"]'), "unknown_event_type", "a"),
    (with_type("7"), "unknown_event_type", "a"),
    # numbers and texts that the parser would alter
    (with_id("1" * 39), None, "1" * 39),
    (with_id("1" * 38), None, "1" * 38),
    (with_id("-" + "9" * 5000), None, "-" + "9" * 5000),
    (with_id("0." + "1" * 60), None, "0." + "1" * 60),
    (with_id("1e400"), None, "1e400"),
    (with_id("-1.50E+0400"), None, "-1.50E+0400"),
    (with_id("0" * 45), "malformed", None),
    (with_id("0." + "0" * 45), "bad_event_id", None),
    (with_id("0e400"), "bad_event_id", None),
    (with_id("1e-400"), "bad_event_id", None),
    (with_id('"1e400"'), None, "1e400"),
    (with_id('"' + "1" * 50 + '"'), None, "1" * 50),
    (with_id('"\\ud800"'), None, "\\ud800"),
    (with_id('"a\\\\ud800\\uDC00\\ud800b"'), None, "a\\ud800\\uDC00\\ud800b"),
    (with_id('"\\ud83d\\ude00\\ude00"'), None, "\U0001F600\\ude00"),
    (with_type("1e400"), "unknown_event_type", "a"),
    (with_type('"click\\ud800"'), "unknown_event_type", "a"),
    ('{"event_id":"a","event_type":"click","n":-' + "7" * 45 + "}", None, "a"),
    ('{"event_id":"a","event_type":"click","n":[1e400]}', None, "a"),
    ('{"event_id":"a","event_type":"click","n":-1E+0400}', None, "a"),
    ('{"event_id":"a","event_type":"click","n":"1e400"}', None, "a"),
    ('{"event_id":"a","event_type":"click","n":1e300}', None, "a"),
    ('{"event_id":"a","event_type":"click","n":0.' + "1" * 60 + "}", None, "a"),
    ('{"event_id":"a","event_type":"click","n":1' + "0" * 1100 + "}", None, "a"),
    ('{"event_id":"a","event_type":"click","t":"\\ud800"}', None, "a"),
    ('{"event_id":"a","event_type":"click","t":"\\uDC00x\\ud83d"}', None, "a"),
    ('{"event_id":"a","event_type":"click","t":"\\ud83d\\ude00"}', None, "a"),
    ('{"event_id":"a","event_type":"click","t":"\\\\ud800"}', None, "a"),
    ('{"event_id":"a","event_type":"click","user_id":' + "8" * 40 + "}", None, "a"),
    # and what is none of JSON stays so
    ('{"event_id":"a","event_type":"click","n":1e400 2}', "malformed", None),
    ('{"event_id":"a","event_type":"click",1e400:2}', "malformed", None),
    ('{"event_id":"a","event_type":"click",1e400 :2}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":+1e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":--1e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":1.e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":.5e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":01e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":1e400x}', "malformed", None),
    ('{"event_id":"a","event_type":"click","n":null1e400}', "malformed", None),
    ('{"event_id":"a","event_type":"click","t":\\ud800}', "malformed", None),
    ('{"event_id":"a","event_type":"click","t":"\\ud8"}', "malformed", None),
    ("1e400", "not_an_object", None),
    ("1" * 60 + " 1", "malformed", None),
    # the type is tested before the id
    ('{"event_id":"","event_type":"other"}', "unknown_event_type", None),
    ('{"event_id":"a","event_type":"click","user_id":["u"]}', "bad_user_id", "a"),
    ('{"event_id":"a","event_type":"click","user_id":"[u"}', None, "a"),
]


def test_every_case(spark, send):
    got = outcome(spark, send(*[c[0] for c in CASES]))
    for (body, reason, event_id), (found, found_id, _, _) in zip(CASES, got):
        assert found == reason, body
        if reason not in ("malformed", "bad_utf8", "not_an_object", "missing_required", "too_large"):
            assert found_id == event_id, body


def test_parser_agrees_with_a_strict_one(spark, send):
    """Joined fragments: accepted exactly when the standard library accepts."""
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', "1", " ", '{"a":1}', "null", '"', "\\"]
    bodies = [a + b + c for a in pieces for b in pieces for c in pieces]

    def strict(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    rows = parse_events(send(*bodies)).select("body", "parse_error").collect()
    assert len(rows) == len(bodies)
    for row in rows:
        assert (row.parse_error != "malformed") == strict(row.body), row.body


def test_valid_event_passes(spark, send):
    body = '{"event_id":"abc-123","event_type":"page_view","user_id":"u1"}'
    assert outcome(spark, send(body)) == [(None, "abc-123", "page_view", "u1")]


def test_unknown_type_is_turned_away(spark, send):
    rows = validate_events(parse_events(send('{"event_id":"xyz-999","event_type":"unknown_type"}')))
    assert accepted(rows).count() == 0


def test_empty_id_is_turned_away(spark, send):
    rows = validate_events(parse_events(send('{"event_id":"","event_type":"click"}')))
    assert accepted(rows).count() == 0


def test_types_are_a_parameter(spark, send):
    parsed = parse_events(send(with_type('"refund"'), GOOD, with_type("7"), with_type('"7"')))
    reasons = {r.message_id: r.reason for r in validate_events(parsed, ["refund", "7"]).collect()}
    assert reasons == {"0": None, "1": "unknown_event_type", "2": "unknown_event_type", "3": None}


def test_null_publish_time(spark, send):
    assert outcome(spark, send(GOOD, publish_time=None))[0][0] == "null_publish_time"


def test_user_is_optional_and_coerced(spark, send):
    body = '{"event_id":"a","event_type":"click","user_id":%s}'
    users = [r[3] for r in outcome(spark, send(GOOD, body % "null", body % "12", body % '"u"'))]
    assert users == [None, None, "12", "u"]


def test_dead_letters_keep_the_text(spark, send):
    bad = [b"ok\xff\xe2\x82x", "{bad", with_type('"x"')]
    letters = dead_letters(validate_events(parse_events(send(*bad, GOOD)))).collect()
    assert {(r.reason, r.raw) for r in letters} == {
        ("bad_utf8", bad[0].decode("utf-8", errors="replace")),
        ("malformed", "{bad"),
        ("unknown_event_type", with_type('"x"')),
    }
    assert all(r.error and r.publish_time for r in letters)


def test_reject_summary(spark, send):
    rows = reject_summary(validate_events(parse_events(send("{", "[", GOOD, "5")))).collect()
    assert {(r.reject_reason, r.reject_count) for r in rows} == {("malformed", 2), ("not_an_object", 1)}


def test_redrive(spark, send):
    letters = dead_letters(validate_events(parse_events(send('{"event_type":"click"}'))))
    as_is = validate_events(parse_events(redrive(letters))).first()
    assert as_is.reason == "missing_required"
    patched = F.regexp_replace("raw", r"^\{", '{"event_id":"new",')
    again = validate_events(parse_events(redrive(letters, patched))).first()
    assert (again.reason, again.event_id) == (None, "new")
    assert again.attributes == {"redriven_from": "missing_required"}


def test_whole_texts_are_parsed(spark, send):
    """A flaw after a megabyte is still found."""
    long = '{"event_id":"a","event_type":"click","t":"' + "x" * 1_000_000 + '"}'
    got = outcome(spark, send(long, long + "x"))
    assert [r[0] for r in got] == [None, "malformed"]


def test_a_body_beyond_the_parser_is_not_called_malformed(spark, send):
    body = '{"event_id":"a","event_type":"click","t":"' + "x" * (21 << 20) + '"}'
    assert outcome(spark, send(body))[0][0] == "too_large"


def test_the_missing_fields_are_named(spark, send):
    bodies = ['{"event_id":"a"}', '{"event_type":"click"}', "{}"]
    letters = dead_letters(validate_events(parse_events(send(*bodies)))).collect()
    assert {r.raw: r.error for r in letters} == {
        b: f"Missing required fields: {m}" for b, m in
        zip(bodies, ("event_type", "event_id", "event_id, event_type"))}


def test_an_unconfigured_session_is_refused(spark, send):
    rows = send(GOOD)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError, match="allowDuplicateKeys"):
            parse_events(rows)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


@pytest.mark.parametrize("depth,reason", [(100, None), (5000, "malformed")])
def test_nesting(spark, send, depth, reason):
    body = '{"event_id":"a","event_type":"click","n":' + "[" * depth + "]" * depth + "}"
    assert outcome(spark, send(body))[0][0] == reason


def test_payloads_keep_what_the_parser_would_alter(spark, send):
    values = ["-" + "7" * 45, "[1e400,{}]", "-1E+0400", "1e-400", "0." + "1" * 60, '"\\ud800"',
              '"1e400 \\uDC00x\\ud83d \\\\ud800 \\n"', '{"\\ud800":1e999,"x":["' + "1" * 45 + '"]}', "1" + "0" * 1100,
              '[' + "3" * 50 + ',"' + "3" * 50 + '",null,true,"a:1e400"]']
    bodies = ['{"event_id":"a%d","z":null,"event_type":"click","v":%s}' % (i, v) for i, v in enumerate(values)]
    rows = enrich_events(validate_events(parse_events(send(*bodies)))).collect()
    payloads = {int(r.event_id[1:]): r.payload for r in rows}
    for i, v in enumerate(values):
        assert payloads[i] == '{"v":' + v + ',"z":null}', v


def test_long_texts_with_many_escapes(spark, send):
    body = '{"event_id":"a","event_type":"click","n":1e400,"t":"' + "\\n\\ud800" * 100_000 + '"}'
    rows = enrich_events(validate_events(parse_events(send(body)))).collect()
    assert rows[0].payload == '{"n":1e400,"t":"' + "\\n\\ud800" * 100_000 + '"}'


def test_numbers_of_any_size_agree_with_a_strict_parser(spark, send):
    """Joined fragments around long numbers and surrogates: taken exactly when the standard library takes them."""
    pieces = ["[", "]", ",", "1e400", "-", '"', '"\\ud800"', "4" * 40, "{", ':', "}", '"a"', " ", ".5", "\\", "e999"]
    bodies = ["[" + a + b + c + "]" for a in pieces for b in pieces for c in pieces]
    bodies += ["{" + a + b + c + "}" for a in pieces for b in pieces for c in pieces]

    def strict(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    rows = parse_events(send(*bodies)).select("body", "parse_error").collect()
    wrong = [r.body for r in rows if (r.parse_error != "malformed") != strict(r.body)]
    assert not wrong, wrong[:5]


def test_what_may_be_altered_is_found_by_either_look(spark):
    """The look for numbers starts at runs of digits, that for surrogates at escapes only."""
    from millrace.functions import json as J

    digits = "1234567890" * 4
    yes = [digits[:39], "." + digits[:39], "7.5" + digits[:36], "12e100", "1E-300", ".5e+100", "x1e999", r"\ud800", r"\uDfff"]
    no = [None, "", digits[:38], "1.5e99", "e100", "1ee100", r"A", r"", r"\n", digits[:38] + "x" + digits[:38]]
    rows = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    wrong = rows.where(J.may_be_altered("t") != rows.want).collect()
    assert not wrong
    assert J._LONG_NUMBER.startswith("[0-9](?<![0-9]{2})")


def test_generated_methods_are_small_enough_for_the_compiler(spark, send, capsys):
    """The JVM compiles no method of more than 8,000 bytes; the parser's was of 12,656."""
    from millrace.operators import route_messages

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        route_messages(validate_events(parse_events(send(GOOD)))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
