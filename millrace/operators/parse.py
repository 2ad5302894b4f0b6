"""Decode message bodies and find the fields every event must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json as J
from millrace.session import require_configured

_CORE = "struct<event_id:string,event_type:string,user_id:string>"

# Texts that a value of another JSON type could also have. Only for these is
# the type of the value looked up.
_MAYBE_EMPTY = r"^(\[|\{|-?0(\.0*)?([eE].*)?$|-?[0-9.]+[eE]-[0-9]{3,}$|false$)"
_MAYBE_NOT_STRING = r"^(\[|\{|-?[0-9]|true$|false$)"
_MAYBE_CONTAINER = r"^(\[|\{)"


def parse_events(envelopes: DataFrame) -> DataFrame:
    """Parse each message once; add its core fields and `parse_error`.

    Keeps the envelope's metadata columns and adds:

    * `body` - the message as text (bytes unchanged, even if not valid UTF-8)
    * `sealed` - the document as VARIANT, see `functions.json`
    * `mark` - NULL, or what marks the numbers and surrogates in `sealed` that were
      kept apart from the parser because it would alter them
    * `parse_error` - NULL, or the reason the message cannot be an event
    * `missing` - the required keys that are not there, joined; else NULL
    * `event_id` - text of the id; NULL if it is missing, null, empty, zero,
      false or not a scalar
    * `event_type` - the type; NULL unless a JSON string
    * `user_id` - text of the user; NULL if missing or null
    * `user_is_scalar` - false if the user is an object or array

    A key counts as given when it is present, even with a null value.
    """
    require_configured(envelopes.sparkSession)
    kept = [F.col(c) for c in envelopes.columns if c != "value"]
    body = F.col("value").cast("string")
    staged = envelopes.select(
        *kept,
        body.alias("body"),
        J.seal_of("value").alias("seal"),
    ).select(
        "*",
        # Valid UTF-8 only: bytes that are not would not survive the replacements.
        F.when(J.may_be_altered("body") & F.is_valid_utf8("body"), F.col("seal")).alias("mark"),
    ).select(
        "*",
        J.parse_one_document(
            F.when(F.col("mark").isNull(), F.col("body")).otherwise(J.kept_apart("body", "mark")), "seal",
        ).alias("sealed"),
    ).select("*", F.try_variant_get("sealed", J.DOCUMENT, _CORE).alias("core"))

    # What several rules look at is a column of its own: written out in each of them, the
    # generated method grows beyond the 8,000 bytes up to which the JVM compiles methods,
    # and every message is judged by its interpreter.
    read = staged.select(
        "*",
        _as_written(F.col("core.event_id")).alias("id_text"),
        _as_written(F.col("core.event_type")).alias("type_text"),
        _absent("event_id").alias("no_id"),
        _absent("event_type").alias("no_type"),
    ).select(
        "*",
        F.when(F.col("id_text").rlike(_MAYBE_EMPTY), _id_kind()).alias("id_kind"),
        F.when(F.col("core.user_id").rlike(_MAYBE_CONTAINER), J.field_kind("sealed", "user_id")).alias("user_kind"),
    )
    # The judgement is made inside a generator because the optimizer moves no
    # filter through one: a later filter on `parse_error` would otherwise pull
    # the whole JSON parse into the filter and evaluate it a second time.
    judged = F.inline(
        F.array(
            F.struct(
                _parse_error().alias("parse_error"),
                _missing().alias("missing"),
                _event_id().alias("event_id"),
                _event_type().alias("event_type"),
                _as_written(F.col("core.user_id")).alias("user_id"),
                _user_is_scalar().alias("user_is_scalar"),
            )
        )
    )
    return read.select(*[F.col(c) for c in envelopes.columns if c != "value"],
                       "body", "sealed", "mark", judged)


def _as_written(text: Column) -> Column:
    return F.when(F.col("mark").isNull(), text).otherwise(J.restored_text(text, "mark"))


def _absent(name: str) -> Column:
    return F.col(f"core.{name}").isNull() & ~J.field_present("sealed", name)


def _parse_error() -> Column:
    # Order matters: one reason per message, the first that applies.
    return (
        F.when(~F.is_valid_utf8("body"), "bad_utf8")
        .when(
            ~J.is_one_document("sealed", "seal"),
            F.when(J.too_large("body"), "too_large").otherwise("malformed"),
        )
        .when(~J.starts_object("body"), "not_an_object")
        .when(F.col("no_id") | F.col("no_type"), "missing_required")
        .when(F.col("publish_time").isNull(), "null_publish_time")
    )


def _missing() -> Column:
    absent = [F.when(F.col("no_id"), "event_id"), F.when(F.col("no_type"), "event_type")]
    return F.when(J.starts_object("body"), F.concat_ws(", ", *absent))


def _id_kind() -> Column:
    kept = F.col("mark").isNotNull() & J.is_kept_number("core.event_id", "mark")
    return F.when(kept, "NUMBER").otherwise(J.field_kind("sealed", "event_id"))


def _event_id() -> Column:
    text, kind = F.col("id_text"), F.col("id_kind")
    empty_scalar = (text == "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    unusable = (text == "") | (
        kind.isNotNull()
        & (kind != "STRING")
        & (J.is_container(kind) | empty_scalar)
    )
    return F.when(~unusable, text)


def _event_type() -> Column:
    text = F.col("type_text")
    kept = F.col("mark").isNotNull() & J.is_kept_number("core.event_type", "mark")
    is_text = ~text.rlike(_MAYBE_NOT_STRING) | (J.field_kind("sealed", "event_type") == "STRING")
    return F.when(is_text & ~kept, text)


def _user_is_scalar() -> Column:
    return ~F.coalesce(J.is_container(F.col("user_kind")), F.lit(False))
