"""JSON as VARIANT: strict parsing, scalar extraction, residual payloads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the document and the seal sit in what `parse_one_document` returns.
DOCUMENT = "$[0]"
SEAL = "$[1]"

_CONTAINER = r"^[\[{]"

# Limits of Spark's JSON parser; the second one is on nested arrays and objects.
MAX_TEXT_BYTES = 16 << 20
MAX_DEPTH = 1000

# What the parser would alter: numbers with more than 38 digits or an exponent of three
# digits and more, and escapes of surrogates, which may stand alone.
# A run of digits is looked at from its first digit only; most texts have no escape.
_LONG_NUMBER = r"[0-9](?<![0-9]{2})(?:[0-9.]{38}|[0-9]*+[eE][+-]?[0-9]{3})"
_SURROGATE_ESCAPE = r"\\u[dD][89a-fA-F]"
# A text that is never closed goes on to the end.
_STRING = r'(?<s>"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z))'
# A whole number by the grammar of JSON that is none of the usual ones, and no key.
_NUMBER = (
    r"(?<![0-9.eE+-])(?<n>-?+(?=[0-9.]{39}|[0-9.]++[eE][+-]?[0-9]{3})"
    r"(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?![0-9.eE+-])(?!\s*+:)"
)
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_OTHER_ESCAPE = r"\\[^u]|\\u(?![dD][89a-fA-F])"
_SURROGATE = rf"(?<s>{_PAIR}|{_OTHER_ESCAPE})|\\(?<n>u[dD][89a-fA-F][0-9a-fA-F]{{2}})"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def seal_of(body: Column | str) -> Column:
    """Digest that closes the wrapped document, see `parse_one_document`."""
    return F.sha2(_col(body), 256)


def may_be_altered(body_text: Column | str) -> Column:
    """Could the text hold what `kept_apart` is for?"""
    text = _col(body_text)
    escaped = text.contains("\\u") & text.rlike(_SURROGATE_ESCAPE)
    return F.coalesce(escaped | text.rlike(_LONG_NUMBER), F.lit(False))


def kept_apart(body_text: Column | str, mark: Column | str) -> Column:
    """The document with what the parser would alter written as plain text.

    `mark` is a text that the document does not hold, such as its digest. A number
    becomes the string `"<mark>#<number>"`, a surrogate that has no partner
    `<mark><u....>` within its string; a document that is not JSON stays none.
    `restored` turns JSON text back, `restored_text` a single value.
    """
    text, mark = _col(body_text), _col(mark)

    def marked(text: Column, pattern: str) -> Column:
        # The first alternative is passed over: it leaves an empty pair of brackets behind.
        both = F.regexp_replace(text, F.lit(pattern), F.concat(F.lit("${s}"), mark, F.lit("<${n}>")))
        return F.replace(both, F.concat(mark, F.lit("<>")), F.lit(""))

    numbers = marked(text, f"{_STRING}|{_NUMBER}")
    numbers = F.regexp_replace(numbers, F.concat(mark, F.lit("<([^>u]++)>")),
                               F.concat(F.lit('"'), mark, F.lit('#$1"')))
    return marked(numbers, _SURROGATE)


def _surrogates_restored(text: Column, mark: Column) -> Column:
    return F.regexp_replace(text, F.concat(mark, F.lit("<(u[0-9a-fA-F]{4})>")), F.lit(r"\\$1"))


def restored(json_text: Column | str, mark: Column | str) -> Column:
    """JSON text with the numbers and surrogates that were kept apart."""
    text, mark = _col(json_text), _col(mark)
    numbers = F.regexp_replace(text, F.concat(F.lit('"'), mark, F.lit('#([^"]++)"')), F.lit("$1"))
    return _surrogates_restored(numbers, mark)


def restored_text(value: Column | str, mark: Column | str) -> Column:
    """A value as text: a number as it was written, half a surrogate pair as its escape."""
    text, mark = _col(value), _col(mark)
    return _surrogates_restored(F.regexp_replace(text, F.concat(F.lit("^"), mark, F.lit("#")), F.lit("")), mark)


def is_kept_number(value: Column | str, mark: Column | str) -> Column:
    return F.coalesce(_col(value).startswith(F.concat(_col(mark), F.lit("#"))), F.lit(False))


def parse_one_document(body_text: Column | str, seal: Column | str) -> Column:
    """Parse text as `[<document>, <seal>]`.

    Spark's JSON parsers stop at the end of the first value and accept whatever
    follows it. Behind the body we therefore put a digest of that body: it is
    element 1 of the array exactly when the body was one whole document, since
    no body is known to carry its own SHA-256 digest. One parse, no second pass
    over the text. NULL where the text does not parse at all.
    """
    return F.try_parse_json(F.concat(F.lit("["), _col(body_text), F.lit(',"'), _col(seal), F.lit('"]')))


def is_one_document(sealed: Column | str, seal: Column | str) -> Column:
    found = F.try_variant_get(_col(sealed), SEAL, "string") == _col(seal)
    return F.coalesce(found, F.lit(False))


def too_large(body_text: Column | str) -> Column:
    """Could a body that does not parse be valid JSON beyond the parser's limit?

    It takes texts of up to MAX_TEXT_BYTES (and up to MAX_DEPTH levels).
    """
    return F.octet_length(_col(body_text)) > MAX_TEXT_BYTES


def starts_object(body_text: Column | str) -> Column:
    """True where a valid document is an object: its first character tells."""
    return F.ltrim(_col(body_text), F.lit(" \t\r\n")).startswith("{")


def field_kind(sealed: Column | str, name: str) -> Column:
    """Schema of a document field, such as STRING, BIGINT or ARRAY<...>."""
    return F.schema_of_variant(F.try_variant_get(_col(sealed), f"{DOCUMENT}.{name}", "variant"))


def field_present(sealed: Column | str, name: str) -> Column:
    """Is the key there? An explicit null counts as present."""
    return F.try_variant_get(_col(sealed), f"{DOCUMENT}.{name}", "variant").isNotNull()


def is_container(kind: Column) -> Column:
    return kind.startswith("ARRAY") | kind.startswith("OBJECT")


def payload_without(sealed: Column | str, names: Iterable[str]) -> Column:
    """The document minus some top-level fields, as JSON text.

    Goes through MAP<STRING, VARIANT> so that numbers, strings, booleans and
    explicit nulls keep their types.
    """
    fields = F.try_variant_get(_col(sealed), DOCUMENT, "map<string,variant>")
    dropped = list(names)
    return F.to_json(F.map_filter(fields, lambda key, _: ~key.isin(dropped)))


def json_value(text: Column | str, path: str) -> Column:
    """Scalar at `path` as text; NULL if absent, null, an object or an array.

    `get_json_object` finds the value in one streaming pass. Only where its
    text could be that of an object or array is the type looked up; such a
    value is made null by adding null to its text. (A CASE that returned the
    text would search for it twice: common subexpressions are not shared with
    conditional branches.)
    """
    text = _col(text)
    found = F.get_json_object(text, path)
    node = F.try_variant_get(F.try_parse_json(text), path, "variant")
    nested = found.rlike(_CONTAINER) & is_container(F.schema_of_variant(node))
    return F.concat(found, F.when(nested, F.lit(None).cast("string")).otherwise(""))
