"""Personal data: patterns, and the terms of their texts that give them away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers,
each found leftmost and without overlap of its kind. A value found so is a
protected entity. The terms of the same text, wherever they stand in it (whole words
of four letters or more outside the base spans), are weighed by what the corpus tells:

    bits(t, e) = log2( P(e in text | t in text) / P(e in text) )

in document frequencies over all rows. A term discloses an entity when both are in
`MIN_SUPPORT` rows or more, at least `MIN_SHARE` of the rows with the term have the
entity, too, and the bits reach `MIN_BITS`. All its places in texts with that entity
become spans of kind `term`; words that overlap a base span are part of it already.
Sanitising puts `[KIND]` for each span.

No pair is weighed that cannot disclose: an entity of fewer than `MIN_SUPPORT` rows, or
a term of more rows than its share allows beside all rows of the entity.

Built-in expressions only. The patterns are written so that no text makes the
regular expression engine go back far or deep: a run of characters is tried
from its beginning only, and loops over groups give nothing back. Null texts
count as empty. Rows are told apart by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import free_names, materialise

MIN_TERM = 4
MIN_SUPPORT = 3
MIN_SHARE = 0.5
MIN_BITS = 3.0

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # After a match that ended inside a run, the rest of the run may begin another.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The whole of a run of digits with single spaces or hyphens between them,
    # if it has 13 to 19.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
_TERM = rf"(?<!\p{{L}})\p{{L}}{{{MIN_TERM},}}+(?!\p{{L}})"
# Matches whose positions are summed up together: appending to an array copies it.
_CHUNK = 256
_PLACE = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.try_cast("int"))
    added = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return added % 10 == 0


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(
        (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (p.try_cast("decimal(38,0)") <= 255), F.lit(False)))


def _between(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: _small_parts(F.regexp_replace(v, r"(^|\.)0+(?=[0-9])", "$1")),
    "card": _luhn,
    "phone": lambda v: _between(F.length(_digits(v)), 9, 15),
}


def _valid(kind: str):
    return lambda s: _VALID[kind](s["value"])


def _place_of(kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _located(gaps: Column, values: Column) -> Column:
    """Start, end (code points) and value of matches, from the text between them."""
    steps = F.filter(
        F.zip_with(gaps, values, lambda g, v: F.struct(
            F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value"))),
        lambda s: s["value"].isNotNull())
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
        lambda c: F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)))
    nothing = F.array().cast(_PLACE)

    def state(at: Column, found: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), found.alias("found"))

    def step(a: Column, s: Column) -> Column:
        begin = a["at"] + s["gap"]
        return state(begin + s["size"], F.concat(a["found"], F.array(F.struct(
            begin.alias("start"), (begin + s["size"]).alias("end"), s["value"].alias("value")))))

    def chunk(a: Column, c: Column) -> Column:
        done = F.aggregate(c, state(a["at"], nothing), step)
        return state(done["at"], F.concat(a["found"], done["found"]))

    placed = F.aggregate(chunks, state(F.lit(0), nothing), chunk, lambda a: a["found"])
    return F.when(F.size(values) > 0, placed).otherwise(nothing)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))


def _row_name() -> Column:
    """doc_id and _key as one text that is never null."""
    id_ = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    return F.concat(id_, F.lit(":"), F.col("_key").cast("string"))


def _row(documents: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("_key"), body.alias("_text"))


def base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, _key, per kind an array of (start, end, value), and _text if there are any."""
    body = F.col("_text")
    rows = _row(documents, text)
    for kind in KINDS:
        rows = rows.withColumn(f"_m_{kind}", F.when(
            _HINTS[kind](body), F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))))
    for kind in KINDS:
        rows = rows.withColumn(f"_g_{kind}", F.when(
            F.size(f"_m_{kind}") > 0, F.split(body, PATTERNS[kind], -1)))

    kinds = [
        F.filter(F.when(F.col(f"_g_{kind}").isNotNull(),
                        _located(F.col(f"_g_{kind}"), F.col(f"_m_{kind}")))
                 .otherwise(F.array().cast(_PLACE)),
                 _valid(kind)).alias(kind)
        for kind in KINDS
    ]
    return rows.select("doc_id", "_key", *kinds, "_text").withColumn(
        "_text", F.when(sum(F.size(kind) for kind in KINDS) > 0, F.col("_text")))


def holders(spans: DataFrame) -> DataFrame:
    """(_row, kind, value, n_entity): entities of MIN_SUPPORT rows or more, with the rows that hold them."""
    here = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in KINDS])
    values = spans.where(F.col("_text").isNotNull()).select(
        _row_name().alias("_row"), F.explode(here).alias("k")).select(
        "_row", "k.kind", F.explode("k.s.value").alias("value")).distinct()
    entities = values.groupBy("kind", "value").agg(F.count("*").alias("n_entity")).where(
        F.col("n_entity") >= MIN_SUPPORT)
    return values.join(entities, ["kind", "value"]).select("_row", "kind", "value", "n_entity")


def places_of_terms(spans: DataFrame, held: DataFrame) -> DataFrame:
    """(_row, term, start, end): the words outside base spans, in all rows that hold an entity of `held`."""
    known = held.select("_row").distinct()
    rows = spans.where(F.col("_text").isNotNull()).withColumn("_row", _row_name()).dropDuplicates(
        ["_row"]).join(known, "_row", "left_semi")
    words = rows.select(
        "_row", F.explode(_located(F.split("_text", _TERM, -1), _words(F.col("_text")))).alias("t")).select(
        "_row", F.lower("t.value").alias("term"), "t.start", "t.end")
    places = F.flatten(F.array(*[F.transform(kind, _place_of(kind)) for kind in KINDS]))
    base = rows.select("_row", F.explode(places).alias("b")).select(
        "_row", F.lit(None).cast("string").alias("term"), "b.start", "b.end")
    # In the order of the text: does a span from before reach into a word, or the next
    # one begin in it?
    is_base = F.col("term").isNull()
    before = Window.partitionBy("_row").orderBy("start", is_base.desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_row").orderBy(F.desc("start"), is_base).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        words.union(base)
        .withColumn("_reach", F.max(F.when(is_base, F.col("end"))).over(before))
        .withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(after))
        .where(~is_base & (F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)))
               & (F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))))
        .select("_row", "term", "start", "end")
    )


def term_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_rows): in how many rows each term occurs, over all texts."""
    words = F.array_distinct(F.transform(_words(F.col(text)), F.lower))
    return documents.select(F.explode(words).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_rows"))


def disclosing_terms(held: DataFrame, places: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, term) of the terms that disclose an entity."""
    rows = documents.count()
    # A term's rows with the entity are no more than the entity's rows.
    most = held.agg(F.max("n_entity")).first()[0] or 0
    frequencies = term_frequencies(documents, text).where(
        (F.col("n_rows") >= MIN_SUPPORT) & (F.col("n_rows") * MIN_SHARE <= most))
    # Spark takes what comes of an explode for as few rows as there were texts.
    terms = places.select("_row", "term").distinct().join(frequencies.hint("merge"), "term")
    share = F.col("n_both") / F.col("n_rows")
    bits = F.log2(share / (F.col("n_entity") / F.lit(float(max(1, rows)))))
    return (
        held.join(terms.hint("merge"), "_row").where(F.col("n_rows") * MIN_SHARE <= F.col("n_entity"))
        .groupBy("kind", "value", "term", "n_entity", "n_rows").agg(F.count("*").alias("n_both"))
        .where((F.col("n_both") >= MIN_SUPPORT) & (share >= MIN_SHARE) & (bits >= MIN_BITS))
        .select("kind", "value", "term")
    )


def find_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, _key, the base spans by kind, and `term` spans (start, end)."""
    spans = materialise(base_spans(documents, text), "pii-spans")
    held = materialise(holders(spans), "pii-holders")
    places = materialise(places_of_terms(spans, held), "pii-places")
    telling = materialise(disclosing_terms(held, places, documents, text), "pii-terms")
    masked = held.join(telling, ["kind", "value"]).select("_row", "term").distinct()
    terms = (
        places.join(masked.hint("merge"), ["_row", "term"]).groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("term"))
        .withColumnRenamed("_row", "_r")
    )
    return spans.withColumn("_row", _row_name()).join(terms, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", "_key", *KINDS,
        F.coalesce("term", F.array().cast("array<struct<start:int,end:int>>")).alias("term"))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat(
        F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def report(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(documents, text)
    base = F.concat(*[_named(k) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _named("term")), ",").alias("spans"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with `[KIND]` for each of the spans (start, end, kind), sorted.

    Where spans overlap, the first names the whole stretch.
    """
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    merged = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), empty.alias("kept")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept")),
        ).otherwise(F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(
                F.slice(a["kept"], F.lit(1), F.size(a["kept"]) - 1),
                F.array(F.struct(
                    F.element_at(a["kept"], -1)["start"].alias("start"),
                    F.greatest(a["at"], s["end"]).alias("end"),
                    F.element_at(a["kept"], -1)["kind"].alias("kind"))),
            ).alias("kept"))),
        lambda a: a["kept"])
    return merged


def sanitise(documents: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, personal data and disclosing terms generalised.

    Texts without spans, null texts among them, stay as they are.
    """
    id_, key_, spans_ = free_names(documents, "_id", "_k", "_spans")
    found = find_spans(documents, text)
    every = F.array_sort(F.concat(*[
        F.transform(k, _place_of(k.upper())) for k in (*KINDS, "term")]))
    spans = found.where(F.size(every) > 0).select(
        F.col("doc_id").alias(id_), F.col("_key").alias(key_), every.alias(spans_)
    ).dropDuplicates([id_, key_])
    key = F.xxhash64(text)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(key_))
    joined = documents.join(spans, same, "left").withColumn(
        spans_, sanitised(F.col(text), F.col(spans_)))
    body = F.col(text)
    pieces = F.transform(spans_, lambda s, i: F.concat(
        body.substr(
            F.when(i > 0, F.get(F.col(spans_), i - 1)["end"]).otherwise(0) + 1,
            s["start"] - F.when(i > 0, F.get(F.col(spans_), i - 1)["end"]).otherwise(0)),
        F.lit("["), s["kind"], F.lit("]")))
    rest = F.expr(f"substr({text}, element_at({spans_}, -1).end + 1)")
    clean = F.when(F.size(spans_) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(body)
    return joined.select(*[
        clean.alias(text) if c == text else F.col(c) for c in documents.columns])
