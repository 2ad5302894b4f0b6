"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns rows with the columns of documents, but for the last, which
returns the tokens' digests. Between two stages the rows are a Parquet table; the
tokens and the texts decoded from them are one, too.

* toxicity: a document with a score of 0.5 or more goes.
* simhash: documents are linked as by op8, with its shingles and bits; of the
  documents of a component the one with the smallest doc_id stays; without a doc_id,
  or among rows that share one, the first by text.
* decontaminate: a document with any benchmark window in it goes.
* pii: `[KIND]` stands for personal data and the terms that give it away.
* bpe: encoded, decoded again, and counted; the kept rows with all their columns, ids
  and decoded texts are written as the table `tokens`, and its digests are given back.

A null text counts as an empty one in every stage. Texts without a word have one
fingerprint, so of all of them one stays. Further columns are carried along by the
first four stages, whatever their names; rows equal in all columns are near copies.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, pii, simhash, toxicity
from millrace.llm.common import free_names, materialise
from millrace.llm.decontaminate import row_name
from millrace.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs, "_score")
    scored = toxicity.score(docs, model, name=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, copy = free_names(docs, "_row", "_copy")
    prints = materialise(
        simhash.with_fingerprints(docs.select("doc_id", "text")).select(
            "doc_id", "_fp", row_name().alias("_row")),
        "fingerprints",
    )
    # One row of each component stays: the smallest id, then the smallest digest.
    # The least is found by a pre-aggregated minimum, however large a component is.
    # Components go by their root: an id may be null, or stand for several texts.
    marked = simhash.with_roots(prints).groupBy("_root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    # Of rows that are equal in id and text, too, one stays. The texts are dealt
    # out by name once, for both the window and the join.
    order = Window.partitionBy(row).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    named = docs.withColumn(row, row_name()).withColumn(copy, F.row_number().over(order))
    kept = marked.select(F.col("first._row").alias(row))
    # There are as many names as documents stay, whatever Spark takes them for: no broadcast.
    return named.where(F.col(copy) == 1).join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (row,) = free_names(docs, "_row")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = judged.where("contaminated").select(F.col("_row").alias(row)).distinct()
    return docs.withColumn(row, row_name()).join(hit, row, "left_anti").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def tokens(docs: DataFrame) -> DataFrame:
    """The table of tokens: the columns but the text, ids, the decoded text, digests."""
    return materialise(bpe.encode_and_decode(docs, keep_text=False), "tokens")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens(docs).select("doc_id", *[f.name for f in bpe.DIGESTS])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", sanitise),
    ("bpe", encode),
]

# Trained scores, hashes and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
