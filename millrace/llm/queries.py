"""The registered queries of these operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, decontaminate, divergence, hard_negatives, html_text, language, pii
from millrace.llm import simhash, suffix_dedup, token_files, toxicity, url_filter

# The rules of the URL query (host, path, verdict) and the id that
# ends each document in token files.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
END_ID = 2
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(documents, keep_text=False).drop("ids", "decoded")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(
        documents, token_files.token_folder(documents), end_id=END_ID)
    return token_files.read_token_files(manifest)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES_SQL} AS rules(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # Every seventh label is wrong, as mined labels are.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(vectors.withColumn("label", label))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_ann, op2_toxicity, op3_html_text, op4_pii, op5_suffix_dedup, op6_bpe,
              op7_decontaminate, op8_simhash, op9_token_files, op10_url_filter, op11_divergence,
              op12_hard_negatives, op13_language)
}

ORACLE = {
    "op7_decontaminate": r"""
        WITH words AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n,
                 array_to_string(w[i:i + 9], ' ') AS win
          FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i)
          WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
          SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
          WHERE len(w) >= n),
        found AS (
          SELECT doc_id, p.n, i, item_id FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
        hit AS (
          SELECT doc_id, count(DISTINCT i + d) AS n_hit
          FROM found, unnest(range(0, n)) AS r(d) GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids
          FROM found GROUP BY doc_id)
        SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op10_url_filter": rf"""
        WITH rules(host, path, verdict) AS (VALUES {_RULES_SQL}),
        parsed AS (
          SELECT page_id, url,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        best AS (
          SELECT p.page_id, p.url, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
                 max_by(r.verdict, length(r.host || r.path)) AS verdict
          FROM (SELECT DISTINCT * FROM parsed) p JOIN rules r
            ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
          GROUP BY p.page_id, p.url)
        SELECT parsed.page_id, parsed.url, parsed.host, parsed.path, best.rule,
               coalesce(best.verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN best USING (page_id, url)
    """,
    "op11_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
          FROM documents),
        words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
        kept AS (
          SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term
          HAVING count(DISTINCT id) >= 10),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        cells AS (
          SELECT s.lang, s.source, k.term, k.n, count(w.id) AS c
          FROM sources s JOIN kept k ON s.lang = k.lang
          LEFT JOIN words w ON w.lang = s.lang AND w.source = s.source AND w.term = k.term
          GROUP BY s.lang, s.source, k.term, k.n),
        totals AS (
          SELECT *, sum(c) OVER (PARTITION BY lang, source) AS cs, sum(n) OVER (PARTITION BY lang, source) AS ns,
                 count(*) OVER (PARTITION BY lang, source) AS v
          FROM cells),
        shares AS (
          SELECT lang, source, term, c,
                 1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (cs + 2 * v) AS p,
                 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (ns + 2 * v) AS q
          FROM totals),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item,
                 sum(coalesce((a.p - b.p) * (a.p - b.p) // (a.p + b.p), 0)) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
          GROUP BY a.lang, a.source, b.source),
        every AS (
          SELECT a.lang, a.source, b.source AS item
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
        found AS (
          SELECT e.lang, e.source, 'pair' AS part, e.item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM every e LEFT JOIN pairs p ON e.lang = p.lang AND e.source = p.source AND e.item = p.item
          UNION ALL
          SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT)
          FROM shares WHERE c > 0 AND p > q),
        ranked AS (
          SELECT *, CAST(row_number() OVER (
                   PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
          FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_hard_negatives": """
        WITH usable AS (
          SELECT DISTINCT vec_id AS id,
                 CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
                 CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM usable a JOIN usable b
            ON a.id % 100 = 0 AND NOT (a.id = b.id AND a.label = b.label AND a.v = b.v)),
        positives AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
         AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
