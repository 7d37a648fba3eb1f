"""Each operator applied to its whole table with production parameters, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import (
    decontamination,
    fill_middle,
    hnsw,
    html_extraction,
    lexical_search,
    licenses,
    line_dedup,
    packing,
    pieces,
    pii,
    simhash,
    suffix_dedup,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of session and folder under its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query(LINE_DEDUP)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op7_simhash_bk(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, special=packing.SPECIAL)


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    scored = toxicity.score(documents, toxicity.learn(documents, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", predicted)


@query()
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


@query()
def op6_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


@query()
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.with_items(documents, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("items"))


@query()
def op10_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(licenses.oracle_sql())
def op3_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query()
def op5_pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    spans = pii.personal_spans(table(spark, folder, "documents"))
    counts = [
        F.size(F.array_remove(F.transform("base", lambda x: x["kind"] == k), False)).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(pii.KINDS)
    ]
    base, every = F.col("base"), F.array_sort(F.concat("base", "added"))
    return spans.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(every).alias("spans"))


FILL_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS c1,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS c3,
         CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS c4
  FROM cut
), parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR c3 >= 50 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              THEN 'plain' WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1:n], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query(FILL_MIDDLE)
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_middle.rearrange(table(spark, folder, "documents").select("doc_id", "text"))
    back = fill_middle.restore(cut.drop("text"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query()
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    decoded = pieces.decode(encoded.drop("text"), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LEXICAL_SEARCH = r"""
WITH item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT r, doc_id, terms, len(terms) AS n FROM numbered WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), measured AS (
  SELECT r, doc_id, terms, 10 + (90 * n * n_docs) // n_terms AS m FROM docs, totals
), words AS (
  SELECT r, doc_id, m, unnest(terms) AS term FROM measured
), counts AS (
  SELECT r, doc_id, m, term, count(*) AS tf FROM words
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, doc_id, m, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN counts USING (term) GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank,
         doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query(LEXICAL_SEARCH)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
