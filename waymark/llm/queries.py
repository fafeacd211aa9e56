"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import byte_bpe, conversations, decontaminate, html_text, licenses, media, negatives, packing, pii, simhash, token_counts, toxicity, url_filter
from waymark.llm.common import table

#: Site rules of the URL filter: verdict and host/path.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


#: Documents aren't repositories: few are licence files as a whole, so less of a text is enough for it to speak for its directory.
NOTICE_SHARE = 0.1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/lang/hundred/doc_id; one of which a notice is a tenth or more speaks for its directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws(
        "/",
        F.lit(""),
        F.coalesce("source", F.lit("unknown")),
        F.coalesce("lang", F.lit("unknown")),
        F.floor(F.col("doc_id") / 100).cast("string"),
        F.col("doc_id").cast("string"),
    )
    files = docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    found = licenses.scan(files, min_share=NOTICE_SHARE)
    doc_id = F.element_at(F.split("path", "/"), -1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "license", "cosine", "origin", "from_dir")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_png(media.store_as_png(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(given), given)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = vectors.select("vec_id", F.col("embedding").alias("vector"), noisy.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontamination,
        op3_byte_bpe,
        op4_url_filter,
        op5_licenses,
        op6_media,
        op7_pii,
        op8_toxicity,
        op9_simhash,
        op10_html_text,
        op11_packing,
        op12_conversation_repair,
        op13_hard_negatives,
    )
}

#: Scores of all anchors with all rows: small enough for SQL, since anchors are a hundredth of the rows.
ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5""",
}
