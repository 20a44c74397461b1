"""The operators on whole tables, one query each, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.centroids import centre_clusters, integer_vectors
from rallyframe.llm.crossentropy import cross_entropy_difference
from rallyframe.llm.decontaminate import benchmark_overlap
from rallyframe.llm.licences import TEMPLATES, licence_scan
from rallyframe.llm.neardup import near_duplicates
from rallyframe.llm.packing import packed, token_pieces
from rallyframe.llm.quality import fit_quality, quality_rules
from rallyframe.llm.sharding import byte_shards
from rallyframe.llm.spelling import counted_words, spelling_variants
from rallyframe.llm.substrings import substring_dedup
from rallyframe.llm.suffixes import suffix_dedup
from rallyframe.llm.tokenshards import read_documents, shard_files, write_token_shards
from rallyframe.llm.toxicity import fit_toxicity, toxicity
from rallyframe.session import scratch


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Words left of each document once 13-word windows of earlier documents are gone."""
    return substring_dedup(_documents(spark, sf), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op2_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Licence notices in every document: how many, and the most similar template."""
    return licence_scan(_documents(spark, sf), threshold=0.8).select(
        "doc_id", "n_segments", F.size("licences").cast("long").alias("n_matches"), "best_licence", "best_dice"
    )


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality counts and verdict for every document."""
    docs = _documents(spark, sf)
    model = fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return quality_rules(docs, model, threshold=0.5)


def op4_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """How much closer each document is to those labelled good than to the others."""
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(_documents(spark, sf), good, public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(_documents(spark, sf))


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row for each token piece: what it holds, as a checksum, and its place."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    rows = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(rows, 4096)


def op6_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside 10-word windows of benchmark items, and which items."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return benchmark_overlap(_documents(spark, sf), items, window=10).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes left of each document once 100-byte strings that start earlier are gone."""
    return suffix_dedup(_documents(spark, sf), length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document; a third of the ids is held out from the labels learned."""
    docs = _documents(spark, sf)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"), where=~held_out)
    return toxicity(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "lang_threshold",
        F.col("toxic").alias("toxic_by_language"),
    )


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are at least 0.8 alike."""
    return near_duplicates(_documents(spark, sf), size=4, percent=80)


def op10_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes, contiguous by doc_id."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = _documents(spark, sf).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32")
    )
    return byte_shards(rows, F.col("bytes"), ["doc_id", "bytes", "text_crc32"], 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents, the more frequent words one edit away, and the ends of their chains."""
    return spelling_variants(counted_words(_documents(spark, sf), length=6, least=5, one_in=199), times=5)


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as integer vectors in 16 clusters after three rounds."""
    vectors = integer_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), size=64, scale=64)
    return centre_clusters(vectors, n=16, rounds=3, seed="1:", size=64)


def op13_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place and ids, as read back from the written shards."""
    path = scratch(spark)
    write_token_shards(_documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_documents(shard_files(spark, path)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_licences": op2_licences,
    "op3_quality": op3_quality,
    "op4_cross_entropy": op4_cross_entropy,
    "op5_packing": op5_packing,
    "op6_benchmark": op6_benchmark,
    "op7_suffixes": op7_suffixes,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_shards": op10_shards,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_token_shards": op13_token_shards,
}

#: Words of whole texts, in order.
_WORDS = r"""
  texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_QUOTED = ", ".join(
    "('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items()
)
_BIGRAMS = "list_distinct([words[p] || ' ' || words[p + 1] FOR p IN range(1, len(words))])"



def _centroid_sql(rounds: int) -> str:
    """Rounds written out: every vector against every centroid, then floors of the means."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"""
  gaps{k} AS (
    SELECT row, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance
    FROM numbers JOIN centroids{k} USING (i) GROUP BY row, cluster),
  near{k} AS (
    SELECT row, cluster, distance FROM gaps{k}
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            parts.append(f"""
  sums{k} AS (
    SELECT cluster, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM near{k} JOIN numbers USING (row) GROUP BY cluster, i),
  centroids{k + 1} AS (
    SELECT cluster, i, CASE WHEN n IS NULL THEN c ELSE (total - ((total % n) + n) % n) // n END AS c
    FROM centroids{k} LEFT JOIN sums{k} USING (cluster, i))""")
    return ",".join(parts)


SQL: dict[str, str] = {
    "op12_centroids": f"""
WITH
  kept AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row,
      [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
  numbers AS (SELECT row, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
  starts AS (
    SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster
    FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
  centroids0 AS (SELECT cluster, i, x AS c FROM starts JOIN numbers USING (row)),
  {_centroid_sql(3)},
  names AS (
    SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
    FROM centroids3 GROUP BY cluster),
  totals AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near3 GROUP BY cluster),
  whole AS (SELECT CAST(sum(distance) AS BIGINT) AS inertia FROM near3)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, inertia, centroid_sha256
FROM kept JOIN near3 USING (row) JOIN totals USING (cluster) JOIN names USING (cluster), whole
""",
    "op1_substrings": f"""
WITH {_WORDS},
  starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM texts),
  windows AS (SELECT doc_id, p, array_to_string(list_slice(words, p, p + 12), ' ') AS w FROM starts),
  firsts AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
  gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (w) WHERE first_id < doc_id),
  removed AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id),
  kept AS (
    SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
      CASE WHEN places IS NULL THEN words
        ELSE [words[p] FOR p IN range(1, len(words) + 1) IF NOT list_contains(places, p)]
      END AS left_words
    FROM texts LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept
""",
    "op6_benchmark": r"""
WITH
  lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
  texts AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
  asked AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark),
  sized AS (SELECT item, words, least(len(words), 10) AS n FROM asked WHERE len(words) > 0),
  item_starts AS (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM sized),
  phrases AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, p, p + n - 1), ' ') AS w FROM item_starts),
  sizes AS (SELECT DISTINCT n FROM phrases),
  doc_starts AS (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM texts, sizes WHERE len(words) >= n),
  windows AS (SELECT doc_id, n, p, array_to_string(list_slice(words, p, p + n - 1), ' ') AS w FROM doc_starts),
  found AS (SELECT doc_id, n, p, item FROM windows JOIN phrases USING (n, w)),
  covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM found),
  hits AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
  names AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
""",
    "op2_licences": f"""
WITH
  templates(licence, text) AS (VALUES {_QUOTED}),
  template_words AS (SELECT licence, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) AS words FROM templates),
  template_grams AS (SELECT licence, {_BIGRAMS} AS grams FROM template_words),
  lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS p, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
  full_lines AS (
    SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS block
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  blocks AS (
    SELECT doc_id, block, string_agg(line, chr(10) ORDER BY p) AS line FROM full_lines
    GROUP BY doc_id, block HAVING count(*) > 1),
  segments AS (
    SELECT doc_id, block, is_block, row_number() OVER () AS segment, line
    FROM (
      SELECT doc_id, block, false AS is_block, line FROM full_lines
      UNION ALL SELECT doc_id, block, true AS is_block, line FROM blocks)),
  segment_words AS (SELECT doc_id, segment, regexp_extract_all({_LOWER.format("line")}, {_ALNUM}) AS words FROM segments),
  segment_grams AS (SELECT doc_id, segment, {_BIGRAMS} AS grams FROM segment_words),
  vocabulary AS (SELECT DISTINCT licence, len(grams) AS m, unnest(grams) AS gram FROM template_grams),
  pairs AS (SELECT doc_id, segment, len(grams) AS n, unnest(grams) AS gram FROM segment_grams),
  shared AS (
    SELECT doc_id, segment, licence, m, 2.0::DOUBLE * count(*) / (n + m) AS dice
    FROM pairs JOIN vocabulary USING (gram) GROUP BY doc_id, segment, licence, n, m),
  likeliest AS (
    SELECT * FROM shared WHERE dice >= 0.8
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY dice DESC, m DESC, licence) = 1),
  contested AS (
    SELECT doc_id, licence, dice, is_block, first_value(is_block) OVER (
      PARTITION BY doc_id, block ORDER BY dice DESC, m DESC, is_block) AS block_wins
    FROM likeliest JOIN segments USING (doc_id, segment)),
  matches AS (SELECT * FROM contested WHERE is_block = block_wins),
  best AS (
    SELECT doc_id, count(*) AS n_matches, max(dice) AS best_dice,
      min(licence) FILTER (WHERE dice = top) AS best_licence
    FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id) AS top FROM matches) GROUP BY doc_id),
  counted AS (SELECT doc_id, count(*) AS n_segments FROM segments GROUP BY doc_id)
SELECT doc_id, coalesce(n_segments, 0) AS n_segments, coalesce(n_matches, 0) AS n_matches, best_licence, best_dice
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN best USING (doc_id)
""",
}
