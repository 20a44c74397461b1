"""A corpus from raw documents: quality rules, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.decontaminate import benchmark_overlap
from rallyframe.llm.inputs import column
from rallyframe.llm.neardup import near_duplicates
from rallyframe.llm.quality import fit_quality, quality_rules
from rallyframe.llm.queries import pack_documents
from rallyframe.llm.substrings import substring_dedup
from rallyframe.session import settle


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns under names that no operator's result has."""
    extra = [name for name in docs.columns if name not in ("doc_id", "text")]
    renamed = [column(name).alias(f"extra_{k}") for k, name in enumerate(extra)]
    return docs.select("doc_id", F.col("text").alias("extra_text"), "text", *renamed)


def _documents(rows: DataFrame, docs: DataFrame, text: Column, changed: Column | None = None) -> DataFrame:
    """The columns of `docs` again, in their order; `n_chars` follows a changed text."""
    out = []
    extra = [name for name in docs.columns if name not in ("doc_id", "text")]
    for name in docs.columns:
        value = F.col("doc_id") if name == "doc_id" else text if name == "text" else F.col(f"extra_{extra.index(name)}")
        if name == "n_chars" and changed is not None:
            value = F.when(changed, F.length(text).cast(docs.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    return rows.select(*out)


def _extras(docs: DataFrame) -> list[str]:
    return [f"extra_{k}" for k in range(len(docs.columns) - 2)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model learns from the labels of this input's documents.

    Null and empty texts fail the word count and go. Every row is judged by itself, repeated ones too. Other columns
    stay, whatever their names. Without documents the result is empty.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules(_rows(docs), model, threshold=0.5, carry=["extra_text", *_extras(docs)])
    return _documents(judged.filter("kept"), docs, F.col("extra_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Null and empty texts are linked with nothing and stay, as do rows without an id. Rows that share an id go or stay
    together. Other columns stay, whatever their names. Without documents the result is empty.
    """
    found = near_duplicates(docs, size=4, percent=80)
    gone = found.filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[column(name) for name in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word windows of earlier documents; a text that has none stays as it is.

    A document of which nothing is left goes; one that was null or empty before stays. A row that repeats an id is the
    same document, not an earlier one. Other columns stay, whatever their names; `n_chars` follows a changed text.
    Without documents the result is empty.
    """
    found = substring_dedup(_rows(docs), window=13, carry=["extra_text", *_extras(docs)])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("extra_text"))
    return _documents(found.filter(~changed | (F.col("n_removed") < F.col("n_words"))), docs, text, changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that 10-word windows of benchmark items cover; documents that are nothing else go.

    Null and empty texts have no words and stay. Every row is searched by itself, repeated ones too. Other columns stay,
    whatever their names; `n_chars` follows a changed text. Without documents the result is empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = benchmark_overlap(_rows(docs), items, window=10, clean=True, carry=_extras(docs))
    changed = F.col("n_hit") > 0
    left = found.filter(~changed | (F.col("n_hit") < F.col("n_words")))
    return _documents(left, docs, F.col("cleaned"), changed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens.

    A null or empty text is one piece, its end. Every row is packed, repeated ones too. Columns but the id are not
    returned. Without documents the result is empty.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: A fitted model and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table `documents`, each on what the one before it has kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
