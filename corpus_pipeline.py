"""The corpus pipeline: quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.ngram_join import similar_documents
from slatewise.llm.packing import packed_sequences
from slatewise.llm.quality import fit_rules, keep_quality
from slatewise.llm.rows import row_key
from slatewise.llm.suffix_dedup import without_repeats
from slatewise.session import discard, table, workers_see, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble scores 0.3 or more stay, as they are.

    A null text is scored as an empty one. Rows repeated or with a null id are judged row by row; an empty table stays empty.
    """
    return keep_quality(docs, fit_rules(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 or more, the one of the smallest id stays.

    Rows of one id with different texts are told apart: each is judged by its own text. Rows of one id and one text
    stay once; where they differ elsewhere, the one whose JSON comes first. Rows without an id, and rows without words, stay, the
    latter once for each id. An empty table stays empty.
    """
    found = written(similar_documents(docs, percent=80).filter("doc_id is not null").select("doc_id", "row_key", "cluster"), "near-duplicates")
    one = F.struct("doc_id", "row_key")
    first = found.filter("cluster is not null").groupBy("cluster").agg(F.min(one).alias("_first")).select("_first.*")
    stays = first.unionByName(found.filter("cluster is null").select("doc_id", "row_key").distinct()).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    key = row_key(docs["doc_id"], docs["text"])
    kept = docs.join(stays, (docs["doc_id"].cast("long") == F.col("_id")) & (key == F.col("_key")), "left_semi")
    kept = kept.unionByName(docs.filter("doc_id is null"))
    repeated = written(found.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")), "repeated-rows")
    if repeated.isEmpty():
        return kept
    on = (kept["doc_id"].cast("long") == repeated["_id"]) & (row_key(kept["doc_id"], kept["text"]) == repeated["_key"])
    whole = F.struct(*docs.columns)
    several = kept.join(repeated, on, "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return kept.join(repeated, on, "left_anti").unionByName(several)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the byte strings of 50 or more that a smaller id has; texts with nothing left go.

    Null and empty texts and rows with a null id stay as they are; rows repeated under one id take nothing from each
    other. n_chars, where there is such a column, follows the text. An empty table stays empty.
    """
    cut = without_repeats(docs, window=50).filter("n_removed = 0 or text <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at the mixture of what is left; nulls, repeats and empty tables as `packed_sequences` has them."""
    return packed_sequences(docs, window=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("pack", pack)]
#: The fitted rules, byte strings and tokens have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again for the next, and then deleted."""
    workers_see(spark)
    docs, before = table(spark, sf_dir, "documents"), []
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            discard(*before)
            before = [docs]
    return docs
