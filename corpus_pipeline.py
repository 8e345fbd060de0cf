"""The corpus pipeline: quality rules, near-duplicate join, secret scans, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of ``documents``.

Every stage gives an empty result for an empty table, takes texts of any length whole, and carries columns of any name
along; each says below what it does with null and empty texts, null keys, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, secrets, shingle_join
from tessera.llm.common import Scratch, read
from tessera.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; the bands are fitted to ``docs``. Repeated rows
    get one verdict, and null keys are kept if their text is."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest key, and one row of it; null keys stay.

    A key names one document; its rows with equal texts are repetitions. Null and empty texts are in no group and stay.
    """
    groups = Scratch(spark, "near").table(shingle_join.join(docs), "groups")
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"] == gone["gone_id"], "left_anti")
    many = groups.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("many"))
    if many.isEmpty():
        return kept
    repeated = kept["doc_id"] == many["many"]
    several = kept.join(many, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(many, repeated, "left_anti").unionByName(several)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the text's length is counted anew; every row stays, null texts as they are."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the sources' target weights and shuffled. Null sources share the rest's weight; the
    rows of one key, and null keys, get one count each; a column ``n_copies``, ``copy_no`` or ``shuffle_key`` is replaced."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with checksums of their ids. A null or empty text is the closing id alone; each row is packed."""
    return packing.digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Compression, the field's tags and token ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return docs
