"""A corpus from documents to token ids: five stages, each on all that its predecessor kept.

Defined cases, for every stage: an empty table gives an empty one; columns beyond those of
documents pass through, whatever their names; texts of any length are taken whole. Null texts
have no words: the quality stage drops them. What else a stage does with nulls and repeated
rows, its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenloom.llm import minhash, mixing, pieces, quality_rules, substrings
from screenloom.llm.common import scratch, staged, table, words
from screenloom.sources.shared import delete, fresh_dir


def boxed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, ``row``: columns made beside it clash with none of the input's."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def unboxed(rows: DataFrame, names: list[str], **changed: str) -> DataFrame:
    """The columns of ``row`` again, some of them taken from columns beside it."""
    return rows.select(*[F.col(changed.get(c, f"row.{c}")).alias(c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or their host's verdict reject."""
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the smallest id.

    Rows that repeat an id are one document: the one with the smallest text stays. Rows without
    an id stay.
    """
    first = minhash.near_groups(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("first")).distinct()
    one = Window.partitionBy("row.doc_id").orderBy("row.text")
    kept = boxed(docs).join(first, F.col("row.doc_id") == F.col("first"), "left_semi").withColumn("nth", F.row_number().over(one))
    return kept.filter("nth = 1").select("row.*").union(docs.filter("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document that loses all keeps an empty text."""
    less = substrings.rewritten(docs).select(F.col("doc_id").alias("id"), "sig", "kept_text")
    met = boxed(docs).join(less, (F.col("row.doc_id") == F.col("id")) & (F.xxhash64("row.text") == F.col("sig")), "left")
    met = met.withColumn("less", F.coalesce("kept_text", "row.text"))
    chars = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("less")).cast("long")
    return unboxed(met.withColumn("chars", chars), docs.columns, text="less", n_chars="chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is taken; the last may be a part, its first words."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("sig")), carry=("sig",)).filter("taken > 0")
    nth = F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy(F.desc("taken")))
    mixed = mixed.select(F.col("doc_id").alias("id"), "sig", "size", "taken", nth.alias("nth"))
    which = F.row_number().over(Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("sig")) & (F.col("which") == F.col("nth"))
    met = boxed(docs).withColumn("which", which).join(staged(mixed, "mixed"), same)
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))
    met = met.withColumn("turn", turn)
    part = F.least(F.col("size"), F.col("taken") - (F.col("turn") - 1) * F.col("size"))
    cut = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), part.cast("int")), " ")
    met = met.withColumn("cut", F.when(part < F.col("size"), cut).otherwise(F.col("row.text")))
    chars = F.when(part < F.col("size"), F.length("cut")).otherwise(F.col("row.n_chars")).cast("long")
    return unboxed(met.withColumn("chars", chars), docs.columns, text="cut", n_chars="chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 of every row."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the sketches or the piece model; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again.

    What a stage staged is deleted when its rows stand, and these when the next stage's do.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
