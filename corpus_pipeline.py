"""The corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import tables
from plumbline.llm import jaccard, language, packing, quality, suffix
from plumbline.session import attach


#: Share of a text's letters that its language must label.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and such as are of no one language; ``lang`` becomes the language found.

    Rejected are texts that are null or without a letter (``und``), and those of whose letters no language has
    ``LEAST_SHARE``. The model learns from non-null ``lang`` of two thirds of the ids; without any such row nothing can be
    told, so texts with a letter stay as they are. Null ids, repeated rows, empty tables and further columns pass through; one pass, no join.
    """
    attach(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
    model = language.fit(docs.where(~held_out))
    if not model["names"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.annotate(docs, model)
    kept = found.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("__lang_pred")).select(docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that fail the rules and drops the documents rejected; ``n_chars`` follows the text.

    Null and empty texts are rejected; null ids, repeated rows, empty tables and further columns pass through.
    """
    judged = quality.clean(docs).where("kept")
    made = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates: five-word shingles, Jaccard of 0.8 or more.

    Texts without words and null ids are in no group and stay. Rows that share an id are one document and stay or go together.
    """
    attach(spark)
    gone = jaccard.components(docs, jaccard.JaccardConfig(shingle=5, percent=80)).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    # the same plan at every size: a few ids would be broadcast, many not
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte stretches of 50 or more that a document of smaller id has; documents with nothing left go.

    A character that a cut goes through goes whole. Null and empty texts go; null ids lose nothing and take no part; rows that share an id don't cut one another.
    """
    attach(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *others).alias("__row"))
    cut = suffix.cut_text(suffix.find(rows))
    made = {"doc_id": F.col("doc_id"), "text": F.col("__cut"), "n_chars": F.length("__cut").cast("long")}
    return cut.where(F.length("__cut") > 0).select(*[made[c].alias(c) if c in made else F.col("__row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place: every row packed, whatever its id, an empty table giving none."""
    attach(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("quality", clean_lines),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = tables.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            tables.drop_tables(spark, before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the language model and the suffix array; tests/llm replays the five stages by brute force.
ORACLE_SQL = None
