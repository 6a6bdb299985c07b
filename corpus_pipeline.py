"""The corpus pipeline: quality rules, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgraph.llm.common import small, written
from newsgraph.llm.curve_packing import pack_along_curve
from newsgraph.llm.jaccard_join import near_duplicates
from newsgraph.llm.mixing import mix_sources
from newsgraph.llm.quality import judged_quality
from newsgraph.llm.queries import MIX_WEIGHTS, TOKENIZER
from newsgraph.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Word shingles and similarity of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` joined with decisions on (doc_id, text_key), null ids equal."""
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("text"))
    decisions = decisions.withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"})
    on = keyed["doc_id"].eqNullSafe(decisions["_doc"]) & (keyed["_key"] == decisions["_text"])
    return keyed.join(small(decisions, 48), on, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and blank texts have too few words and go; rows equal in id and
    text are judged alike and stay or go together, rows that share an id only
    are judged by their own text; null ids, languages and sources are values of
    their own. Ties of the estimates cannot change what one row gets.
    """
    judged = written(judged_quality(docs).where("not kept").select("doc_id", "text_key").distinct(), "rejected")
    return _decided(docs, judged, "left_anti").select(*COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id,
    once; documents without words or id are in no group and stay.

    Rows repeated with id and text are copies of each other. Of rows that share an
    id but not a text all go if one of them is a duplicate of a smaller id.
    """
    groups = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    once = docs.select(*COLUMNS).join(small(gone, 16), "doc_id", "left_anti")
    # rows repeated with their id are copies as well, if they have words
    again = once.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = written(again, "again")
    copies = once.join(small(again, 16), "doc_id", "left_semi")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit("")) == ""
    return once.join(small(again, 16), "doc_id", "left_anti").select(*COLUMNS).unionByName(
        copies.where(~blank).dropDuplicates(["doc_id", "text"]).select(*COLUMNS)).unionByName(copies.where(blank).select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A document that the mix takes n times is n equal rows; texts without words
    (null, empty, blank) are never taken. Rows equal in id and text share their
    copies evenly, what is left over goes to the first by all columns. Ties of the
    random keys are broken by id and text, so reruns agree.
    """
    mix = written(mix_sources(docs, MIX_WEIGHTS).groupBy("doc_id", "text_key").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix")
    # rows equal in id and text share their copies evenly
    rows = _decided(docs, mix, "inner")
    even = rows.withColumn("_n", F.expr("copies div rows"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(*COLUMNS))
    odd = rows.where("copies % rows > 0").withColumn("_turn", turn).where("_turn <= copies % rows").withColumn(
        "_n", F.lit(1))
    return even.select(*COLUMNS, "_n").unionByName(odd.select(*COLUMNS, "_n")).where("_n > 0").select(
        *COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the curve, one row per piece.

    Every row is packed, also repeated ones, null texts (the end id alone) and
    null ids; ties of the curve's key go by id, equal rows in any order.
    """
    return pack_along_curve(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_groups", near_duplicate_groups),
    ("source_mix", source_mix),
    ("packing", packing),
]
#: The robust estimates, the random keys and the tokens are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
