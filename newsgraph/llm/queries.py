"""The registered queries of this subpackage, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm import oracles
from newsgraph.llm.common import read_table
from newsgraph.staging import new_path

TOKENIZER = "byte_bpe_50k.json"

#: (verdict, host, path)
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIX_WEIGHTS = (5, 2, 1)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices with edits in every document."""
    from newsgraph.llm.license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and allow decisions on every page, carried over its aliases."""
    from newsgraph.llm.url_aliases import judge_pages

    return judge_pages(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every document."""
    from newsgraph.llm.quality import judged_quality

    return judged_quality(read_table(spark, sf_dir, "documents")).drop("text_key")


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along a Hilbert curve, one row per piece."""
    from newsgraph.llm.curve_packing import pack_along_curve
    from newsgraph.llm.tokens import tokenizer_path

    return pack_along_curve(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    from newsgraph.llm.token_files import round_trip
    from newsgraph.llm.tokens import tokenizer_path

    return round_trip(read_table(spark, sf_dir, "documents"), new_path(spark, "token-files"), tokenizer_path(TOKENIZER))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, indexed in one order and read back through the index."""
    from newsgraph.llm.warc_index import archive_round_trip

    return archive_round_trip(read_table(spark, sf_dir, "pages"), new_path(spark, "warc")).drop("captured_at")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query, by search in the neighbour graph."""
    from newsgraph.llm.nn_descent import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    from newsgraph.llm.histogram_sharding import histogram_shards

    return histogram_shards(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix of all sources takes."""
    from newsgraph.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with three-word shingle sets 90 percent alike."""
    from newsgraph.llm.jaccard_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, threshold=90)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of a language, and the terms each stands out by."""
    from newsgraph.llm.divergence import source_divergence

    return source_divergence(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all frequent words, with the contract's slips of the pen."""
    from newsgraph.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"), slip=199)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, as a digest."""
    from newsgraph.llm.personal_data import personal_data, span_digest

    return span_digest(personal_data(read_table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_url_aliases, op3_quality_outliers, op4_curve_packing, op5_token_files, op6_warc_index,
    op7_nn_descent, op8_histogram_sharding, op9_weighted_mix, op10_jaccard_join,
    op11_source_divergence, op12_spelling_variants, op13_personal_data, pipeline)}

#: SQL of the queries that SQL expresses.
ORACLES: dict[str, str] = {
    "op6_warc_index": oracles.WARC_INDEX,
    "op10_jaccard_join": oracles.JACCARD_JOIN,
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op12_spelling_variants": oracles.SPELLING_VARIANTS,
    "op13_personal_data": oracles.PERSONAL_DATA,
}
