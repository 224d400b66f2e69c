"""The corpus pipeline: civil documents, each line once, one of each near-duplicate group, mixed and packed.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame
with the columns of ``documents``; the last returns the packed pieces. ``run`` writes each result as
Parquet and reads it again for the next stage, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import compression_toxicity, fuzzy_lines, packing, pareto_mix, simhash_pivots
from keepsake.llm.common import table
from keepsake.session import settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance model, fitted on the labels, does not reject.

    Null and empty texts are scored like any other; null ids and repeated rows stay or go by their text. Empty: no rows.
    """
    return compression_toxicity.keep_civil(docs, compression_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each group of equal or fuzzily equal lines kept once in the corpus.

    Null texts stay null, emptied ones are ""; rows equal in id and text all stay, the first with its lines. Empty: no rows.
    """
    found = fuzzy_lines.drop_repeats(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, by the operator's own shingles and bits.

    Null and blank texts are one group; null ids are told apart by their text; of repeated rows one stays. Empty: no rows.
    """
    return simhash_pivots.keep_one(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; a null source is a source, null texts have size 0. Empty: no rows."""
    return pareto_mix.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are one piece, the end id. Empty: no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packed)]

#: No stage can be put in SQL: models trained here, XXH64 fingerprints, a tokenizer. Tests compare with loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
