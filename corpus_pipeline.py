"""The corpus pipeline: stages over documents, each of one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, read
again from Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import jaccard, language, packing, pii, repeats
from loamgraph.llm._common import crc32_mod, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, empty or no letter); the others get the predicted one as their lang, or keep their own where nothing could be learned."""
    training = docs.filter(~F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)))
    out = language.identify(docs, training, keep=("text", "lang", "source", "n_chars"))
    known = F.col("lang_pred") != language.UNDETERMINED
    out = out.filter(known | F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return out.withColumn("lang", F.when(known, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group. Rows that share a doc_id are one document; those with none stay."""
    found = jaccard.near_duplicates(docs)
    others = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("first")).filter(~F.col("first")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of repeats.PASSAGE bytes or more, some 40 words, that occur again out of the texts; half characters at the cuts become replacement characters, null texts empty."""
    out = repeats.remove(docs, repeats.PASSAGE, keep=("doc_id", "lang", "source", "n_chars"))
    return _counted(out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts."""
    return _counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens: a row for each piece."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("repeats", remove_repeats), ("pii", sanitise), ("packing", pack)]
#: Language models, components, byte strings and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
