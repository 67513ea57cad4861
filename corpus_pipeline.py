"""A corpus pipeline of five stages, each one calling an operator of quorate.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
The first four keep or drop whole documents, or rewrite their texts, and return the columns of documents; the last one
returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.llm import decontaminate, langid, minhash, packing, pii
from quorate.llm.common import Scratch, checkpointed, free_name


#: Least similarity to the best language profile that a document of any known language is expected to have.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter in it, or letters that are far from every profile.

    Repeated rows are decided alike; no rows give no rows.
    """
    back = {free_name(docs, c): c for c in ("lang_pred", "score") if c in docs.columns}
    guessed = langid.predict(docs.withColumnsRenamed({c: n for n, c in back.items()}), langid.learn(docs))
    return guessed.where(f"lang_pred <> 'und' AND score >= {LEAST_SCORE}").drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates; rows without words all stay.

    Of repeated rows one stays; no rows give no rows.

    Row numbers follow the file splits of a scan, which may differ from scan to scan, so they are drawn once and kept.
    """
    # stays after this call like a checkpoint, as what is returned is read from it
    rid = free_name(docs, "rid")
    numbered = Scratch(spark, "numbered").table(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = minhash.near_duplicates(numbered, rid_col=rid)
    alone = F.when(F.col("n_shingles") == 0, F.col("rid"))  # not a group
    first = found.where("kept").withColumn("r", F.row_number().over(W.partitionBy("component_id", alone).orderBy("rid"))).where("r = 1")
    return numbered.join(first.select(F.col("rid").alias(rid)), rid, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; texts without words hold none. An empty benchmark drops nothing."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind and counts the characters again. Null and empty texts stay as they are."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left; an empty text is packed as its end, no rows give no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Tokenisation, sketches and profiles are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what one stage returns is checkpointed for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
