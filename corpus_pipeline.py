"""A corpus pipeline: language, near copies, benchmark passages, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs them
writes each result as Parquet and reads it as the next one's docs.  All but the
last return the columns of documents.  Null and empty texts: the language stage
drops them (they have no language).  Repeated and null ids: near copies are
dropped by row, so rows of one id both stay where their texts are no copies.
Very long texts are read whole by every stage.  Ties: languages go by name, and
of near copies the smallest id stays, then the smallest hash of the row.  An
empty table gives an empty one.  Other columns pass through whatever their names,
but for copy and mix_key, which the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import decontam, jaccard, langid, mixing, pii
from trailframe.llm.common import fresh, shared_path, table, written
from trailframe.llm.registry import PII_KEY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the network knows."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest id, null last, then the smallest hash of the row.

    Rows are told apart by a hash of all columns, as ids may be repeated or null.
    """
    row = fresh("row", docs.columns)
    other = fresh("other", [*docs.columns, row])
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    ids = keyed.select(F.col(row).alias("_r"), F.col("doc_id").alias("_id")).distinct()
    found = jaccard.jaccard_join(keyed, id_col=row).where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    named = written(found.join(ids, F.col("doc_id") == F.col("_r")).select("_r", "_id", "component_id", "n"), "copies")
    first = named.groupBy(F.col("component_id").alias("_group")).agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_r")).alias("b")).select("_group", F.col("b._r").alias("_kept"))
    placed = named.join(first, F.col("component_id") == F.col("_group"))
    same = F.col(row) == F.col(other)
    single = keyed.join(placed.where("_r <> _kept or n > 1").select(F.col("_r").alias(other)), same, "left_anti")
    # equal rows have one hash: only these are brought together
    equal = keyed.join(placed.where("_r = _kept and n > 1").select(F.col("_r").alias(other)), same, "left_semi").dropDuplicates([row])
    return single.union(equal).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of the same format; n_chars follows the text."""
    made = pii.pseudonymize(docs, PII_KEY).withColumn("text", F.col("pii_text")).withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("pseudonyms", pseudonymize),
    ("mix", mix_sources),
]
#: The network of the first stage has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
