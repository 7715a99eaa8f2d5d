"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage works on all rows that the one before it kept, as Parquet that was
written and read again.  All stages but the last return the columns of ``documents``:
the first three keep or drop whole rows, the fourth rewrites texts.

Defined results, for every stage: a null text counts as empty, is never toxic,
contaminated or a copy, and stays null; rows with a null id are kept by the second
stage; repeated rows are one class and one of them stays; an empty table gives an
empty one; other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontamination, ngram_join, packing, pii, toxicity
from quillgrid.llm.shared import stage

#: Trained classifiers and tolerant matches are not expressible in SQL; tests/llm/test_pipeline.py holds each stage
#: against a brute-force version.
ORACLE_SQL = None


def _bounded(spark: SparkSession) -> None:
    """The pipeline's session moves texts in Arrow batches of 1,000 rows or 4 MB at most: its stages are run after they have returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    _bounded(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # under names of their own, as the documents may have a column toxic
    names = [f"c{n}" for n in range(len(docs.columns))]
    scored = toxicity.score(docs.toDF(*names), model, text=names[docs.columns.index("text")])
    return scored.filter("toxic = 0").select(*names).toDF(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row, with the smallest id; rows without an id stay."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    _bounded(spark)
    return decontamination.drop_overlapping(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets; n_chars, where there is one, is counted again."""
    _bounded(spark)
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length in words, bucket, batch and place in it."""
    return packing.pack(docs.select("doc_id", packing.word_length().alias("length")))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram join", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_lengths),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
