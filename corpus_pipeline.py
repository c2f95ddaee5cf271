"""The corpus pipeline over ``documents``: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents (COLUMNS);
other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The model learns from labelled documents of the stage's input, at
    most from as many as `learn` takes (20,000); null and empty texts are kept."""
    from folioflow.llm.toxicity import learn, toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, F.lit(True))
    bad = toxicity(docs, model).where("score >= 0.5").select(F.col("doc_id").alias("t_doc"), F.col("rid").alias("t_rid")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("t_rid"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id has; n_chars follows the text."""
    from folioflow.llm.linededup import drop_repeated_lines

    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of five-word shingles with a similarity
    of 0.8 or more connect."""
    from folioflow.llm.jaccard import keep_first

    return keep_first(docs, n=5, num=80, den=100).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item of ``benchmark`` aligns with half of its full score or more."""
    from folioflow.llm.decontam import find_contamination

    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select(F.col("doc_id").alias("b_doc"), F.col("rid").alias("b_rid")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("b_rid"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    from folioflow.llm.packing import pack, token_pieces

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the model, the alignment or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what lies between them goes to the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
