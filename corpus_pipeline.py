"""From raw documents to tokens: language, repeated lines, near copies, mixture, tokens.

Each stage gets all documents that the one before it kept, and writes what it keeps as Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm import bpe, langid, linededup, mixing, simhash
from staywise.llm.common import ensure_checkpoint_dir, materialize, packed
from staywise.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; what the language model rejects goes."""
    model = langid.train(docs.where(~langid.held_out()))
    rows = packed(docs).select("_row", "_row.doc_id", "_row.text")
    return langid.predict(rows, model, carry=("_row",)).where("not rejected").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; n_chars follows."""
    cleaned = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def identified(docs: DataFrame, equal: bool = True) -> DataFrame:
    """Rows (_row, _key, _name): each row with an identity of its own. _key is ordered by doc_id, null last.

    Where a doc_id repeats or is null, rows are told apart by their content and, if ``equal``, those that are equal in
    all columns by a number; otherwise one of them stands for all. These rows are written once.
    """
    rows, own = packed(docs), F.col("_row.doc_id")
    repeated = materialize(
        docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    )

    def keyed(frame: DataFrame, name, content, number) -> DataFrame:
        order = F.struct(own.isNull().alias("none"), own.alias("id"), content.alias("content"), number.cast("long").alias("number"))
        return frame.select("_row", order.alias("_key"), name.alias("_name"))

    if repeated.isEmpty() and docs.where("doc_id is null").isEmpty():
        return keyed(rows, own.cast("string"), F.lit(""), F.lit(0))
    single = rows.where(own.isNotNull()).join(repeated, own == F.col("_id"), "left_anti")
    unclear = rows.where(own.isNull()).unionByName(rows.join(repeated, own == F.col("_id"), "left_semi"))
    told = materialize(
        unclear.groupBy("_row").count().withColumn("_content", F.sha2(F.to_json("_row", {"ignoreNullFields": "false"}), 256))
    )
    if equal:
        told = told.withColumn("_number", F.explode(F.sequence(F.lit(1), "count"))).repartition("_content", "_number")
    else:
        told = told.withColumn("_number", F.lit(1))
    name = F.concat_ws("\0", own.cast("string"), "_content", F.col("_number").cast("string"))
    return keyed(single, own.cast("string"), F.lit(""), F.lit(0)).unionByName(keyed(told, name, F.col("_content"), F.col("_number")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id (null last), of each group of near copies, whatever ids repeat."""
    rows = identified(docs, equal=False)  # rows equal in all columns are copies
    found = simhash.near_duplicates(rows.select("_key", "_row.text"), key="_key")
    others = found.where("_key <> component").select(F.col("_key").alias("_other"))
    return rows.join(others, F.col("_key") == F.col("_other"), "left_anti").select("_row.*").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; each row counts for itself, whatever ids repeat."""
    rows = identified(docs)
    planned = mixing.plan(rows.select("_name", "_row.text", "_row.source"), key="_name")
    return mixing.repeat(rows, planned, key="_name").select("_row.*").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left."""
    return bpe.digests(docs, bpe.read_ranks(tokenizer_path()))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: Trained language models, fingerprints and tokens have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")  # written whole: lost executors repeat nothing before it
    return docs
