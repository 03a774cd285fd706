"""A corpus for training from the documents table, in five stages.

language: documents without a letter of any script, or hardly like any language learnt, go.
near_copies: of documents that are near copies (words in fives, 0.8) the first one stays.
repeats: passages of 200 bytes that occur again are cut out; documents left empty go.
mixing: sources are mixed to weights; a document comes as often as the mix takes it.
tokens: every text as SentencePiece ids, with proof that they decode.

Nulls: a null text goes in the first stage. A null doc_id is no reason to go; such rows are
no near copies of others. Of repeated rows one stays. An empty table gives an empty corpus.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopmeter.llm import language_id
from shopmeter.llm.common import held_out
from shopmeter.llm.mixing import mix
from shopmeter.llm.near_copies import near_copies
from shopmeter.llm.queries import model_file
from shopmeter.llm.repeats import repeats
from shopmeter.llm.sentencepiece_codec import encode_decode
from shopmeter.session import shared_folder

#: Share of a text's n-grams that its language must explain.
LEAST_LANGUAGE = 0.2


def _carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: all columns but the text travel in ``row``, so that no name of theirs can clash."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from ``text`` and ``row``."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language_id.learn(docs.filter(~held_out()))
    named = language_id.identify(_carried(docs), filters, carry=("text", "row"))
    fits = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return named.filter(fits).select(*_columns(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = near_copies(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "row.source", "row.lang", "row.n_chars"))
    kept = _carried(docs).join(first, "doc_id", "left_semi").withColumn("turn", once).filter("turn = 1")
    return kept.select(*_columns(docs)).unionByName(docs.filter("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats(_carried(docs), characters=True, carry=("row",))
    text = F.col("kept").cast("string")
    left = cut.filter((F.col("n_bytes") == 0) | (F.length(text) > 0))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_decode(docs, model_file("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [("language", language), ("near_copies", copies), ("repeats", passages), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither learnt languages nor SentencePiece; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
