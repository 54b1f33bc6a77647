"""The registered query of each operator over its whole table, and DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staywise.llm import alignment, bpe, decontam, htmltext, langid, lexical, licenses, linededup, mixing, secrets, simhash, topk, vectordedup
from staywise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best matches of every twentieth vector among all others."""
    return topk.search(table(spark, folder, "embeddings", "vec_id", "embedding"))


ORACLES["op1_top_k"] = topk.ORACLE


@_query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digests(table(spark, folder, "documents", "doc_id", "text"))


@_query
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License of every document: stated in it, or inherited from a licence file above it."""
    return licenses.documents(table(spark, folder, "documents", "doc_id", "text", "source", "lang"))


ORACLES["op3_licenses"] = licenses.ORACLE


@_query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    return langid.identify(table(spark, folder, "documents", "doc_id", "text", "lang"))


@_query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and decoded bytes of every document, as digests."""
    return bpe.digests(table(spark, folder, "documents", "doc_id", "text"), bpe.read_ranks(tokenizer_path()))


@_query
def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, folder, "pages", "page_id", "url", "html"))


@_query
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of near copies of every vector."""
    return vectordedup.groups(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@_query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    return simhash.groups(table(spark, folder, "documents", "doc_id", "text"))


@_query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mixture takes every document."""
    return mixing.mixture(table(spark, folder, "documents", "doc_id", "text", "source"))


@_query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document once later similar lines are gone."""
    return linededup.digests(table(spark, folder, "documents", "doc_id", "text"))


ORACLES["op9_line_dedup"] = linededup.ORACLE


@_query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers of every document."""
    return alignment.alignment(
        table(spark, folder, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


@_query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


ORACLES["op12_lexical_search"] = lexical.ORACLE


@_query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    return decontam.digests(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


ORACLES["op13_decontamination"] = decontam.ORACLE
