"""A corpus from raw documents: language, lines, near copies, mix, sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; n_chars follows the text. Other columns go. Rows that share an id or
have none are documents of their own in every stage, texts are read whole, and an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import saved
from parchmint.llm.language import identify
from parchmint.llm.lines import dedup_lines
from parchmint.llm.mixing import mixed_rows
from parchmint.llm.packing import pack
from parchmint.llm.simhash import near_representatives

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL has neither the language model nor SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and those without a letter go. Repeated rows stay."""
    return identify(docs.select(*COLUMNS), keep_text=True).where("lang_pred <> 'und'").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that 10 of them share; a repeated row counts each time. Null text becomes empty."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles, by SimHash): the one with the smallest id, and of several with that id one by a hash of the row."""
    return near_representatives(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it takes it, so one may come twice, and none that it leaves; those without words go. A null source is one of its own."""
    return mixed_rows(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their places; see parchmint.llm.packing.pack."""
    import public_tokenizers as own

    return pack(docs, own.path("byte_bpe_50k.json"), own.path("byte_bpe_50k.tiktoken"), own.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
