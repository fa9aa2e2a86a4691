"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. quality: documents that the additive classifier scores below 1/2 go.
2. lines: of equal and nearly equal lines only the earliest stays; documents of which no line stays go.
3. similar: of documents linked by their word shingles (Jaccard 3/4 or more) the one with the smallest id stays.
4. leaks: documents with a verbatim window of ten words of a benchmark item go.
5. tokens: the texts are encoded with a public tokenizer and decoded again.

Stages 1 to 4 return the columns of documents (n_chars follows a text that was cut). Null and empty texts pass as the
operators define; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import leaks, lines, pieces, similar
from gaugewright.llm import quality as classifier
from gaugewright.llm.common import table
from gaugewright.llm.tokenizer import TOKENIZER
from gaugewright.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(classifier.fold("doc_id", 3) == 1, F.lit(False))
    model = classifier.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return classifier.score(docs, model, name="_quality").filter("_quality >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedupe(docs).filter(~F.col("gone"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.tokenize(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, digests=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

#: A fitted classifier and a tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
