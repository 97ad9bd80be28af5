"""The corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, mixing to target weights, packing.

Every stage keeps null and empty texts (they are neither toxic nor copies of another, and pack as the end id alone), treats repeated rows as its
operator says, gives an empty table for an empty one, and leaves the columns of its input as they are, whatever their names.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the columns of ``documents``; the last returns the packed
pieces. ``run`` writes every stage's result to the shared folder and hands the table read from there to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import jaccard, mixing, packing, substrings, toxicity
from barwright.llm.common import stash, unused

#: SQL can express neither the fitted scores, nor the draws, nor the tokenizer.
ORACLE_SQL = None


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for the columns that an operator would replace, and those names."""
    clash = [c for c in docs.columns if c.lower() in made]
    names = dict(zip(clash, unused([*docs.columns, *made], *[f"{c}_" for c in clash]), strict=True))
    return docs.withColumnsRenamed(names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models score under 0.5. A text without words has the score of the rate of toxic texts; rows that repeat go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    own, names = _aside(docs, "score")
    return toxicity.score(own, model).filter("score < 0.5").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links connect, the one with the least doc_id; of equal rows one. Texts without words stay."""
    return jaccard.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; ``n_chars`` follows the text where it lost words. No row goes, even if all its words do."""
    own, names = _aside(docs, "n_words", "n_removed", "removed_spans")
    left = substrings.dedup(own)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, as often as the mix takes them; a null source is one of its own."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; other columns than doc_id and text end here."""
    return packing.pack(docs, specials_as_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
