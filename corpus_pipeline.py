"""The corpus pipeline: quality classifier, exact dedup, near-dedup, passage
removal, packing. Each stage takes (spark, docs, sf_dir) and returns a table that
is written as Parquet and read again as the next stage's docs; all but the last
return the columns of documents.

A null text counts as empty everywhere; an empty table gives an empty result; extra
columns are carried along, whatever they are called. A stage leaves the tables that
its result reads in the checkpoint folder; ``run`` deletes them once the result has
been written. The last stage's result is lazy, so its tables stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import exact_dedup, minhash, packing, quality, scratch, substring
from bandwise.llm.queries import tokenizer_file

PASSAGE_WORDS = 50


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the language model does not reject. Texts without words, and rows
    of a language without a limit, stay; repeated rows share one verdict."""
    names = docs.columns
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner = [f"c{i}" for i in range(len(names))]
    return judged.toDF("perplexity", "passes", *inner).where("passes").select(*inner).toDF(*names)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id, one of
    them where that row is repeated. Null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), the one
    with the smallest id. Texts without words and rows without an id stay."""
    return minhash.drop_near_duplicates(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE_WORDS words or more that an earlier
    document has; a document of which nothing is left goes, one that had no words
    stays. Of equal ids the earlier row counts as earlier. ``n_chars`` follows the
    text where it is cut."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    out = substring.remove_passages(docs, window=PASSAGE_WORDS, layout=True).toDF("words", "removed", *inner)
    out = out.where("removed = 0 OR removed < words")
    if "n_chars" in names:
        text, chars = inner[names.index("text")], inner[names.index("n_chars")]
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(chars, F.when(F.col("removed") > 0, F.char_length(text).cast(kind)).otherwise(F.col(chars)))
    return out.select(*inner).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; an empty text is its end id alone."""
    return packing.digests(packing.pack(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

# The Kneser-Ney model, MinHash and the tokenizer are beyond SQL; tests hold the
# pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch.recording() as made:
            path = scratch.stage_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
        scratch.delete(spark, made)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
