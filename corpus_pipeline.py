"""A corpus pipeline; each stage works on all that the one before kept, written as Parquet and read again.

Stages, in order: documents that the quality classifier rejects go; of texts equal but for white space one stays; of documents that five-word
shingles link at 0.8 or more one stays; the rest is put in the order of the target mix; and is encoded.

Decisions are by row: rows that repeat a doc_id, or have none, stay or go each for its own text. Rows are told by their place in the
files that a stage reads. Null texts count as empty. Other columns pass through unchanged, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, mixing, ngram_join, quality
from corvane.llm.session import cut, scaled

MIX_PART_ROWS = 8_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the classifier's threshold or more; it is trained on labels that are not held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs but those whose number is in gone (row_id). Their columns are one struct meanwhile, so that no name can clash."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row"))
    return rows.join(gone, "row_id", "left_anti").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays: the one with most code points, then the smallest doc_id."""
    return without(docs, exact_dedup.dedup(docs).filter("not kept").select("row_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays."""
    return without(docs, ngram_join.row_groups(docs).filter("row_id <> keep_row").select("row_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order that gives each source its share of every stretch."""
    return mixing.in_mixed_order(docs, scaled(docs.count(), MIX_PART_ROWS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixed), ("BPE encoding", encoded)]
#: The classifier and the tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + "".join(x if x.isalnum() else "-" for x in name))
    return STAGES[-1][1](spark, docs, sf_dir)
