"""Small tables with the awkward cases that every operator meets."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType())])


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS)


def stored(spark, tmp_path, frame, name="documents"):
    """Writes a table into a folder as queries read it."""
    frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


AWKWARD = [None, "", " \n\t", "a", "A", "one two three four", "one two three four five", "ONE two\tthree four  five six", "é 中文 😀 ß", "x" * 30_000, "word " * 9_000, "same text here again and again", "same text here again and again", " same text here again and again ", "<|endoftext|> in <|endoftext|>text", "a\x00b\x1c c  d"]
