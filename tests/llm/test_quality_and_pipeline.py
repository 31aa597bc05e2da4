import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, docs, stored
from tests.llm.test_ngram_join import brute as brute_links
from tests.llm.test_ngram_join import corpus
from tests.llm.test_text_operators import brute_bpe, brute_dedup

import corpus_pipeline
from corvane.llm import quality

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = quality.op10_quality(spark, DATA).toPandas()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    known = got.merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    aside = known[known.held_out]
    assert (aside.predicted == aside.quality).mean() > 0.97
    assert ((aside.predicted == 0) & (aside.quality == 1)).sum() <= 0.01 * len(aside)
    assert np.mean((aside.score - aside.quality) ** 2) < 0.03


def bucket(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(quality._buckets(data, np.array([0, len(data)]))[0][0])


def test_vectors_and_pooling_by_brute_force(spark, monkeypatch):
    texts = AWKWARD[:-1] + ["a b a c", "The the THE b\tc\n d"] + ["hot copy of a text"] * 50
    places = quality.index_places()
    assert all(len(set(x)) == quality.NONZERO for x in places.tolist())
    words = [[x.lower() for x in re.split("[ \t\n\x0b\x0c\r]+", t or "") if x] for t in texts]
    code = {w: bucket(w) for w in {w for row in words for w in row}}
    sums = {}
    for row in words:
        for i, w in enumerate(row):
            for j in range(max(0, i - quality.WINDOW), min(len(row), i + quality.WINDOW + 1)):
                if i != j:
                    mine = sums.setdefault(code[w], np.zeros(quality.DIMENSIONS))
                    for k, at in enumerate(places[code[row[j]]]):
                        mine[at] += -1 if k % 2 else 1
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for k, x in sums.items():
        want[k] = x / max(np.linalg.norm(x), 1)
    frame = docs(spark, texts)
    got = quality.word_vectors(frame.repartition(5))
    assert np.allclose(got, want, atol=1e-6)
    monkeypatch.setattr(quality, "TASK_BYTES", 1_000)
    monkeypatch.setattr(quality, "FAN_IN", 2)  # a tree of several levels
    assert np.array_equal(got, quality.word_vectors(frame.repartition(40)))
    pooled = {x.doc_id: np.frombuffer(x.features, np.float32) for x in quality.document_features(frame.select("doc_id", "text"), got).collect()}
    for i, row in enumerate(words):
        vectors = np.array([want[code[w]] for w in row]).reshape(-1, quality.DIMENSIONS)
        brute = np.concatenate((vectors.mean(0), (vectors**2).mean(0) ** 0.5)) if row else np.zeros(quality.FEATURES)
        assert np.allclose(pooled[i], brute, atol=1e-4)


def test_labels_held_out_change_nothing(spark, tmp_path, sf_dir):
    rows, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.expr(quality.HELD_OUT), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.score_documents(rows, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(one.score, two.score)


@pytest.mark.parametrize("labelled", [[], [(2, 1), (3, 1)]])
def test_scores_without_both_labels(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    got = quality.score_documents(docs(spark, AWKWARD, [None, 3, 3, *range(4, len(AWKWARD) + 1)]), labels).collect()
    assert len(got) == len(AWKWARD) and {x.score for x in got} == {1.0}
    assert quality.score_documents(docs(spark, []), labels).collect() == []


def by_id(frame):
    return {x.doc_id: x.text for x in frame.collect()}


@pytest.mark.parametrize("case", ["sf", "made"])
def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path, case):
    folder = sf_dir
    if case == "made":
        folder = stored(spark, tmp_path, docs(spark, AWKWARD + corpus(3), sources=["a" if i % 3 else None for i in range(len(AWKWARD + corpus(3)))]).withColumn("digest", F.lit(1)).withColumn("slot", F.lit("x")))
        stored(spark, tmp_path, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), "labels")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    frames, current = [], table
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, current, folder)
        if name != names[-1]:
            assert frame.columns == table.columns
        frame.write.parquet(f"{tmp_path}/out-{len(frames)}")
        current = spark.read.parquet(f"{tmp_path}/out-{len(frames)}")
        frames.append(current)
    start, good, exact, near, mixed = map(by_id, (table, *frames[:4]))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    scores = quality.score_documents(table, labels).collect()
    assert set(good) == {x.doc_id for x in scores if x.predicted == 1} and good.items() <= start.items()
    assert set(exact) == {x[0] for x in brute_dedup(good.items()) if x[3]}
    assert set(near) == {x[0] for x in brute_links(exact.items()) if x[0] == x[2]}
    assert mixed == near and frames[3].count() == len(near)
    want = brute_bpe(mixed.items())
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in frames[4].collect()} == want
    assert {x.doc_id for x in corpus_pipeline.run(spark, folder).collect()} == set(want)


def test_pipeline_decides_by_row(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [long, long + " end", "of its own " * 9, "another one entirely " * 7, long.upper(), "some more words " * 5, long + "\n", None]
    frame = docs(spark, texts, [None, 5, None, 5, 9, 2**63 - 1, -(2**63), None]).withColumn("_gone", F.lit(1)).withColumn("row", F.lit(2)).withColumn("row_id", F.lit(3)).withColumn("keep_row", F.lit(4))
    folder = stored(spark, tmp_path, frame)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = lambda x: sorted((r.text or "", str(r.doc_id)) for r in x.collect())
    exact = corpus_pipeline.exact(spark, table, folder)
    assert exact.columns == table.columns
    assert kept(exact) == sorted((texts[i] or "", str(x)) for i, x in ((6, -(2**63)), (1, 5), (2, None), (3, 5), (4, 9), (5, 2**63 - 1), (7, None)))
    near = corpus_pipeline.near(spark, table, folder)
    assert near.columns == table.columns
    assert kept(near) == sorted((texts[i] or "", str(x)) for i, x in ((6, -(2**63)), (2, None), (3, 5), (5, 2**63 - 1), (7, None)))
    assert kept(corpus_pipeline.mixed(spark, table, folder)) == kept(table)
    assert len(corpus_pipeline.encoded(spark, table, folder).collect()) == len(texts)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, docs(spark, []))
    stored(spark, tmp_path, spark.createDataFrame([], "doc_id long, quality int"), "labels")
    assert corpus_pipeline.run(spark, folder).collect() == []
