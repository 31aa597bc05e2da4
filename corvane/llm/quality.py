"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Each word bucket has a sparse random index vector (as many +1 as -1, at places that differ). A word's vector is the sum of the index vectors of the words
up to WINDOW places beside it, over all documents, scaled to length one. A document is the mean and the root mean square of its words' vectors, and nothing
else. A network with one hidden layer, in numpy, is fitted on labelled documents; its logit is divided by a temperature that is fitted on a part
of them kept aside.

Sums of contexts are made in map tasks of TASK_BYTES of text each and added up in a tree, FAN_IN partial sums to a task, so that neither the traffic nor a task
grows faster than the input; the vectors have a fixed size.

Inputs of a score come from the text alone. Null text counts as empty; an empty text has zero vectors and gets a score as any other.
Repeated rows get equal scores. Without labels of both kinds, the score is the share of label 1 (1.0 without labels).
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.session import documents, scaled
from corvane.llm.textops import U, mix, text_chunks, word_hashes

BUCKETS = 1 << 15
DIMENSIONS = 128
#: Nonzero places of an index vector, and how far a context reaches to either side.
NONZERO = 4
WINDOW = 2
BLOCKS = 16
TASK_BYTES = 256 << 20
FAN_IN = 64
CHUNK = 256 << 10
#: Bound of the sample of labelled documents that the network is fitted on: those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
HIDDEN = 32
THRESHOLD = 0.7
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)"

FEATURES = 2 * DIMENSIONS


def index_places(buckets: int = BUCKETS) -> np.ndarray:
    """The places of each bucket's index vector, all different; +1 and -1 in turn."""
    hashes = mix(mix(np.arange(buckets, dtype=U), 7)[:, None] ^ mix(np.arange(DIMENSIONS, dtype=U), 8)[None, :], 9)
    return np.argpartition(hashes, NONZERO, axis=1)[:, :NONZERO].astype(np.int64)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets, and row offsets of words."""
    words, rows = word_hashes(data, offsets)
    return (words >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64), rows


def add_contexts(total: np.ndarray, word: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
    """Adds to total (buckets x dimensions, flat) the index vectors of all words beside each word of the same row."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs = []
    for d in range(1, WINDOW + 1):
        together = owner[d:] == owner[:-d]
        left, right = word[:-d][together], word[d:][together]
        pairs += [(left, right), (right, left)]
    of, beside = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if len(of):
        for k in range(NONZERO):
            found = np.bincount(of * DIMENSIONS + places[beside, k])
            if k % 2:
                total[: len(found)] -= found
            else:
                total[: len(found)] += found


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, places = np.zeros(BUCKETS * DIMENSIONS, np.int64), index_places()
    for batch in batches:
        for _, data, offsets in text_chunks(batch.column("text")):
            add_contexts(total, *_buckets(data, offsets), places)
    yield _blocks(dict(enumerate(total.reshape(BLOCKS, -1))), TaskContext.get().partitionId())


def _blocks(parts: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    raw = [x.astype("<i4").tobytes() if np.abs(x).max(initial=0) < 2**31 else x.astype("<i8").tobytes() for x in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array(raw, pa.binary())], names=["block", "salt", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    """Sums of partial blocks as they come: memory for the blocks of a task, whatever their number of parts."""
    size, total = BUCKETS * DIMENSIONS // BLOCKS, {}
    for batch in batches:
        for block, salt, raw in zip(*(batch.column(k).to_pylist() for k in ("block", "salt", "sums")), strict=True):
            mine = total.setdefault((block, salt), np.zeros(size, np.int64))
            mine += np.frombuffer(raw, "<i4" if len(raw) == 4 * size else "<i8")
    return total


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (block, salt), x in _added(batches).items():
        yield _blocks({block: x}, salt)


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (block, _), x in _added(batches).items():
        x = x.reshape(-1, DIMENSIONS)
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "vectors"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all word buckets. Their size is fixed: buckets x dimensions."""
    spark = docs.sparkSession
    schema = "block int, salt int, sums binary"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = scaled(total, TASK_BYTES, spark.sparkContext.defaultParallelism)
    sums = docs.select("text").coalesce(parts).mapInArrow(_context_sums, schema)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("salt", F.expr(f"salt % {parts}")).repartition(BLOCKS * parts, "block", "salt").mapInArrow(_add_up, schema)
    found = sums.withColumn("salt", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(_unit_vectors, "block int, vectors binary").collect()  # BLOCKS rows
    rows = {x.block: np.frombuffer(x.vectors, "<f4") for x in found}
    return np.concatenate([rows.get(k, np.zeros(BUCKETS * DIMENSIONS // BLOCKS, np.float32)) for k in range(BLOCKS)]).reshape(BUCKETS, DIMENSIONS)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each row of a chunk: the mean and the root mean square of its words' vectors."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    word, rows = _buckets(data, offsets)
    count = np.diff(rows)
    having = count > 0
    if not len(word):
        return out
    first, per = rows[:-1][having], count[having, None].astype(np.float32)
    each = vectors[word]
    out[having, :DIMENSIONS] = np.add.reduceat(each, first) / per
    np.square(each, out=each)
    out[having, DIMENSIONS:] = np.sqrt(np.add.reduceat(each, first) / per)
    return out


def document_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """docs' other columns and features (float32) for each row. The vectors go along as a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    others = [x for x in docs.schema if x.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.tobytes() for _, data, offsets in text_chunks(batch.column("text"), CHUNK) for x in pooled(data, offsets, shared.value)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in others), pa.array(made, pa.binary())], names=[*(x.name for x in others), "features"])

    schema = docs.select(*(x.name for x in others), F.lit(b"").alias("features")).schema
    return docs.mapInArrow(run, schema)


class Network:
    """Two layers and a temperature."""

    def __init__(self, share: float = 1.0):
        self.mean = self.scale = None
        self.share, self.temperature = share, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> "Network":
        net = cls(float(y.mean()) if len(y) else 1.0)
        if len(np.unique(y)) < 2 or len(y) < 10:
            return net
        rng = np.random.default_rng(seed)
        y = y.astype(np.float64)
        order = rng.permutation(len(y))
        aside, used = order[: max(2, len(y) // 5)], order[max(2, len(y) // 5) :]
        net.mean, net.scale = x[used].mean(0, dtype=np.float64), x[used].std(0, dtype=np.float64) + 1e-3
        net.w1, net.b1 = rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        net.w2, net.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        x_aside = x[aside].astype(np.float64)
        state = {k: (0.0, 0.0) for k in ("w1", "b1", "w2", "b2")}
        z = x - net.mean.astype(np.float32)  # the sample is held twice, in single precision
        z /= net.scale.astype(np.float32)
        best, kept, step = np.inf, None, 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
                step += 1
                pre = z[batch] @ net.w1 + net.b1
                hidden = np.maximum(pre, 0)
                delta = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40))) - y[batch]) / len(batch)
                back = np.outer(delta, net.w2) * (pre > 0)
                slopes = {"w1": z[batch].T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": hidden.T @ delta + 1e-4 * net.w2, "b2": delta.sum(keepdims=True)}
                for k, g in slopes.items():
                    m, v = 0.9 * state[k][0] + 0.1 * g, 0.999 * state[k][1] + 0.001 * g * g
                    state[k] = (m, v)
                    setattr(net, k, getattr(net, k) - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            now = net.loss(x_aside, y[aside], 1.0)
            if now < best:
                best, kept = now, {k: getattr(net, k).copy() for k in state}
        for k, v in kept.items():
            setattr(net, k, v)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        net.temperature = float(grid[np.argmin([net.loss(x_aside, y[aside], t) for t in grid])])
        return net

    def loss(self, x: np.ndarray, y: np.ndarray, temperature: float) -> float:
        z = self.logit(x) / temperature
        return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_labelled: int = MAX_LABELLED) -> Network:
    """Fits on labelled rows that are not held out; the labels are read from no other rows."""
    known = labels.filter(f"not ({HELD_OUT}) and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows at most
    rows = document_features(texts, vectors).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_labelled).select("features", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b"".join(batch.column("features").to_pylist()), batch.column("quality").to_numpy()) for batch in batches]
        x = np.frombuffer(b"".join(raw for raw, _ in held), np.float32).reshape(-1, FEATURES)
        y = np.concatenate([y for _, y in held]) if held else np.zeros(0)
        yield pa.RecordBatch.from_pydict({"network": pa.array([pickle.dumps(Network.fit(x, y))], pa.binary())})

    # a sample of fixed size is one task's; what comes to the driver is the network alone
    return pickle.loads(rows.repartition(1).mapInArrow(run, "network binary").first()[0])


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, and the network."""
    vectors = word_vectors(docs)
    return vectors, fit(docs, labels, vectors)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    vectors, net = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(_scores(batch, shared.value, net), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def _scores(batch: pa.RecordBatch, vectors: np.ndarray, net: Network) -> np.ndarray:
    parts = [net.score(pooled(data, offsets, vectors)) for _, data, offsets in text_chunks(batch.column("text"), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that score the threshold or more. A narrow stage after training."""
    vectors, net = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, shared.value, net) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
