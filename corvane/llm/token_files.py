"""Token-id files: one concatenated id array a shard, with document boundaries in Elias-Fano code.

A shard holds a range of doc_ids. Its header is followed by the Elias-Fano coded doc_ids, the Elias-Fano coded start offsets
(one more than documents, so that select(i) and select(i + 1) bound document i), and the ids in the narrowest
unsigned type that holds the vocabulary. A boundary costs about 2 + log2(ids / documents) bits, not 64.

Texts are encoded where they are read, and only their ids move: to parts, which are ranges of doc_id with about as many documents each. A part
is sorted by doc_id and written as one shard after another of bounded size, so that memory does not depend on the part. Rows of one doc_id that
are more than a part's share (null ones, say) are dealt over the parts that the id spans.

Shards are written by the tasks themselves, under a name of the attempt's own, which the manifest gives: an attempt that dies leaves files that no
manifest names, and nothing is renamed or overwritten. They are read with Spark's binaryFile source, document by document through select.

Null text counts as empty and has the end id only. Rows are in ascending doc_id order, null ids first;
rows with equal doc_id follow each other in any order. Other columns are not read. An empty table writes no documents and reads none.
"""

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import default_vocabulary, encoder, slices
from corvane.llm.session import cut, documents, new_folder, scaled

MAGIC = b"CVTK"
#: magic, version, bytes an id, documents, ids, documents without id at the start, first doc_id, bytes of the two codes
HEADER = struct.Struct("<4sHHQQQqQQ")
END_ID = 0
#: Ids after which a shard is closed.
SHARD_IDS = 8 << 20
PART_BYTES = 16 << 20
#: Leaves of long texts; here ids matter and not how they come about.
LEAF_CHARS = 1 << 16
SAMPLE = 128


class EliasFano:
    """A nondecreasing sequence of nonnegative integers: low bits packed, high bits in unary, select by samples."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Value i: the unary part is searched from the sample before it, 64 bits at a time."""
        at, want = int(self.samples[i // SAMPLE]), i % SAMPLE
        start = at // 8
        bits = int.from_bytes(self.high[start : start + 8].tobytes(), "little") >> (at % 8) << (at % 8)
        while (n := bits.bit_count()) <= want:
            want, start = want - n, start + 8
            bits = int.from_bytes(self.high[start : start + 8].tobytes(), "little")
        for _ in range(want):
            bits &= bits - 1
        one = start * 8 + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> (first % 8)
        return ((one - i) << self.low_bits) | low & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def dump(self) -> bytes:
        return self.HEAD.pack(self.n, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, raw: memoryview) -> "EliasFano":
        n, n_high, low_bits = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        n_low = (n * low_bits + 7) // 8
        low, high = np.frombuffer(raw, np.uint8, n_low, at), np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<u8", -(-n // SAMPLE), at + n_low + n_high))


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """doc_ids: ascending, None first."""
    no_id = sum(x is None for x in doc_ids)
    named = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(named[0]) if len(named) else 0
    names = EliasFano.encode((named - first).astype(np.uint64)).dump()
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    bounds = EliasFano.encode(starts).dump()
    body = np.concatenate(ids).astype(f"<u{width}").tobytes() if ids else b""
    return HEADER.pack(MAGIC, 1, width, len(ids), int(starts[-1]), no_id, first, len(names), len(bounds)) + names + bounds + body


class Shard:
    """A shard's content; ids(i) needs two selects and no table of offsets."""

    def __init__(self, raw: bytes):
        magic, version, width, self.n, self.n_ids, self.no_id, self.first, a, b = HEADER.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        view, at = memoryview(raw), HEADER.size
        self.names, self.bounds = EliasFano.load(view[at : at + a]), EliasFano.load(view[at + a : at + a + b])
        self.body = np.frombuffer(raw, f"<u{width}", self.n_ids, at + a + b)

    def ids(self, i: int) -> np.ndarray:
        return self.body[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.no_id + (self.names.values().astype(np.int64) + self.first).tolist()


def _target(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def part_bounds(docs: DataFrame, parts: int) -> tuple[int, list[int]]:
    """The number of parts for null ids, and the last doc_id of each other part but the last one: fewer numbers than parts, from the id column alone."""
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    if not counts["n"]:
        return 0, []
    for_null = math.ceil(parts * (counts["n"] - counts["named"]) / counts["n"])
    others = max(1, parts - for_null)
    if others == 1 or not counts["named"]:
        return for_null, []
    at = [k / others for k in range(1, others)]
    return for_null, docs.agg(F.percentile_approx("doc_id", at, 4 * others)).first()[0]


def encoded(docs: DataFrame, parts: int, vocabulary: str) -> DataFrame:
    """part, doc_id, ids (binary, with the end id) of each row of docs."""
    for_null, bounds = part_bounds(docs, parts)
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, LEAF_CHARS)
        kind = id_type(coder)
        end, turn = np.array([END_ID], kind).tobytes(), TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole):
                doc_id = batch.column("doc_id")
                known, named = doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False)
                first, last = np.searchsorted(edges, known, "left"), np.searchsorted(edges, known, "right")
                row = np.arange(len(known)) + turn  # the same each time a task runs
                turn += len(known)
                part = np.where(named, for_null + first + row % (last - first + 1), row % max(for_null, 1))
                ids = [x.astype(kind).tobytes() + end for x in coder.encode_all([x or "" for x in batch.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_id, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return docs.mapInArrow(run, "part int, doc_id long, ids binary")


def id_type(coder) -> str:
    return "<u2" if len(coder.width_table) <= 1 << 16 else "<u4"


MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encodes docs and writes shards to folder; gives the manifest: file, part, place (of the shard in the part), n_docs, n_ids."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = scaled(total, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(encoder(vocabulary, LEAF_CHARS))
        part, place, doc_ids, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def write() -> pa.RecordBatch:
            nonlocal place, doc_ids, ids, n
            store, path = _target(folder)
            store.create_dir(path, recursive=True)
            name = f"{part:08d}-{place:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(pack_shard(doc_ids, ids, int(kind[-1])))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "place": [place], "n_docs": [len(ids)], "n_ids": [n]}, MANIFEST)
            place, doc_ids, ids, n = place + 1, [], [], 0
            return row

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, kind))
                n += len(ids[-1])
                if n >= shard_ids:
                    yield write()
        if ids:
            yield write()

    dealt = encoded(docs, parts, vocabulary).repartitionById(parts, "part").sortWithinPartitions("doc_id")
    return cut(dealt.select("doc_id", "ids").mapInArrow(run, "file string, part int, place int, n_docs long, n_ids long"), "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32. start counts the ids of all documents before."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard, at, rows = Shard(raw.as_buffer().to_pybytes()), 0, {"at": [], "n_tokens": [], "ids_crc32": []}
                for i in range(shard.n):
                    after = shard.bounds.select(i + 1)
                    rows["at"].append(at)
                    rows["n_tokens"].append(after - at)
                    rows["ids_crc32"].append(zlib.crc32(shard.body[at:after].astype("<u4").tobytes()))
                    at = after
                yield pa.RecordBatch.from_pydict({"file": [path.rpartition("/")[2]] * shard.n, "doc_id": shard.doc_ids(), **rows}, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", "content").mapInArrow(run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    # the only unpartitioned window is over parts, of which there are session.MAX_PARTS at most
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", ahead(Window.orderBy("part")).alias("before"))
    bases = manifest.select("file", "part", ahead(Window.partitionBy("part").orderBy("place")).alias("inside")).join(parts, "part")
    return rows.join(bases, "file").select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    _target(folder)[0].create_dir(_target(folder)[1], recursive=True)
    return read_shards(spark, folder, write_shards(documents(spark, sf_dir, "doc_id", "text"), folder))
