"""BPE encoding and decoding by tree concatenation.

A text is halved until its leaves are short, wherever that cuts it. Leaves are encoded, and neighbours are joined level by level: a window around
the join is encoded anew, from a token's edge on the left to a token's edge on the right, and takes the place of both sides' tokens there
if its own first and last tokens are exactly those that the two sides have at the same places. Else the window grows, up to both whole sides.
Edges are where the vocabulary's splitting pattern always cuts (a change between letters, digits, marks and white space) or, in a run of one such class,
between two tokens of a side: a sequence of tokens is the encoding of a run if each pair of neighbours is.

Halves are encoded in parallel: all leaves of many texts in one pass, and texts over SEGMENT_CHARS as rows of segments that are dealt to
tasks of their own, whose ids then meet to be joined. Within a pass, a leaf is a row of pieces that
the splitting pattern never joins; distinct pieces are told by their bytes, and the library encodes those that are not remembered.

Null text counts as empty and gives no ids; decoding no ids gives the empty text. Rows keep their doc_id, null or
not; repeated rows give repeated results. Other columns are not read. An empty table gives an empty result.
"""

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.session import documents

# Unicode White_Space, as the splitting pattern's \s has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Some engines take these four as white space and some do not: nothing is cut beside them.
UNSURE = "\x1c-\x1f"
#: Characters whose class is the same in all Unicode versions; an apostrophe starts a contraction, and the rest are in special tokens' texts.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яЁёא-תぁ-ゖァ-ヺ一-龥가-힣"
_DIGITS = "0-9"
_MARKS = r"!\"#$%&()*+,\-./:;=?@\[\]^_`{}~—…、。，！？"
_CUT = re.compile(
    f"(?<=[^{WHITE}{UNSURE}])(?=[{WHITE}])|(?<=[{_LETTERS}])(?=[{_DIGITS}{_MARKS}])|(?<=[{_DIGITS}])(?=[{_LETTERS}{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}{_DIGITS}])"
)
#: Inside these nothing is cut; both edges of what matches are left out of account, as white space may split before its last character.
_ONE_CLASS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]+|[{_MARKS}]+|[{WHITE}]+")
_MARGIN = 8
_SOLID_ENDS = re.compile(f"[{WHITE}].*[^{WHITE}{UNSURE}]", re.S)

_BYTE_SPACE = np.zeros(256, bool)
_BYTE_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_UNSURE = np.zeros(256, bool)
_BYTE_UNSURE[28:32] = True
_BYTE_LETTER = np.zeros(256, bool)
_BYTE_LETTER[65:91] = _BYTE_LETTER[97:123] = True
_BYTE_MARK = np.zeros(256, bool)
_BYTE_MARK[list(b".,;:!?%$&#*)")] = True
_WIDE_SPACES = [x.encode() for x in re.findall(f"[{WHITE}]", "".join(map(chr, range(0x80, 0x3001))))]

LEAF_CHARS = 2048
SEGMENT_CHARS = 1 << 18
CACHE_ENTRIES = 400_000
CACHED_BYTES = 48


def piece_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes, rows' starts included: white space after what is none, and these marks after a letter."""
    start = np.zeros(len(data) + 1, bool)
    start[rows] = True
    white = _BYTE_SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        ends = np.append(data, np.zeros(2, np.uint8))
        for x in _WIDE_SPACES:
            at = lead[data[lead] == x[0]]
            for k in range(1, len(x)):
                at = at[ends[at + k] == x[k]]
            for k in range(len(x)):
                white[at + k] = True
    start[1:-1] |= ~(white[:-1] | _BYTE_UNSURE[data[:-1]]) & white[1:]
    start[1:-1] |= _BYTE_LETTER[data[:-1]] & _BYTE_MARK[data[1:]]
    start[-1] = False
    return np.flatnonzero(start)


class TreeEncoder:
    """Encodes whole texts to arrays of ids, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, vocabulary: str, leaf_chars: int = LEAF_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf_chars = leaf_chars
        self.remembered: dict[str, bytes] = {}
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # bytes of each token: in a byte-level vocabulary, a character stands for a byte
        size = 1 + max(self.library.get_vocab().values())
        self.width_table = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab().items():
            self.width_table[i] = len(token.encode()) if token in special else len(token)

    # leaves

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces from the library. Those that start with white space and end without any follow each other in one text."""
        out: dict[str, bytes] = {}
        lead = [x for x in pieces if _SOLID_ENDS.fullmatch(x)]
        for i in range(0, len(lead), 4096):
            part = lead[i : i + 4096]
            ids = self.plain(["".join(part)])[0]
            sizes = np.fromiter((len(x.encode()) for x in part), np.int64, len(part))
            ends = ((np.searchsorted(np.cumsum(self.width_table[ids]), np.cumsum(sizes)) + 1) * 4).tolist()
            raw = ids.tobytes()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [x for x in pieces if x not in out]
        for i in range(0, len(rest), 2048):  # an encoding of the library's takes far more memory than its ids
            part = rest[i : i + 2048]
            out.update(zip(part, (x.tobytes() for x in self.plain(part)), strict=True))
        return [out[x] for x in pieces]

    def encode_leaves(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of many short texts in one pass: a distinct piece is looked up once."""
        if not texts:
            return []
        raw = [x.encode() for x in texts]
        rows = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=rows[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        starts = piece_starts(data, rows[:-1][rows[:-1] < len(data)])
        offsets = np.append(starts, len(data)).astype(np.int64)
        held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        distinct, index = held.dictionary.to_pylist(), held.indices.to_numpy()
        ids = list(map(self.remembered.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            if len(self.remembered) > CACHE_ENTRIES:  # frequent pieces come early: the first half stays
                self.remembered = dict(islice(self.remembered.items(), CACHE_ENTRIES // 2))
            for i, x in zip(new, self._learn([distinct[i] for i in new]), strict=True):
                ids[i] = x
                if len(distinct[i]) <= CACHED_BYTES:
                    self.remembered[distinct[i]] = x
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        edges = np.append(0, ends)[np.searchsorted(starts, rows)].tolist()
        at = np.repeat((first[index] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        out = flat[at]
        return [out[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    # joins; a node is (start, end, ids) of a text

    def left_edge(self, text: str, node: tuple, reach: int) -> tuple[int, int, np.ndarray] | None:
        """Of the left side: where the window starts, the tokens kept before it, and those that the window must begin with."""
        start, mid, ids = node
        want, span = mid - reach, 64
        if want <= start:
            return start, 0, ids[:0]
        low = max(start, want - span)
        cuts = [m.start() for m in _CUT.finditer(text, low, want + 1) if m.start() > start]
        if len(cuts) >= 2 or low == start:
            outer, inner = (cuts[-2], cuts[-1]) if len(cuts) >= 2 else (start, cuts[-1] if cuts else start)
            keep, upto = self.tokens_before(ids, text[outer:mid]), self.tokens_before(ids, text[inner:mid])
            return None if keep is None or upto is None else (outer, keep, ids[keep:upto])
        if (run := _ONE_CLASS.match(text, low)) is None or run.end() < min(want + span, mid):
            return None
        # between two tokens inside the run
        back = np.cumsum(self.width_table[ids[: -4 * reach - 64 : -1]])
        k = int(np.searchsorted(back, len(text[want:mid].encode())))
        raw = text[low - _MARGIN if low - _MARGIN > start else low : mid].encode()
        while k < len(back) and back[k] < len(raw):
            at = len(raw) - int(back[k])
            if raw[at] & 0xC0 != 0x80:
                keep = len(ids) - k - 1
                return mid - len(raw[at:].decode()), keep, ids[keep : keep + 1]
            k += 1
        return None

    def right_edge(self, text: str, node: tuple, reach: int) -> tuple[int, int, np.ndarray] | None:
        """Of the right side: where the window ends, the tokens kept from there on as an index, and those that the window must end with."""
        mid, end, ids = node
        want, span = mid + reach, 64
        if want >= end:
            return end, len(ids), ids[:0]
        high = min(end, want + span)
        cuts = [m.start() for _, m in zip(range(2), _CUT.finditer(text, want, min(end, high + 1)), strict=False) if m.start() < end]
        if len(cuts) >= 2 or high == end:
            inner, outer = (cuts[0], cuts[1]) if len(cuts) >= 2 else (cuts[0] if cuts else end, end)
            upto, keep = self.tokens_over(ids, text[mid:inner]), self.tokens_over(ids, text[mid:outer])
            return None if keep is None or upto is None else (outer, keep, ids[upto:keep])
        if (run := _ONE_CLASS.match(text, max(mid, want - span))) is None or run.end() < high:
            return None
        ahead = np.cumsum(self.width_table[ids[: 4 * reach + 64]])
        k = int(np.searchsorted(ahead, len(text[mid:want].encode())))
        raw = text[mid : high - _MARGIN].encode()
        while k < len(ahead) and ahead[k] < len(raw):
            at = int(ahead[k])
            if raw[at] & 0xC0 != 0x80:
                return mid + len(raw[:at].decode()), k + 1, ids[k : k + 1]
            k += 1
        return None

    def tokens_before(self, ids: np.ndarray, part: str) -> int | None:
        """The number of tokens before part, which is at the end; None if a token goes across its edge."""
        need = len(part.encode())
        sums = np.cumsum(self.width_table[ids[: -need - 1 : -1]])
        k = int(np.searchsorted(sums, need))
        return len(ids) if not need else len(ids) - k - 1 if k < len(sums) and sums[k] == need else None

    def tokens_over(self, ids: np.ndarray, part: str) -> int | None:
        """The number of tokens of part, which is at the start; None if a token goes across its edge."""
        need = len(part.encode())
        sums = np.cumsum(self.width_table[ids[:need]])
        k = int(np.searchsorted(sums, need))
        return 0 if not need else k + 1 if k < len(sums) and sums[k] == need else None

    def windows(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_leaves(texts)

    def join_all(self, pairs: list[tuple[str, tuple, tuple]]) -> list[tuple]:
        """Joins (text, left, right) for many pairs; windows that are to grow are encoded together again."""
        out: list = [None] * len(pairs)
        todo, reach = list(range(len(pairs))), 32
        while todo:
            tried, again = [], []
            for i in todo:
                text, left, right = pairs[i]
                a, b = self.left_edge(text, left, reach), self.right_edge(text, right, reach)
                if a is None or b is None:
                    again.append(i)
                else:
                    tried.append((i, a, b))
            for (i, (a, kept, head), (b, upto, tail)), ids in zip(tried, self.windows([pairs[i][0][a[0] : b[0]] for i, a, b in tried]), strict=True):
                _, left, right = pairs[i]
                if len(ids) >= len(head) + len(tail) and np.array_equal(ids[: len(head)], head) and np.array_equal(ids[len(ids) - len(tail) :], tail):
                    out[i] = (left[0], right[1], np.concatenate((left[2][:kept], ids, right[2][upto:])))
                else:
                    again.append(i)
            todo, reach = again, reach * 2
        return out

    def concatenate(self, texts: list[str], nodes: list[list[tuple]]) -> list[np.ndarray]:
        """Joins each text's nodes, neighbour by neighbour, level by level; all texts' joins of a level in one pass."""
        while True:
            pairs, owners = [], []
            for i, own in enumerate(nodes):
                for k in range(0, len(own) - 1, 2):
                    pairs.append((texts[i], own[k], own[k + 1]))
                    owners.append(i)
            if not pairs:
                return [own[0][2] for own in nodes]
            level: dict[int, list[tuple]] = {}
            for i, joined in zip(owners, self.join_all(pairs), strict=True):
                level.setdefault(i, []).append(joined)
            for i, joined in level.items():
                nodes[i] = joined + nodes[i][2 * len(joined) :]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        places = [[(a, min(a + self.leaf_chars, len(x))) for a in range(0, max(len(x), 1), self.leaf_chars)] for x in texts]
        leaves = iter(self.encode_leaves([x[a:b] for x, own in zip(texts, places, strict=True) for a, b in own]))
        return self.concatenate(texts, [[(a, b, next(leaves)) for a, b in own] for own in places])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_encoders: dict[tuple, TreeEncoder] = {}


def encoder(vocabulary: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder for each worker process, so that remembered pieces serve later tasks."""
    key = (vocabulary, leaf_chars)
    if key not in _encoders:
        _encoders[key] = TreeEncoder(vocabulary, leaf_chars)
    return _encoders[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most bytes."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def encode_documents(df: DataFrame, vocabulary: str, make: Callable, schema: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Applies make(encoder, doc_ids, ids) to df's rows. Texts of one segment: a narrow stage, memory by slice. Longer ones: their segments are rows, dealt
    to tasks by row and place and encoded there; a text's ids then meet in one task and are joined."""
    long = F.coalesce(F.char_length("text") > segment_chars, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                yield make(coder, batch.column("doc_id").cast(pa.int64()), coder.encode_all(texts))

    def encode_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            ids = [coder.encode(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    def join_segments(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        parts, at, nodes = table.column("text").to_pylist(), 0, []
        for x, ids in zip(parts, table.column("ids").to_pylist(), strict=True):
            nodes.append((at, at + len(x), np.frombuffer(ids, np.uint32)))
            at += len(x)
        coder = encoder(vocabulary)
        ids = coder.concatenate(["".join(parts)], [nodes])
        return pa.Table.from_batches([make(coder, table.column("doc_id").slice(0, 1).combine_chunks().cast(pa.int64()), ids)])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = rows.filter(~long).mapInArrow(run, schema)
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{segment_chars}}}"), F.lit(0))
    segments = rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "*").select("row", "doc_id", F.posexplode(cut).alias("place", "text"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = segments.repartition(tasks, "row", "place").mapInArrow(encode_segments, "row long, doc_id long, place int, text string, ids binary")
    return short.union(encoded.groupBy("row").applyInArrow(join_segments, schema))


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def round_trip(df: DataFrame, vocabulary: str | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Encodes text and decodes the ids again: doc_id, token_ids array<int>, decoded string."""

    def make(coder, doc_ids, ids):
        arrays = [doc_ids, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(coder.decode_all(ids), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "token_ids", "decoded"])

    return encode_documents(df, vocabulary or default_vocabulary(), make, "doc_id long, token_ids array<int>, decoded string", segment_chars)


def digests(df: DataFrame, vocabulary: str | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """What round_trip gives, as digests made in the same tasks: the ids themselves need not leave them."""

    def make(coder, doc_ids, ids):
        decoded = coder.decode_all(ids)
        arrays = [
            doc_ids,
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([ids_digest(x) for x in ids], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(df, vocabulary or default_vocabulary(), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", segment_chars)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"))
