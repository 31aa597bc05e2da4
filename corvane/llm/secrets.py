"""Secret scans with a recursive decoding worklist.

The base scan finds three kinds of secrets in the text itself. Then encoded runs are unwrapped: percent and Unicode
escapes, base64 (plain or URL alphabet) and gzip, zlib or UTF-16 data inside it. Escapes of escapes, however deep, are one layer, and are taken off in one
pass: what a decoded character completes is decoded at once. Base64 is read at each of the four alignments of a run, as
paths and words can stand before it without a gap. Runs are scanned alone and in their surroundings, that is with all runs of a kind replaced
in the text; of a base64 run there, what decodes to printable text up to its end. Bytes that are not UTF-8 stand as characters that
match nothing. Each decoded layer is scanned in its turn, and its own encoded runs
go on the worklist, until nothing new comes out; a layer of the same text from the same original characters is not taken again, which ends
cycles, while the same text elsewhere is. Every layer carries a map from its characters to the original's, so that a secret found deep inside is reported as the span of original characters
it was decoded from.

Work grows with a text's length times its layers of base64 or compression, each of which is shorter than the one around it but for compression. What a
compressed stream holds is kept once, has one span for all, and is scanned by lines of it, so that it takes memory for its own bytes (which
can be a thousand times the text's: nothing is capped).

Null and empty texts have no spans. Texts are scanned whole. Repeated rows give repeated results.
"""

import base64
import contextlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.session import documents

# The kinds of secrets, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Greedy runs: a run that is too short holds no match that is long enough.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
_CHUNK = re.compile(r"[!-~]+")
_PARTIAL = re.compile(rb"(?:%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3})?)\Z")
_WHOLE = re.compile(rb"%([0-9A-Fa-f]{2})\Z|\\u([0-9A-Fa-f]{4})\Z")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WIDE = re.compile(rb"(?:\x00[\x01-\x7f]){6,}|(?:[\x01-\x7f]\x00){6,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: What a stream holds is scanned in parts of about so many bytes, cut at line ends, which no pattern and no run crosses.
PART_BYTES = 1 << 20

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base scan."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class Layer:
    """Decoded text; its character i stems from original characters low[i] to high[i], end exclusive."""

    def __init__(self, text: str, low: np.ndarray, high: np.ndarray):
        self.text, self.low, self.high = text, low, high


def _by_character(raw: bytes, low: np.ndarray, high: np.ndarray) -> Layer:
    """A layer from bytes that have a span each; a byte that is not UTF-8 is a lone surrogate, from which it can be had again."""
    text = raw.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code < 0xDD00)] = 1
    first = np.cumsum(size) - size
    return Layer(text, low[first], np.maximum.reduceat(high, first) if len(first) else high[:0])


class _Settling:
    """Bytes that are decoded as soon as they end in an escape, with the original characters' span of each."""

    def __init__(self):
        self.raw, self.low, self.high = bytearray(), [], []

    def add(self, raw: bytes, low: list[int], high: list[int]) -> None:
        """Adds one decoded character's bytes, and takes off what it completes."""
        self.raw += raw
        self.low += low
        self.high += high
        while (m := _WHOLE.search(self.raw, max(0, len(self.raw) - 6))) is not None:
            first, last, at = min(self.low[m.start() :]), max(self.high[m.start() :]), m.start()
            made = bytes([int(m[1], 16)]) if m[1] else chr(int(m[2], 16)).encode("utf-8", "surrogatepass")
            del m
            del self.raw[at:], self.low[at:], self.high[at:]
            before = bytes(self.raw[-3:])
            if b"\xed\xb0" <= made[:2] <= b"\xed\xbf" and b"\xed\xa0" <= before[:2] <= b"\xed\xaf":  # the second half of a pair
                first = min(self.low[-3:])
                del self.raw[-3:], self.low[-3:], self.high[-3:]
                made = (before + made).decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16").encode()
            self.raw += made
            self.low += [first] * len(made)
            self.high += [last] * len(made)

    def extend(self, text: str, low: list[int], high: list[int]) -> None:
        """Adds ASCII text that holds no escape of its own."""
        k = 0
        while k < len(text) and _PARTIAL.search(self.raw, max(0, len(self.raw) - 5)):
            self.add(text[k].encode(), low[k : k + 1], high[k : k + 1])
            k += 1
        self.raw += text[k:].encode()
        self.low += low[k:]
        self.high += high[k:]


def _settled(layer: Layer, start: int, stop: int) -> Layer:
    """The layer's characters start to stop, all ASCII, with escapes and escapes of escapes decoded. Each step makes the bytes fewer: linear in all."""
    text, low, high = layer.text[start:stop], layer.low[start:stop].tolist(), layer.high[start:stop].tolist()
    out, at = _Settling(), 0
    for m in _ESCAPE.finditer(text):
        if m.start() < at:
            continue
        out.extend(text[at : m.start()], low[at : m.start()], high[at : m.start()])
        for k in range(m.start(), m.end()):
            out.add(text[k].encode(), low[k : k + 1], high[k : k + 1])
        at = m.end()
    out.extend(text[at:], low[at:], high[at:])
    return _by_character(bytes(out.raw), np.array(out.low, np.int64), np.array(out.high, np.int64))


def _inflate(raw: bytes) -> tuple[bytes, int]:
    """What a gzip or zlib stream at the start holds, as far as it is sound, and the bytes taken."""
    stream, out = zlib.decompressobj(47), []
    try:
        return stream.decompress(raw) + stream.flush(), len(raw) - len(stream.unused_data)
    except zlib.error:
        stream = zlib.decompressobj(47)
    i = 0
    with contextlib.suppress(zlib.error):  # in halving steps up to the byte that is wrong
        step = 1 << 16
        while i < len(raw):
            held = stream.copy()
            try:
                out.append(stream.decompress(raw[i : i + step]))
                i += step
            except zlib.error:
                if step == 1:
                    raise
                stream, step = held, step // 2
    return b"".join(out), min(i + 1, len(raw))


def _lines(raw: bytes) -> Iterator[bytes]:
    """Parts of about PART_BYTES that end at line ends."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\n", at + PART_BYTES) + 1 or len(raw)
        yield raw[at:stop]
        at = stop


def _read(raw: bytes, low: np.ndarray, high: np.ndarray, end: int) -> Iterator[Layer]:
    """The layers that bytes with a span each hold: text in UTF-8, ASCII text in UTF-16, and compressed data, also within each other.

    end: of the whole run, which is that of data that reach to its last byte.
    """
    yield _by_character(raw, low, high)
    for wide, of, pair in _wide(raw):
        yield _by_character(wide, low[pair], high[pair + 1])
    work, seen = list(_packed(raw, low, high, end)), set()
    while work:
        inner, first, last = work.pop()
        if not inner or (inner, first, last) in seen:
            continue
        seen.add((inner, first, last))
        for part in _lines(inner):
            text = part.decode("utf-8", "surrogateescape")
            yield Layer(text, np.broadcast_to(np.int64(first), len(text)), np.broadcast_to(np.int64(last), len(text)))
        for wide, *_ in _wide(inner):
            text = wide.decode("ascii")
            yield Layer(text, np.broadcast_to(np.int64(first), len(text)), np.broadcast_to(np.int64(last), len(text)))
        one = np.broadcast_to(np.int64(first), len(inner)), np.broadcast_to(np.int64(last), len(inner))
        work += _packed(inner, *one, last)


def _wide(raw: bytes) -> Iterator[tuple[bytes, slice, np.ndarray]]:
    for m in _WIDE.finditer(raw):
        of = slice(m.start() + (m.group()[0] == 0), m.end(), 2)
        yield raw[of], of, np.arange(m.start(), m.end(), 2)


def _packed(raw: bytes, low: np.ndarray, high: np.ndarray, end: int) -> Iterator[tuple[bytes, int, int]]:
    """What compressed streams among the bytes hold, and their span."""
    past = 0
    for m in _PACKED.finditer(raw):
        if m.start() >= past:
            inner, taken = _inflate(raw[m.start() :])
            if inner:
                past = m.start() + taken
                yield inner, int(low[m.start()]), end if past == len(raw) else int(high[past - 1])


def _base64(layer: Layer, run: re.Match) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """For each alignment: the place of its first character, the bytes and their spans in the layer's own characters."""
    body = run.group().rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        some = body[k : len(body) - ((len(body) - k) % 4 == 1)]
        raw = base64.b64decode(some + "=" * (-len(some) % 4))
        at, start = np.arange(len(raw)), run.start() + k
        low, high = start + at * 4 // 3, np.minimum(start + ((at + 1) * 4 + 2) // 3, start + len(some))
        yield start, raw, low, high


def _replaced(layer: Layer, parts: list[tuple[int, int, Layer]]) -> Layer:
    """The layer with decoded texts in place of the characters start to stop of each part."""
    text, low, high, at = [], [], [], 0
    for start, stop, part in [*parts, (len(layer.text), len(layer.text), None)]:
        text.append(layer.text[at:start])
        low.append(layer.low[at:start])
        high.append(layer.high[at:start])
        if part is not None:
            text.append(part.text)
            low.append(part.low)
            high.append(part.high)
        at = stop
    return Layer("".join(text), np.concatenate(low), np.concatenate(high))


def _sound_end(layer: Layer, run: re.Match, found: list[tuple[int, bytes, np.ndarray, np.ndarray]]) -> tuple[int, int, Layer] | None:
    """The longest end of a base64 run, from its start or from behind one of / _ - +, that decodes to printable text."""
    best = None
    for start, raw, low, high in found:
        text = _by_character(raw, low, high)
        bad = next((i for i in range(len(text.text) - 1, -1, -1) if not (text.text[i].isprintable() or text.text[i] in "\t\r\n")), None)
        sound = start if bad is None else int(text.high[bad])
        for at in range(start + (sound - start + 3) // 4 * 4, run.end() - 8, 4):
            if at == run.start() or layer.text[at - 1] in "/_-+":
                if best is None or at < best[0]:
                    from_here = int(np.searchsorted(text.low, at))
                    best = (at, run.end(), Layer(text.text[from_here:], layer.low[text.low[from_here:]], layer.high[text.high[from_here:] - 1]))
                break
    return best


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers one step below."""
    text = layer.text
    if _ESCAPE.search(text):
        parts = [(m.start(), m.end(), _settled(layer, *m.span())) for m in _CHUNK.finditer(text) if _ESCAPE.search(text, *m.span())]
        for _, _, part in parts:
            yield part
        yield _replaced(layer, parts)
    parts = []
    for run in _BASE64.finditer(text):
        found = list(_base64(layer, run))
        for _, raw, low, high in found:
            yield from _read(raw, layer.low[low], layer.high[high - 1], int(layer.high[run.end() - 1]))
        if (part := _sound_end(layer, run, found)) is not None:
            parts.append(part)
    if parts:
        yield _replaced(layer, parts)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with those of decoded layers."""
    base = base_spans(text)
    found = set(base)
    if "%" in text or "\\u" in text or _BASE64.search(text):
        # by text: the layers below with maps to the text's own characters, and what the base scan finds in each; repeats are only mapped
        known: dict[str, list[tuple[Layer, list[Span]]]] = {}
        each = np.arange(len(text) + 1, dtype=np.int64)
        work, seen = [Layer(text, each, each + 1)], set()
        while work:
            layer = work.pop()
            if layer.text not in known:
                own = np.arange(len(layer.text) + 1, dtype=np.int64)
                known[layer.text] = [(x, base_spans(x.text)) for x in unwrap(Layer(layer.text, own, own + 1))]
            for part, spans in known[layer.text]:
                below = Layer(part.text, layer.low[part.low], layer.high[part.high - 1])
                place = (below.text, below.low.tobytes(), below.high.tobytes())
                if place in seen:
                    continue
                seen.add(place)
                work.append(below)
                found.update((int(below.low[a]), int(below.high[a:b].max()), kind) for a, b, kind in spans)
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=order), sorted(found, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(df: DataFrame) -> DataFrame:
    """A row for each document: doc_id, base and spans as arrays of (kind, start, end). A narrow stage."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x or "") for x in batch.column("text").to_pylist()]
            columns = [pa.array([[(k, a, b) for a, b, k in x[i]] for x in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_documents' rows."""
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as long) as n_{k}" for k in KINDS]
    return found.selectExpr("doc_id", *counts, f"sha2({text.format('base')}, 256) as base_sha256", f"{text.format('spans')} as spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_documents(documents(spark, sf_dir, "doc_id", "text")))

