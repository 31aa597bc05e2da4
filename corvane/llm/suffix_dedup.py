"""Suffix-array dedup: removes every byte covered by a 200-byte string that starts anywhere else too.

1. Each 200-byte window has an anchor: the 64-byte gram in it with the smallest hash, leftmost of equals. Occurrences of one window have the
   same anchor at the same place in it, so windows can be judged where their anchor's occurrences meet. An occurrence is sent as a hash of
   its gram, and a 128-bit BLAKE2 digest of all bytes that its windows cover.
2. Occurrences with equal digests are copies: all their windows repeat. Where a gram occurs with different bytes around it, the bytes
   are needed, and are fetched; elsewhere, nothing repeats.
3. Contexts of one gram are cut, aligned at it, where any two of them begin to differ; a cut context is a string of a few symbols.
   The suffix array of all a task's strings is made by linear grouping (below), and a suffix's longest common prefix with its neighbours
   tells how far the windows that start there repeat. As cuts are at all places where contexts differ, this is exact to the byte.
   Of a gram with more than HOT_CLASSES different contexts, which would be one task's, each window is judged where its own digest's occurrences meet.

Linear grouping: suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order; the nearest smaller suffix before each
member (its previous-smaller pointer) moves into a group of its own behind its old one, by how often the group follows it. Then the order within groups is
read off in one ascending pass along the pointers. Nothing is renamed or sorted again.

Matches never cross documents. Null text counts as empty; texts under 200 bytes keep all bytes. Rows that repeat a doc_id are documents of
their own. Equal texts are found as any other repeat, and lose all bytes if they have 200 or more. Texts are told by 64-bit names; names that texts of
different SHA-256 digests share are dealt anew. Other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.session import cut, documents, scaled
from corvane.llm.textops import U, _power_tables, mix, text_chunks

LENGTH = 200
GRAM = 64
SIDE = LENGTH - GRAM
PART_BYTES = 48 << 20
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MARK = np.dtype([("name", "<i8"), ("start", "<u4"), ("stop", "<u4")])
ENTRY = np.dtype([("gram", "<u8"), ("bytes", "<u8"), ("more", "<u8"), ("pos", "<u4"), ("before", "u1"), ("after", "u1"), ("many", "u1")])


# ---- linear grouping


def previous_smaller_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """Group starts and previous-smaller pointers of all suffixes. text: ends with its only smallest symbol."""
    n = len(text)
    size: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        members.setdefault(x, []).append(i)
    group, start_of_end, by_start, at = [0] * n, {}, {}, 0
    for x in sorted(members):
        own = members[x]
        for i in own:
            group[i] = at
        by_start[at], size[at] = own, len(own)
        start_of_end[at + len(own)] = at
        at += len(own)
    before = [-1] * n
    end = n
    while end > 0:
        now = start_of_end[end]
        follows: dict[int, int] = {}
        for i in sorted(x for x in by_start.pop(now) if group[x] == now):
            j = i - 1
            while j >= 0 and group[j] >= now:
                j = before[j]
            before[i] = j
            if j >= 0:
                follows[j] = follows.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in follows.items():
            moves.setdefault((times, group[j]), []).append(j)
        for (_, old), moved in sorted(moves.items(), reverse=True):
            if len(moved) < size[old]:
                last = old + size[old]
                new = last - len(moved)
                size[old] -= len(moved)
                size[new] = len(moved)
                start_of_end[last], start_of_end[new] = new, old
                by_start[new] = moved
                for j in moved:
                    group[j] = new
        end = now
    return group, before


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of integers by linear grouping; an end symbol below all others is added and left out again."""
    low = min(text, default=0) - 1
    group, before = previous_smaller_groups([*text, low])
    n = len(text) + 1
    order, placed, free = [0] * n, [False] * n, list(range(n))
    order[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return order[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each suffix in order, the length it has in common with the one before."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(order):
        rank[i] = k
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


# ---- anchors


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows' windows: positions of anchors, first and last window start, hash of the gram, and the two halves of a digest of all bytes their windows cover."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not (sizes >= LENGTH).any():
        return none, none, none, none.view(U), np.zeros((0, 2), U)
    n = len(data)
    forward, back = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * forward[:n], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1], 11)
    width = SIDE + 1
    packed = np.full(-(-len(gram) // width) * width, ~U(0))
    packed[: len(gram)] = (gram & ~U(0xFFFFFFFF)) | np.arange(len(gram), dtype=U)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    long = sizes >= LENGTH
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    at = (np.minimum(behind[starts], ahead[starts + SIDE]) & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    pos, first, last = at[new], starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    raw = data.tobytes()
    around = b"".join(
        hashlib.blake2b(raw[a:b], digest_size=16, salt=bytes((p - a, p + LENGTH - b))).digest()  # with the place of the gram in these bytes
        for p, a, b in zip(pos.tolist(), first.tolist(), (last + LENGTH).tolist(), strict=True)
    )
    return pos, first, last, gram[pos], np.frombuffer(around, "<u8").reshape(-1, 2)


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes & U(0xFFFFFFFF)) * U(parts)) >> U(32)).astype(np.int64)


def _of(names: np.ndarray, groups: int) -> np.ndarray:
    return (names.view(U) % U(groups)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "names", "body"])


WINDOW = np.dtype([("bytes", "<u8"), ("more", "<u8"), ("name", "<i8"), ("start", "<u4"), ("many", "u1"), ("copy", "u1")])
HOT_CLASSES = 4096
#: kind 0: entries to be judged in a part; by text 1: spans that repeat, 2: contexts to be fetched, 3: those of hot grams
DEALT = "kind int, part int, names binary, body binary"


def _marks(kind: int, marks: np.ndarray, parts: int) -> list[tuple]:
    return [(kind, p, b"", marks[x].tobytes()) for p, x in _by_part(_of(np.ascontiguousarray(marks["name"]), parts), parts)]


def _changes(rows: np.ndarray, *fields: str) -> np.ndarray:
    """Where a row differs from the one before it in any of these fields."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for k in fields:
        out[1:] |= rows[k][1:] != rows[k][:-1]
    return out


def _full(names, pos, before, after) -> np.ndarray:
    out = np.zeros(len(names), MARK)
    out["name"], out["start"], out["stop"] = names, pos - before, pos - after + LENGTH
    return out


def dealt_anchors(texts: DataFrame, parts: int) -> DataFrame:
    """Anchors' occurrences by part of their gram. Those equal within a batch of rows are known to repeat; one of them goes on, marked so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_names = batch.column("name").to_numpy()
            held, held_names = [], []
            for row, data, offsets in text_chunks(batch.column("text")):
                pos, first, last, gram, around = anchors(data, offsets)
                if not len(pos):
                    continue
                doc = np.searchsorted(offsets, pos, "right") - 1
                entry = np.zeros(len(pos), ENTRY)
                entry["gram"], entry["bytes"], entry["more"], entry["pos"], entry["before"], entry["after"] = gram, around[:, 0], around[:, 1], pos - offsets[doc], pos - first, pos - last
                held.append(entry)
                held_names.append(all_names[row + doc])
            if not held:
                continue
            entry, names = np.concatenate(held), np.concatenate(held_names)
            order = np.lexsort((entry["more"], entry["bytes"], entry["gram"]))
            entry, names = entry[order], names[order]
            new = _changes(entry, "gram", "bytes", "more")
            run_of = np.cumsum(new) - 1
            several = (np.bincount(run_of) > 1)[run_of]
            entry["many"] = several
            pos = entry["pos"].astype(np.int64)
            out = _marks(1, _full(names[several], pos[several], entry["before"][several], entry["after"][several]), parts)
            entry, names = entry[new], names[new]
            by_name = np.argsort(names, kind="stable")  # names repeat, which the shuffle's compression uses
            entry, names = entry[by_name], names[by_name]
            out += [(0, p, names[x].tobytes(), entry[x].tobytes()) for p, x in _by_part(_parts_of(entry["gram"], parts), parts)]
            yield _rows(out)

    return texts.select("text", "name").mapInArrow(run, DEALT)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _judge(parts: int, hot_classes: int):
    """Of a part's occurrences: which are copies throughout, and which need their bytes compared."""

    def run(table: pa.Table) -> pa.Table:
        names, entry = _joined(table.column("names"), "<i8"), _joined(table.column("body"), ENTRY)
        order = np.lexsort((entry["pos"], names, entry["more"], entry["bytes"], entry["gram"]))
        names, entry = names[order], entry[order]
        new_gram, new = _changes(entry, "gram"), _changes(entry, "gram", "bytes", "more")
        klass, gram = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        copies = (np.bincount(klass) > 1) | (np.bincount(klass, entry["many"]) > 0)
        full = copies[klass]
        classes = np.bincount(gram[new])
        lone = np.bincount(gram, ~full) > 0
        fetch = new & ((classes > 1) & lone)[gram]
        pos = entry["pos"].astype(np.int64)
        rows = _marks(1, _full(names[full], pos[full], entry["before"][full], entry["after"][full]), parts)
        hot = (classes > hot_classes)[gram][fetch]
        want = np.zeros(int(fetch.sum()), MARK)
        # a context is named by its anchor and by how far its windows reach before and after; a copies' one is only compared with
        want["name"], want["start"] = names[fetch], pos[fetch]
        want["stop"] = (entry["before"][fetch].astype(np.uint32) << 9) | (entry["after"][fetch].astype(np.uint32) << 1) | full[fetch]
        rows += _marks(2, want[~hot], parts) + _marks(3, want[hot], parts)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """A row for each text: its spans that repeat, merged, and the contexts to be fetched (those of hot grams apart)."""
    kind = table.column("kind").to_numpy()
    spans = _joined(table.filter(pa.array(kind == 1)).column("body"), MARK)
    wants, hot = (np.unique(_joined(table.filter(pa.array(kind == k)).column("body"), MARK)) for k in (2, 3))
    spans = merged(spans)
    out = {"name": [], "spans": [], "wants": [], "hot": []}
    for name in np.unique(np.concatenate((spans["name"], wants["name"], hot["name"]))).tolist():
        out["name"].append(name)
        for k, x in (("spans", spans), ("wants", wants), ("hot", hot)):
            a, b = np.searchsorted(x["name"], [name, name + 1]) if name < 2**63 - 1 else (np.searchsorted(x["name"], name), len(x))
            out[k].append(x[a:b].tobytes())
    return pa.table({"name": pa.array(out["name"], pa.int64()), "spans": pa.array(out["spans"], pa.binary()), "wants": pa.array(out["wants"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})


BY_TEXT = "name long, spans binary, wants binary, hot binary"


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each text joined where they meet or overlap."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["name"]))]
    text = np.cumsum(np.r_[True, spans["name"][1:] != spans["name"][:-1]]) - 1
    reach = np.maximum.accumulate(spans["stop"].astype(np.int64) + (text << 32))
    new = np.r_[True, spans["start"][1:].astype(np.int64) + (text[1:] << 32) > reach[:-1]]
    first = np.flatnonzero(new)
    out = spans[first]
    out["stop"] = (reach[np.r_[first[1:], len(spans)] - 1] & 0xFFFFFFFF).astype(np.uint32)
    return out


FETCHED = "kind int, part int, head binary, body binary"


def _windows(name: int, raw: bytes, asks: np.ndarray) -> np.ndarray:
    """The windows of a text's hot contexts, each with a digest of its bytes."""
    out = []
    for ask in asks:
        pos, stop = int(ask["start"]), int(ask["stop"])
        starts = np.arange(pos - (stop >> 9), pos - (stop >> 1 & 0xFF) + 1)
        own = np.zeros(len(starts), WINDOW)
        digests = np.frombuffer(b"".join(hashlib.blake2b(raw[a : a + LENGTH], digest_size=16).digest() for a in starts.tolist()), "<u8").reshape(-1, 2)
        own["bytes"], own["more"], own["name"], own["start"], own["copy"] = digests[:, 0], digests[:, 1], name, starts, stop & 1
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, WINDOW)


def _repeated(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of windows that repeat among these or are known to, and one window for each digest, marked so."""
    windows = windows[np.lexsort((windows["more"], windows["bytes"]))]
    new = _changes(windows, "bytes", "more")
    run_of = np.cumsum(new) - 1
    many = (np.bincount(run_of) > 1) | (np.bincount(run_of, windows["many"]) > 0) if len(windows) else new
    hit = windows[many[run_of] & (windows["copy"] == 0)]
    spans = np.zeros(len(hit), MARK)
    spans["name"], spans["start"], spans["stop"] = hit["name"], hit["start"], hit["start"] + LENGTH
    first = windows[new]
    first["many"] = many
    return merged(spans), first


def contexts(rows: DataFrame, parts: int) -> DataFrame:
    """The asked contexts' bytes by part of their gram (kind 2); of hot grams, windows by part of their digest (0), less those that repeat within a batch (1).

    rows: text, name, wants, hot; repeats of a text in a task are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            grams, heads, bodies, windows = [], [], [], []
            for name, text, wants, hot in zip(*(batch.column(k).to_pylist() for k in ("name", "text", "wants", "hot")), strict=True):
                if name in seen:
                    continue
                seen.add(name)
                raw = text.encode()
                for want in np.frombuffer(wants, MARK):
                    pos, stop = int(want["start"]), int(want["stop"])
                    before, after = stop >> 9, stop >> 1 & 0xFF
                    grams.append(int.from_bytes(hashlib.blake2b(raw[pos : pos + GRAM], digest_size=8).digest(), "little"))
                    heads.append(want.tobytes())
                    bodies.append(raw[pos - before : pos - after + LENGTH])
                windows.append(_windows(name, raw, np.frombuffer(hot, MARK)))
            kind, part = [2] * len(grams), _parts_of(np.array(grams, U), parts).tolist()
            spans, first = _repeated(np.concatenate(windows)) if windows else (np.zeros(0, MARK), np.zeros(0, WINDOW))
            for k, p, x in [(0, p, first[x]) for p, x in _by_part(_parts_of(first["bytes"], parts), parts)] + [(1, 0, spans)] * bool(len(spans)):
                kind.append(k)
                part.append(p if k == 0 else int(x["name"][0]) % parts)
                heads.append(b"")
                bodies.append(x.tobytes())
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], names=["kind", "part", "head", "body"])

    return rows.select("text", "name", "wants", "hot").mapInArrow(run, FETCHED)


class Side:
    """One side of contexts, read away from the gram: where contexts of a group begin to differ, and their classes at these depths."""

    def __init__(self, group: np.ndarray, pieces: list[bytes]):
        n = len(pieces)
        self.size = np.array(list(map(len, pieces)), np.int64)
        padded = np.frombuffer(b"".join(x.ljust(SIDE, b"\0") for x in pieces), np.uint8).reshape(n, SIDE)
        order = np.lexsort((*padded.view(">u8").T[::-1], group))
        ordered, ordered_group, size = padded[order], group[order], self.size[order]
        differ = ordered[1:] != ordered[:-1]
        # in common with the one before; -1 at the start of a group
        common = np.r_[-1, np.where(ordered_group[1:] != ordered_group[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE))]
        reach = np.minimum(np.maximum(common, np.r_[common[1:], -1]), size)
        usable = np.zeros((int(group.max()) + 1, SIDE + 1), bool)
        for depth in (common, reach):
            ok = depth > 0
            usable[ordered_group[ok], depth[ok]] = True
        self.usable = usable
        which, depths, classes = [], [], []
        place = np.arange(n)
        for d in np.flatnonzero(usable.any(axis=0)).tolist():
            head = np.maximum.accumulate(np.where(common < d, place, 0))
            mine = np.flatnonzero(usable[ordered_group, d] & (reach >= d))
            which.append(order[mine])
            depths.append(np.full(len(mine), d))
            classes.append(head[mine] + n * d)
        self.which, self.depths, self.classes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, depths, classes))


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
    """For each context, the offsets (before its gram) at which a window starts that another context of the group has too."""
    n = len(bodies)
    left = Side(group, [x[:b][::-1] for x, b in zip(bodies, before.tolist(), strict=True)])
    right = Side(group, [x[b + GRAM :] for x, b in zip(bodies, before.tolist(), strict=True)])
    # strings: left classes from the farthest depth, the gram, right classes outward, an end of its own
    owner = np.concatenate((left.which, np.arange(n), right.which, np.arange(n)))
    place = np.concatenate((-left.depths, np.zeros(n, np.int64), right.depths, np.full(n, SIDE + 1)))
    base = n * (SIDE + 2)
    symbol = np.concatenate((left.classes, 3 * base + group, base + right.classes, 4 * base + np.arange(n)))
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    text = np.unique(symbol[order], return_inverse=True)[1].tolist()
    ranked = suffix_array(text)
    common = common_prefixes(text, ranked)
    longest = np.zeros(len(text), np.int64)
    ranked, common = np.array(ranked), np.array([*common, 0])
    longest[ranked] = np.maximum(common[:-1], common[1:])
    gram_at = np.flatnonzero(place == 0)
    start = np.flatnonzero(place <= 0)
    # the depth to the right of the last symbol in common, if the match goes past the gram at all
    past = start + longest[start] - 1
    whole = past >= gram_at[owner[start]]
    depth_right = np.where(whole, np.maximum(place[np.minimum(past, len(place) - 1)], 0), -1)
    out = [np.zeros(0, np.int64)] * n
    edges = np.searchsorted(owner[start], np.arange(n + 1))
    for i in np.unique(owner[start[whole]]).tolist():
        depths = -place[start[edges[i] : edges[i + 1]]][::-1]
        reach = depth_right[edges[i] : edges[i + 1]][::-1]
        offsets = np.arange(int(after[i]), int(before[i]) + 1)
        at = np.searchsorted(depths, offsets)
        ok = at < len(depths)
        ok[ok] = reach[at[ok]] >= SIDE - offsets[ok]
        out[i] = offsets[ok]
    return out


SYMBOL_CONTEXTS = 20_000


def _compare(parts: int):
    """Compares a part's contexts, gram by gram, and its windows of hot grams, and gives the spans that repeat."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        passed = _joined(table.filter(pa.array(kind == 1)).column("body"), MARK)
        spans, _ = _repeated(_joined(table.filter(pa.array(kind == 0)).column("body"), WINDOW))
        known = _marks(1, merged(np.concatenate((passed, spans))), parts)
        table = table.filter(pa.array(kind == 2))
        if not table.num_rows:
            return pa.Table.from_batches([_rows(known)])
        head = _joined(table.column("head"), MARK)
        bodies = table.column("body").to_pylist()
        stop = head["stop"].astype(np.int64)
        before, after, copies = stop >> 9, stop >> 1 & 0xFF, stop & 1
        grams = [x[b : b + GRAM] for x, b in zip(bodies, before.tolist(), strict=True)]
        index: dict[bytes, int] = {}
        group = np.array([index.setdefault(x, len(index)) for x in grams], np.int64)
        order = np.lexsort((head["start"], head["name"], group))
        keep = np.r_[True, (np.diff(group[order]) != 0) | (np.diff(head["name"][order]) != 0) | (np.diff(head["start"][order].astype(np.int64)) != 0)]
        order = order[keep]
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]), len(order)]
        marks, a = [], 0
        while a < len(edges) - 1:  # some groups at a time
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + SYMBOL_CONTEXTS, "right")) - 1)
            rows = order[edges[a] : edges[b]]
            found = repeated_windows(np.unique(group[rows], return_inverse=True)[1], before[rows], after[rows], [bodies[i] for i in rows])
            for i, offsets in zip(rows.tolist(), found, strict=True):
                if len(offsets) and not copies[i]:
                    cuts = np.flatnonzero(np.diff(offsets) != 1)
                    for lo, hi in zip(offsets[np.r_[0, cuts + 1]].tolist(), offsets[np.r_[cuts, len(offsets) - 1]].tolist(), strict=True):
                        pos = int(head["start"][i])
                        marks.append((int(head["name"][i]), pos - hi, pos - lo + LENGTH))
            a = b
        return pa.Table.from_batches([_rows(known + _marks(1, np.array(marks, MARK), parts))])

    return run


def named(rows: DataFrame) -> DataFrame:
    """Adds name, the same for equal texts only: a hash, dealt anew for texts that share one and differ in their SHA-256 digest."""
    rows = rows.withColumn("name", F.xxhash64("text"))
    for seed in range(1, 100):
        each = rows.filter(F.octet_length("text") >= LENGTH).select("name", F.sha2("text", 256).alias("digest"))
        shared = each.groupBy("name").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("name")
        if (clashes := shared.collect()) == []:  # about n^2 / 2^65 of n texts
            return rows
        rows = rows.withColumn("name", F.when(F.col("name").isin([x.name for x in clashes]), F.xxhash64("text", F.lit(seed))).otherwise(F.col("name")))
    raise RuntimeError("names of texts keep clashing")


def remove_repeats(docs: DataFrame, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, kept (the text without what repeats, binary), spans (start, stop of what was removed, uint32 pairs)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = named(rows)
    parts = scaled(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    dealt = dealt_anchors(rows.filter(F.octet_length("text") >= LENGTH), parts)
    dealt = cut(dealt, "anchors")
    judged = dealt.filter("kind = 0").groupBy("part").applyInArrow(_judge(parts, hot_classes), DEALT)
    marks = judged.union(dealt.filter("kind = 1")).groupBy("part").applyInArrow(_by_text, BY_TEXT)
    marks = cut(marks, "marks")
    asked = marks.filter("octet_length(wants) + octet_length(hot) > 0").select("name", "wants", "hot")
    fetched = contexts(rows.join(asked.hint("shuffle_hash"), "name"), parts)
    compared = fetched.groupBy("part").applyInArrow(_compare(parts), DEALT)
    more = compared.groupBy("part").applyInArrow(_by_text, BY_TEXT).select("name", F.col("spans").alias("more"))
    both = rows.join(marks.select("name", "spans").hint("shuffle_hash"), "name", "left").join(more.hint("shuffle_hash"), "name", "left")
    return both.select("doc_id", "text", "spans", "more").mapInArrow(_removed, "doc_id long, n_bytes long, kept binary, spans binary")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"n_bytes": [], "kept": [], "spans": []}
        for text, one, two in zip(*(batch.column(k).to_pylist() for k in ("text", "spans", "more")), strict=True):
            raw = text.encode()
            spans = np.frombuffer((one or b"") + (two or b""), MARK).copy()
            spans["name"] = 0
            spans = merged(spans)
            kept, at = [], 0
            for start, stop in zip(spans["start"].tolist(), spans["stop"].tolist(), strict=True):
                kept.append(raw[at:start])
                at = stop
            kept.append(raw[at:])
            out["n_bytes"].append(len(raw))
            out["kept"].append(b"".join(kept))
            out["spans"].append(np.stack((spans["start"], spans["stop"]), axis=1).astype("<u4").tobytes())
        columns = [batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "spans"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.expr("cast(octet_length(spans) div 8 as long)").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
