import hashlib
import random
from collections import Counter

import pytest
from tests.llm.helpers import AWKWARD, docs, stored

from corvane.llm import suffix_dedup as sd


def test_suffix_array_by_linear_grouping():
    rng = random.Random(0)
    texts = [[], [1], [1, 1, 1, 1], list(b"mississippi"), list(b"abababab"), list(b"graindraining"), list(range(30)), list(range(30))[::-1]]
    texts += [[rng.randrange(rng.choice((1, 2, 3, 20))) for _ in range(rng.randrange(60))] for _ in range(800)]
    for text in texts:
        order = sd.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        want = [0] * len(text)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            want[k] = next((h for h, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sd.common_prefixes(text, order) == want


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[k : k + 200] for _, raw in raws for k in range(len(raw) - 199))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    some = lambda n: "".join(rng.choices(letters, k=n))
    passages = [some(rng.randrange(150, 700)) for _ in range(12)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.choice((0, 0, rng.randrange(60)))
            b = len(p) - rng.choice((0, 0, rng.randrange(60)))
            piece = p[a:b]
            if rng.random() < 0.3:
                k = rng.randrange(len(piece))
                piece = piece[:k] + "X" + piece[k + 1 :]
            parts += [some(rng.choice((0, 1, 5, 90))), piece]
        out.append("".join(parts))
    out += ["For " * 90, "For " * 150 + "x", "z" * 199, "z" * 200, "y" * 201, "ab" * 300, some(3000), some(199)]
    for n in (2, 30):
        out += [some(500)] * n
    base = some(900)
    out += [base[:k] + "#" + base[k:] for k in range(0, 900, 37)]
    return out


@pytest.mark.parametrize("case", ["awkward", "made", "made again", "sf", "empty"])
def test_op5(spark, sf_dir, tmp_path, case):
    folder = sf_dir
    if case != "sf":
        texts = {"awkward": [*AWKWARD, None], "made": made(1), "made again": made(2), "empty": []}[case]
        folder = stored(spark, tmp_path, docs(spark, texts).repartition(3))
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, sd.op5_suffix_dedup(spark, folder).collect())) == brute(rows)


@pytest.mark.parametrize("hot_classes", [0, 3])
def test_hot_grams_are_judged_by_window(spark, hot_classes):
    header = "".join(random.Random(9).choices("abcdefgh ", k=260))
    texts = made(3) + [f"{i % 7}{header}{'xyz'[: i % 4]} {i % 11} tail {i}" * (1 + i % 2) for i in range(60)]
    frame = docs(spark, texts).repartition(4)
    want = {i: (kept, removed) for i, _, removed, _, kept in brute(list(enumerate(texts)))}
    got = {x.doc_id: (hashlib.sha256(x.kept).hexdigest(), x.n_bytes - len(x.kept)) for x in sd.remove_repeats(frame, hot_classes).collect()}
    assert got == want


def test_spans_of_null_and_repeated_ids(spark):
    text = "".join(random.Random(3).choices("abcd", k=300))
    got = sd.remove_repeats(docs(spark, [text, text, "x" + text], [None, 4, 4])).collect()
    assert sorted(bytes(x.kept) for x in got) == [b"", b"", b"x"]


def test_names_that_clash_are_dealt_anew(spark, monkeypatch):
    texts = ["".join(random.Random(i).choices("abcd", k=300)) for i in (1, 2, 3, 1, 2)]
    hashed = sd.F.xxhash64
    few = lambda *c: hashed(*c) % (1 if len(c) == 1 else 2**40)  # noqa: E731  all first names are the same
    monkeypatch.setattr(sd.F, "xxhash64", few)
    got = sd.named(docs(spark, texts).select("doc_id", "text")).orderBy("doc_id").collect()
    names = [x.name for x in got]
    assert names[0] == names[3] and names[1] == names[4] and len(set(names)) == 3


def test_occurrences_are_told_by_digests_of_their_bytes():
    rng = random.Random(4)
    passage = bytes(rng.choices(b"abcdef", k=400))
    texts = [passage, b"x" + passage, passage[:300] + b"y" * 100, passage]
    data = sd.np.frombuffer(b"".join(texts), sd.np.uint8)
    offsets = sd.np.cumsum([0, *map(len, texts)])
    pos, first, last, gram, around = sd.anchors(data, offsets)
    seen = {}
    for p, a, b, d in zip(pos, first, last, around.tolist()):
        key = (bytes(data[a : b + 200]), p - a, p - b)
        assert seen.setdefault(key, d) == d
    assert len({tuple(x) for x in seen.values()}) == len(seen)
