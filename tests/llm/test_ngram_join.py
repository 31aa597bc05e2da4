import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, docs, stored

from corvane.llm import components, ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    for a, (_, s) in enumerate(sets):
        near = {b for x in s for b in having[x] if b > a}
        for b in near:
            both = len(s & sets[b][1])
            if 100 * both >= 80 * (len(s) + len(sets[b][1]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], links[k]) for k, (i, s) in enumerate(sets))


def edited(words, rng, share):
    return " ".join(w if rng.random() > share else f"edit{rng.randint(0, 999)}" for w in words)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(4, 120))
        out += [edited(base, rng, share) for share in (0, 0, 0.01, 0.02, 0.04, 0.05)]
    out += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(60)]
    base = rng.choices(vocabulary, k=100)
    out += [edited(base, rng, 0.01) for _ in range(90)]
    return out


@pytest.mark.parametrize("case", ["awkward", "made", "sf", "empty"])
def test_op2(spark, sf_dir, tmp_path, case):
    folder = sf_dir
    if case != "sf":
        folder = stored(spark, tmp_path, docs(spark, {"awkward": AWKWARD * 2, "made": corpus(1), "empty": []}[case]))
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, ngram_join.op2_ngram_jaccard(spark, folder).collect())) == brute(rows)


def test_large_blocks_are_dealt_in_row_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 1500)
    texts = corpus(2)
    assert sorted(map(tuple, ngram_join.jaccard_join(docs(spark, texts)).collect())) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "x", "x", None]
    got = ngram_join.jaccard_join(docs(spark, texts, [None, 5, 7, 7, None])).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got if x.doc_id == 7] == [(1, 7, 1)] * 2
    assert [x.component_id for x in got if x.n_shingles == 2] == [5, 5]


def test_components(spark):
    rng = random.Random(5)
    links = [(a, rng.randrange(max(0, a - 3), a + 1)) for a in range(1, 300) if a % 29] + [(500 + i, 500) for i in range(50)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long").filter(F.lit(True))).collect()[0].label == 3


def test_classes_without_any_id_keep_their_links(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words + ["x"]), " ".join(words + ["x", "y"]), "other words than those " * 5]
    got = ngram_join.jaccard_join(docs(spark, texts, [None, None, 8, None])).collect()
    assert sorted(x.n_links for x in got) == [0, 2, 2, 2]
    assert sorted(str(x.component_id) for x in got) == ["8", "8", "8", "None"]
    got = ngram_join.row_groups(docs(spark, texts[:2], [None, None])).collect()
    assert [x.n_links for x in got] == [1, 1] and len({x.keep_row for x in got}) == 1
