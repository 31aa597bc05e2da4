import hashlib
import math
import re
import struct
import time
from collections import Counter
from datetime import date

import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, docs, stored

from corvane.llm import fingerprints, mixing, url_filter
from corvane.llm.session import range_of

TEXTS = AWKWARD + ["the quick brown fox jumps over the lazy dog " * 5, "the quick brown fox jumps over the lazy cat " * 5, "z"]


@pytest.mark.parametrize("case", ["awkward", "sf", "empty", "one"])
def test_op9(spark, sf_dir, tmp_path, case):
    folder = sf_dir
    if case != "sf":
        folder = stored(spark, tmp_path, docs(spark, {"awkward": TEXTS, "empty": [], "one": ["a b c d e f g h"]}[case]))
    rows = sorted((x.doc_id, x.text or "") for x in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {x.doc_id: x for x in fingerprints.op9_fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    bag = lambda t: Counter(w for w in __import__("re").split("[ \t\n\x0b\f\r]+", t.lower()) if w)
    prints, gaps = {}, []
    for k, (i, text) in enumerate(rows):
        n, q = len(text), len(text) // 4
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: n - q] + following[:q]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, x.fingerprint) == x.fingerprint
        a, b = bag(text), bag(edited)
        union = sum((a | b).values())
        gaps.append(x.near_edited - (sum((a & b).values()) / union if union else 1.0))
    if len(gaps) > 50:
        assert abs(sum(gaps) / len(gaps)) < 0.03 and max(map(abs, gaps)) < 0.4


def test_samples_agree_as_often_as_the_weights(spark):
    a, b = "x " * 6 + "y " * 3 + "q", "x " * 3 + "y " * 3 + "z z"
    rows = docs(spark, [a, b])
    counted = fingerprints.bags(rows, ["doc_id"])
    signed = fingerprints.signatures(counted, ["doc_id"], 1, 64)
    hits = 0
    for trial in range(12):  # words renamed: other hashes
        named = counted.withColumn("word", F.xxhash64("word", F.lit(trial)))
        one, two = (r.s0 for r in fingerprints.signatures(named, ["doc_id"], 1, 64).orderBy("doc_id").collect())
        hits += sum(x == y for x, y in zip(one, two))
    assert abs(hits / (12 * 64) - 6 / 12) < 0.07
    assert signed.count() == 2


def test_plain_fingerprints_of_equal_texts(spark):
    got = fingerprints.fingerprints(docs(spark, ["a b", "a b", "", None, "a b"], [1, 2, 3, 4, 1])).collect()
    assert len({x.fingerprint for x in got if x.doc_id < 3}) == 1 and {x.fingerprint for x in got if x.doc_id > 2} == {""}


def test_mix_keeps_every_source_within_a_block(spark):
    n = 6000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end").alias("source"))
    got = mixing.mix(rows, {"hot": 3.0, "s1": 2.0, "": 0.5}, block_docs=4).collect()
    assert sorted(x.doc_id for x in got) == list(range(n))
    weights = {"hot": 3.0, "s1": 2.0, "": 0.5, **{f"s{i}": 1.0 for i in (0, 2, 3, 4)}}  # deviations are from the target weights
    total = sum(weights.values())
    slots = {x.slot: x.source for x in got}
    assert all(x.release <= x.slot < x.deadline for x in got)
    last = {s: max(k for k, v in slots.items() if v == s) for s in weights}
    given = Counter()
    for t in range(min(last.values())):
        given[slots[t]] += 1
        assert all(abs(given[s] - (t + 1) * w / total) < 1 for s, w in weights.items())
    for s in weights:
        order = sorted((x.slot, x.place, x.doc_id) for x in got if x.source == s)
        assert [x[2] for x in order] == sorted(x[2] for x in order)


def test_mix_with_nulls_repeats_and_no_rows(spark):
    rows = docs(spark, ["t"] * 5, [None, 3, 3, None, 1], ["a", "a", "b", None, None])
    got = mixing.mix(rows, block_docs=2).collect()
    assert len(got) == 5 and {(x.source, x.block, x.place) for x in got} == {("a", 0, 0), ("a", 0, 1), ("b", 0, 0), ("", 0, 0), ("", 0, 1)}
    assert mixing.mix(docs(spark, [])).collect() == []


def brute_signature(text):
    """The samples of a text by loops, from the same hashes; None without words."""
    weights = Counter(x for x in re.split("[ \t\n\x0b\f\r]+", text.lower()) if x)
    xx = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed)
    uniform = lambda h, shift: ((h >> shift & (1 << 21) - 1) + 0.5) / (1 << 21)
    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for word, weight in weights.items():
            code = xx(word.encode(), 42)
            one, two = (xx(struct.pack("<i", 2 * k + i), xx(struct.pack("<Q", code), 42)) for i in (0, 1))
            r = -math.log(uniform(one, 0) * uniform(one, 21))
            b = uniform(two, 21)
            t = math.floor(math.log(weight) / r + b)
            key = math.log(-math.log(uniform(one, 42) * uniform(two, 0))) - r * (t - b + 1)
            packed = (int((key + 128) * (1 << 24)) << 31) | ((code ^ t << 12) & (1 << 31) - 1)
            best = packed if best is None else min(best, packed)
        out.append(best)
    return None if not weights else out


def test_op9_by_brute_force(spark, sf_dir):
    rows = sorted((x.doc_id, x.text or "") for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())[:60] + [(10**6 + i, t or "") for i, t in enumerate(TEXTS) if len(t or "") < 2_000]
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    alike = lambda a, b: float(a == b) if a is None or b is None else sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    text_of = lambda s: "".join(f"{x & (1 << 31) - 1:08x}" for x in s or [])
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        own, changed = brute_signature(text), brute_signature(text[: len(text) - n] + following[:n])
        assert got[i].fingerprint == text_of(own) and got[i].edited_fingerprint == text_of(changed)
        assert got[i].near_edited == alike(own, changed) and got[i].near_next == alike(own, brute_signature(following))


WIDE = [-(2**63), 5, 2**63 - 1, -(2**63) + 1, None, None, 5, 0]


def test_mix_with_ids_over_all_numbers_and_clashing_columns(spark):
    hashed = spark.range(20_000).select(F.xxhash64("id").alias("doc_id"), F.lit("h").alias("source"), F.lit(1).alias("row"), F.lit(2).alias("slot"), F.lit("x").alias("k"))
    got = mixing.mix(hashed, block_docs=1).orderBy("slot").collect()
    assert [x.doc_id for x in got] == sorted(x.doc_id for x in got) and len(got) == 20_000
    assert sorted(map(tuple, mixing.in_mixed_order(hashed, 3).collect())) == sorted(map(tuple, hashed.collect()))
    got = mixing.mix(docs(spark, ["t"] * len(WIDE), WIDE), block_docs=1).orderBy("slot").collect()
    assert [x.doc_id for x in got] == [None, None, -(2**63), -(2**63) + 1, 0, 5, 5, 2**63 - 1]


def test_ranges_hold_equal_shares_of_any_numbers(spark):
    rows = spark.range(40_000).select(F.expr("if(id % 4 = 0, xxhash64(id), id)").alias("v"))
    counts = [x["count"] for x in rows.withColumn("range", range_of(rows, "v", 1_000)).groupBy("range").count().collect()]
    assert len(counts) == 40 and max(counts) <= 1_500  # a quantile is off by a quarter of a range at most, at either end
    steps = rows.withColumn("range", range_of(rows, "v", 1_000)).groupBy("range").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("range").collect()
    assert all(x.b < y.a for x, y in zip(steps, steps[1:], strict=False))


def test_weights_without_a_small_denominator_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.quotas(spark.createDataFrame([("a",)], "source string"), {"a": 0.123456789})


def test_fingerprints_with_ids_over_all_numbers(spark):
    texts = [f"alpha beta gamma delta word{i}" for i in range(len(WIDE))]
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(docs(spark, texts, [x if i != 6 else 6 for i, x in enumerate(WIDE)]).filter("n_chars > 0")).collect()}
    assert set(got) == {-(2**63), 5, 2**63 - 1, -(2**63) + 1, None, 6, 0}
    following = {-(2**63): texts[3], -(2**63) + 1: texts[7], 0: texts[1], 5: texts[6], 6: texts[2]}
    for i, head in following.items():
        own = texts[WIDE.index(i) if i != 6 else 6]
        quarter = len(own) // 4
        assert got[i].edited_sha256 == hashlib.sha256((own[: len(own) - quarter] + head[:quarter]).encode()).hexdigest()


def test_fingerprints_with_null_and_repeated_ids(spark):
    texts = ["one two three", "four five six seven", None, "one two three", "eight nine ten eleven twelve"]
    got = fingerprints.edited_fingerprints(docs(spark, texts, [3, 3, None, None, 7])).collect()
    assert sorted((str(x.doc_id), x.n_chars) for x in got) == sorted((str(i), len(t or "")) for i, t in zip([3, 3, None, None, 7], texts, strict=True))
    by_text = {x.n_chars: x.fingerprint for x in got if x.doc_id == 3}
    assert by_text[13] in {x.fingerprint for x in got if x.doc_id is None} and len(set(by_text.values())) == 2


def captures(spark, rows):
    return spark.createDataFrame([(i, u, date.fromisoformat(d) if d else None) for i, (u, d) in enumerate(rows)], "id long, url string, fetched_on date")


def test_url_filter_uses_entries_of_the_fetch_date(spark):
    entries = spark.createDataFrame(
        [
            (1, "2024-01-10", "block", "domain", "Bad.example", "add"),
            (2, "2024-02-10", "block", "domain", "bad.example", "remove"),
            (3, "2024-03-10", "block", "domain", "bad.example", "add"),
            (4, "2024-03-20", "allow", "prefix", "bad.example/good", "add"),
            (5, "2024-01-01", "block", "word", "casino", "add"),
            (6, "2024-05-01", "block", "word", "twice", "add"),
            (7, "2024-05-01", "block", "word", "twice", "remove"),
        ],
        url_filter.ENTRY_SCHEMA,
    )
    rows = [
        ("http://bad.example/x", "2024-01-09"),
        ("http://bad.example/x", "2024-01-10"),
        ("http://sub.BAD.example:80/x", "2024-02-09"),
        ("http://bad.example/x", "2024-02-10"),
        ("https://user@bad.example/good/page?q=1", "2024-03-19"),
        ("https://user@bad.example/good/page?q=1", "2024-03-21"),
        ("http://notbad.example/", "2024-04-01"),
        ("http://fine.example/a/casino-win", "2024-04-01"),
        ("http://fine.example/twice", "2024-06-01"),
        (None, "2024-04-01"),
        ("", "2024-04-01"),
        ("no url at all casino", "2024-04-01"),
        ("http://bad.example/x", None),
    ]
    got = {x.id: x.blocked for x in url_filter.judge(captures(spark, rows), entries).collect()}
    assert [k for k, v in got.items() if v] == [k for k in got if k in (1, 2, 4, 7, 11)] and len(got) == len(rows)


def test_url_filter_on_repeated_captures_and_empty_lists(spark):
    entries = spark.createDataFrame([], url_filter.ENTRY_SCHEMA)
    twice = captures(spark, [("http://a.b/", "2024-01-01")])
    assert [x.blocked for x in url_filter.judge(twice.union(twice), entries).collect()] == [False, False]
    assert url_filter.judge(captures(spark, [("x", None)]).limit(0), entries).collect() == []


def test_url_filter_on_very_long_urls_and_clashing_columns(spark):
    entries = spark.createDataFrame([(1, "2024-01-01", "block", "prefix", "a.b/x/x/x", "add"), (2, "2024-01-01", "block", "domain", "b.c", "add")], url_filter.ENTRY_SCHEMA)
    urls = [("http://a.b" + "/x" * 60_000, "2024-02-01"), ("http://a.b/y" + "/x" * 60_000, "2024-02-01"), ("http://" + "d." * 30_000 + "b.c/", "2024-02-01"), ("http://a.b/" + "z" * 100_000, "2024-02-01")]
    frame = captures(spark, urls).withColumn("kind", F.lit(1)).withColumn("pattern", F.lit("p")).withColumn("host", F.lit(2)).withColumn("spans", F.lit(3))
    began = time.perf_counter()
    assert [x.blocked for x in url_filter.judge(frame, entries).orderBy("id").collect()] == [True, False, True, False]
    assert time.perf_counter() - began < 30


def test_made_list_grows_with_the_pages(spark):
    urls = spark.range(4_000).select(F.concat(F.lit("http://h"), F.col("id") % 90, F.lit(".example/p/"), F.col("id")).alias("url")).union(spark.createDataFrame([(None,), ("no url",)], "url string"))
    got = url_filter.made_list(urls).collect()
    assert {x.kind for x in got} == {"domain", "prefix"} and {x.action for x in got} == {"add", "remove"} and {x.list for x in got} == {"allow", "block"}
    assert 120 < len({x.pattern for x in got if x.kind == "prefix"}) < 280
