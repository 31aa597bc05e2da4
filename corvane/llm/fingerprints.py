"""Document fingerprints by consistent weighted sampling, in DataFrame operations.

A document is a bag of words (in lower case) with their counts as weights. Sample k draws, for each word, r and c from Gamma(2, 1) and b from (0, 1),
all from hashes of the word and k alone; with t = floor(ln(weight) / r + b), the word's key is c * exp(-r * (t - b + 1)), and the
sample is the (word, t) with the smallest key. Two documents' samples agree with the probability of their generalised Jaccard similarity,
the sum of minima over the sum of maxima of weights; so the share of agreeing samples estimates it.

Texts are dealt once by doc_id, and words, weights and samples are made within that partitioning. Keys are packed with the word's and t's hash into one
number, so that a sample is a plain minimum. A document's words stay together, as a document is the unit; a hot source or
group of copies is many documents and spreads.

Null text counts as empty. A text without words has the empty fingerprint, which is like another empty one (1.0) and unlike all others
(0.0). A null doc_id comes first in the order. Rows that repeat a doc_id are a document each, and follow the next distinct doc_id.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.session import cut, documents, range_of, scaled

SAMPLES = 32
AT_ONCE = 4
PART_BYTES = 6 << 20
RANGE_IDS = 100_000
#: Stands for null; below all 64-bit numbers.
_FIRST = Decimal(-(2**63) - 1)
_UNIT = 1.0 / (1 << 21)


def _uniform(h: Column, shift: int) -> Column:
    """In (0, 1), from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) * _UNIT


def sample(word: Column, log_weight: Column, seed: Column) -> Column:
    """The packed key of one of a word's samples: 32 bits of the key's logarithm, then 31 bits that name (word, t)."""
    one, two = F.xxhash64(word, seed), F.xxhash64(word, seed + 1)
    r = -F.log(_uniform(one, 0) * _uniform(one, 21))
    log_c = F.log(-F.log(_uniform(one, 42) * _uniform(two, 0)))
    b = _uniform(two, 21)
    t = F.floor(log_weight / r + b)
    key = log_c - r * (t - b + 1)
    name = word.bitwiseXOR(F.shiftleft(t.cast("long"), 12)).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(((key + 128) * (1 << 24)).cast("long"), 31).bitwiseOR(name)


def bags(texts: DataFrame, keys: list[str], kinds: int = 1) -> DataFrame:
    """keys, word (a hash), n0, n1, ...: counts of words in texts of each kind. texts: keys, text, kind where there are several."""
    words = texts.select(*keys, *(["kind"] if kinds > 1 else [F.lit(0).alias("kind")]), F.explode(F.split(F.lower("text"), "[ \\t\\n\\x0B\\f\\r]+")).alias("word")).filter("word <> ''")
    counts = [F.sum((F.col("kind") == i).cast("int")).alias(f"n{i}") for i in range(kinds)]
    return words.select(*keys, "kind", F.xxhash64("word").alias("word")).groupBy(*keys, "word").agg(*counts)


def signatures(counted: DataFrame, keys: list[str], kinds: int = 1, samples: int = SAMPLES) -> DataFrame:
    """keys, s0, s1, ...: for each kind an array of packed samples, null without words. counted: keys, word, n0, n1, ...

    A word with equal counts in all kinds is drawn for once. Samples are drawn a few to a row, so that the generated code stays small enough to be compiled.
    """
    weights = F.array_distinct(F.array(*[f"n{i}" for i in range(kinds)]))
    rows = counted.select(*keys, "word", *[f"n{i}" for i in range(kinds)], F.explode(weights).alias("w")).filter("w > 0")
    rows = rows.select(*keys, "word", F.log(F.col("w").cast("double")).alias("log_w"), *[(F.col(f"n{i}") == F.col("w")).alias(f"in{i}") for i in range(kinds)])
    rows = rows.select("*", F.explode(F.array(*[F.lit(g) for g in range(samples // AT_ONCE)])).alias("g"))
    packed = rows.select(*keys, "g", *[f"in{i}" for i in range(kinds)], *[sample(F.col("word"), F.col("log_w"), F.col("g") * (2 * AT_ONCE) + 2 * k).alias(f"p{k}") for k in range(AT_ONCE)])
    least = packed.groupBy(*keys, "g").agg(*[F.min(F.when(F.col(f"in{i}"), F.col(f"p{k}"))).alias(f"m{i}_{k}") for i in range(kinds) for k in range(AT_ONCE)])
    parts = [F.array(*[f"m{i}_{k}" for k in range(AT_ONCE)]).alias(f"s{i}") for i in range(kinds)]
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", *parts))).alias("all"))
    joined = [F.flatten(F.col(f"all.s{i}")) for i in range(kinds)]
    return whole.select(*keys, *[F.when(x[0].isNotNull(), x).alias(f"s{i}") for i, x in enumerate(joined)])


def fingerprint(signature: Column) -> Column:
    """A signature as text: eight hexadecimal digits a sample."""
    low = F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 31) - 1))), 8, "0"))
    return F.when(signature.isNull(), "").otherwise(F.lower(F.array_join(low, "")))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / samples
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same)


def successors(ids: DataFrame) -> DataFrame:
    """ids: distinct id. Adds next: the next one in order, the first after the last. Ranges of ids, which are quantiles, are windows of their own."""
    ranged = ids.withColumn("range", range_of(ids, "id", RANGE_IDS))
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    by_range = Window.orderBy("range")  # one row a range
    after = firsts.select("range", F.lead("first").over(by_range).alias("after"), F.first("first").over(by_range).alias("very_first"))
    inside = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    return ranged.withColumn("inside", inside).join(after, "range").select("id", F.coalesce("inside", "after", "very_first").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points replaced by as many of the next document's first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(_FIRST).cast("decimal(20,0)")).alias("id"), text.alias("text"))
    sizes = cut(rows.groupBy("id").agg(F.max(F.char_length("text")).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "sizes")
    parts = scaled(sizes.agg(F.sum("bytes")).first()[0] or 0, PART_BYTES)
    following = cut(sizes.join(successors(sizes.select("id")), "id").select("id", "next", F.expr("n div 4").alias("take")), "next")
    dealt = rows.repartition(parts, "id")
    # dealt to as many parts, so that the texts are dealt once for both joins
    asked = following.repartition(parts, "next").groupBy("next").agg(F.max("take").alias("take"), F.first("id").alias("for")).withColumnRenamed("next", "id")
    heads = dealt.join(asked.hint("shuffle_hash"), "id").select(F.col("for").alias("id"), F.substring("text", F.lit(1), F.col("take").cast("int")).alias("head"))
    heads = heads.repartition(parts, "id").groupBy("id").agg(F.min("head").alias("head"))
    joined = dealt.join(heads.hint("shuffle_hash"), "id").withColumn("n", F.char_length("text"))
    quarter = F.expr("n div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), F.substring("head", F.lit(1), quarter))
    made = joined.select("id", F.monotonically_increasing_id().alias("row"), "text", "n", edited.alias("edited"))
    # the third text is a note of what the others' rows don't carry; it has no space and so comes out as one word
    note = F.concat_ws(":", F.col("n").cast("string"), F.sha2("edited", 256))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), x.alias("text")) for i, x in enumerate((F.col("text"), F.col("edited"), note))])
    texts = made.select("id", "row", F.explode(kinds).alias("one")).select("id", "row", F.col("one.kind").alias("kind"), F.col("one.text").alias("text"))
    texts = texts.withColumn("note", F.when(F.col("kind") == 2, F.col("text")))
    keys = ["id", "row", "note"]
    counted = bags(texts, keys, 2)
    for n in ("n0", "n1"):  # a note counts as a word of both, in a group of its own
        counted = counted.withColumn(n, F.when(F.col("note").isNull(), F.col(n)).otherwise(1))
    signed = signatures(counted, keys, 2)
    only = lambda c: F.max(F.when(F.col("note").isNull(), F.col(c)))
    table = signed.groupBy("id", "row").agg(only("s0").alias("own"), only("s1").alias("changed"), F.max("note").alias("note"))
    table = cut(table.select("id", "own", "changed", F.split("note", ":").alias("note")), "signatures")
    firsts = table.groupBy("id").agg(F.min("own").alias("following")).withColumnRenamed("id", "next")
    out = table.join(following.select("id", "next"), "id").join(firsts, "next", "left")
    return out.select(
        F.when(F.col("id") > F.lit(_FIRST), F.col("id").cast("long")).alias("doc_id"),
        F.col("note")[0].cast("long").alias("n_chars"),
        F.col("note")[1].alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, text_key and fingerprint for each distinct (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("text_key", F.sha2("text", 256))
    keys = ["doc_id", "text_key"]
    signed = signatures(bags(rows, keys), keys, 1, samples)
    out = rows.select(*keys).alias("a").join(signed.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key"), "left")
    return out.select("a.doc_id", "a.text_key", fingerprint(F.col("s0")).alias("fingerprint"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))
