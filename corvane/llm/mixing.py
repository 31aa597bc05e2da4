"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

Each source's documents are dealt into blocks in doc_id order. With weight w (its share of the slots), block j of a source is released
at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot goes to the released block with the earliest deadline. So
after any number of slots, each source has had its share of them to within less than one block, as long as all sources last.
Weights are taken exactly, as whole numbers in their ratio; the slots of one period are their sum. The schedule repeats with the period, so one
period is planned, whatever the size of the input; documents find their slot by block number. No document is dropped: when a source has run out, its slots stay empty and
the order of the others stands.

Ranks within a source are counted by ranges of doc_id, which are quantiles, so that hashed or outlying ids and a source which holds a third of all rows
are not one task: counts of ranges first, then rows within a range. Null doc_ids come first, dealt into ranges of their own. Null sources
count as one source, named by the empty text. Rows that repeat a doc_id have ranks of their own. An empty table gives an empty result. Other columns
pass through in_mixed_order, whatever their names.
"""

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.session import documents, range_of

#: Target weights; a source that is not named has weight 1.
TARGETS = {"src0": 6.0, "src1": 3.0, "src2": 2.0}
#: Weights need a common denominator of this at most, which bounds the period by the number of sources.
MAX_DENOMINATOR = 10_000
#: Up to so many slots and sources, the plan is broadcast; beyond, it is joined by shuffles.
BROADCAST_ROWS = 200_000
BLOCK_DOCS = 16
RANGE_ROWS = 4_000
NULL_RANGES = 64

_PLAN = """
aggregate(sequence(0, period - 1), named_struct('given', array_repeat(0L, size(quotas)), 'picks', cast(array() as array<int>)),
  (state, slot) -> transform(array(array_min(transform(
      filter(sequence(0, size(quotas) - 1), i -> state.given[i] < quotas[i] and state.given[i] * period div quotas[i] <= slot),
      i -> struct(((state.given[i] + 1) * period + quotas[i] - 1) div quotas[i] as deadline, i as i))).i),
    best -> named_struct('given', transform(state.given, (n, i) -> if(i = best, n + 1, n)), 'picks', array_append(state.picks, best)))[0]).picks
"""


def quotas(sources: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """source, quota: slots of a period, in the exact ratio of the weights. sources: a small dimension with a row for each source."""
    exact = {k: Fraction(str(v)) for k, v in (TARGETS if targets is None else targets).items()}
    whole = math.lcm(*[x.denominator for x in exact.values()])
    if whole > MAX_DENOMINATOR or min(exact.values(), default=1) <= 0:
        raise ValueError(f"weights must be positive, with a common denominator of {MAX_DENOMINATOR} at most")
    quota = F.lit(whole)
    for name, value in exact.items():
        quota = F.when(F.col("source") == name, F.lit(int(value * whole))).otherwise(quota)
    return sources.select("source", quota.cast("long").alias("quota"))


def plan(shares: DataFrame) -> DataFrame:
    """One period: source, quota, period, k (block of the source in the period), slot, release, deadline."""
    row = shares.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("all"))
    row = row.filter("size(all) > 0").selectExpr("all.source as names", "all.quota as quotas", "aggregate(all, 0L, (a, x) -> a + x.quota) as period")
    picks = row.select("names", "quotas", "period", F.posexplode(F.expr(_PLAN)).alias("slot", "i"))
    slots = picks.selectExpr("names[i] as source", "quotas[i] as quota", "period", "cast(slot as long) as slot")
    k = F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1
    return slots.withColumn("k", k).selectExpr("source", "quota", "period", "k", "slot", "k * period div quota as release", "((k + 1) * period + quota - 1) div quota as deadline")


def ranks(docs: DataFrame) -> DataFrame:
    """row (docs' columns as a struct), doc_id, source, rank: the place in the source by doc_id, from 0."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"))
    # null ids have no order among them
    dealt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(NULL_RANGES)).cast("int") - NULL_RANGES).otherwise(range_of(rows, "doc_id", RANGE_ROWS))
    rows = rows.withColumn("range", dealt)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).select("source", "range", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("source", "range").orderBy("doc_id"))
    return rows.withColumn("within", within).join(starts, ["source", "range"]).select("row", "doc_id", "source", (F.col("start") + F.col("within") - 1).alias("rank"))


def scheduled(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """row, doc_id, source, block, slot, release, deadline, place for each row."""
    sources = docs.select(F.coalesce("source", F.lit("")).alias("source")).distinct()
    shares = quotas(sources, targets)
    planned = plan(shares)
    if (shares.agg(F.sum("quota")).first()[0] or 0) <= BROADCAST_ROWS:
        shares, planned = F.broadcast(shares), F.broadcast(planned)
    ranked = ranks(docs).withColumn("block", F.expr(f"rank div {block_docs}"))
    timed = ranked.join(shares, "source").withColumn("k", F.expr("block % quota")).drop("quota")
    slots = timed.join(planned, ["source", "k"])
    shift = "block div quota * period"
    return slots.selectExpr("row", "doc_id", "source", "block", f"{shift} + slot as slot", f"{shift} + release as release", f"{shift} + deadline as deadline", f"rank % {block_docs} as place")


def mix(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, place for each row; reading by (slot, place) gives the mix."""
    return scheduled(docs.select("doc_id", "source"), targets, block_docs).drop("row")


def in_mixed_order(docs: DataFrame, parts: int, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs with all columns, in the mix's order: partitions are ranges of slots, sorted within."""
    placed = scheduled(docs, targets).select("row", "slot", "place")
    return placed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "source"))


_CASES = " ".join(f"WHEN '{k}' THEN {int(v)}" for k, v in TARGETS.items())
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
q AS (SELECT source, CAST(CASE source {_CASES} ELSE 1 END AS BIGINT) AS q, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM d)),
a AS (SELECT list(q ORDER BY i) AS qs, CAST(sum(q) AS BIGINT) AS p FROM q),
s(t, c, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(qs, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, k: CASE WHEN k = best THEN x + 1 ELSE x END), best FROM (
    SELECT t, c, CAST(list_min(list_filter(list_transform(qs, lambda x, k: CASE WHEN c[k] < x AND (c[k] * p) // x <= t + 1
      THEN ((c[k] + 1) * p + x - 1) // x * 1000000 + k END), lambda z: z IS NOT NULL)) % 1000000 AS BIGINT) AS best FROM s, a WHERE t + 1 < p)),
pl AS (SELECT q.source, q.q, a.p, s.t AS slot, row_number() OVER (PARTITION BY q.source ORDER BY s.t) - 1 AS k FROM s JOIN q ON q.i = s.pick, a),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM d),
b AS (SELECT r.*, rank // {BLOCK_DOCS} AS block, q.q FROM r JOIN q USING (source))
SELECT b.doc_id, b.source, b.block, b.block // b.q * pl.p + pl.slot AS slot, b.block // b.q * pl.p + pl.k * pl.p // b.q AS release,
  b.block // b.q * pl.p + ((pl.k + 1) * pl.p + b.q - 1) // b.q AS deadline, b.rank % {BLOCK_DOCS} AS place
FROM b JOIN pl ON pl.source = b.source AND pl.k = b.block % b.q
"""
