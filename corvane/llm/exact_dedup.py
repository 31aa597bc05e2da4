"""Exact dedup against a history, with a minimal perfect hash over the history's distinct digests.

Texts are equal when equal after all ASCII white space is deleted; they are compared by SHA-256 of what is left.
The history's distinct digests are dealt into buckets by prefix; each bucket gets a minimal perfect hash whose slots
hold the full digest and the winner's locator. New digests are reduced to one row each first, so that a group that holds a third
of all rows is one row by then, and are looked up in the slot their hash names: equal bytes make them repeats,
others are nonmembers and form groups of their own. Of equal texts the one with most code points stays, then the
smallest doc_id (null last), then the first row read.

Null text counts as empty; empty texts are equal to each other and to texts of white space only. Rows that repeat a doc_id are counted in
group_size and one of them stays. An empty table gives an empty result. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.session import cut, documents, scaled
from corvane.llm.textops import U, mix

#: Deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"
BUCKET_DIGESTS = 40_000
GAMMA = 2.0
LOCATOR = np.dtype([("n_chars", "<i8"), ("doc_id", "<i8"), ("no_id", "<i8"), ("row_id", "<i8"), ("size", "<i8")])
GROUP_SCHEMA = "digest binary, keep_row long, keep_id long, group_size long"


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, n_chars, digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest with its winner; Spark combines on the map side, so a hot digest costs one row a task."""
    # a bitwise complement turns the order of all 64-bit numbers round
    order = F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row_id").alias("row"))
    best = rows.groupBy("digest").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("size"))
    return best.select(
        "digest", F.col("best.n_chars").alias("n_chars"), F.bitwise_not(F.col("best.id")).alias("doc_id"), F.bitwise_not(F.col("best.row")).alias("row_id"), "size"
    )


class PerfectHash:
    """A minimal perfect hash: keys that collide on one level's bitmap go to the next; a slot is a key's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.unpackbits(x, bitorder="little").astype(np.int64) for x in levels]
        base, self.ranks = 0, []
        for x in counts:
            self.ranks.append(base + np.cumsum(x) - x)
            base += int(x.sum())
        self.bits = [x.astype(bool) for x in counts]

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1], level), level) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """keys: distinct, shape (n, 2)."""
        levels = []
        while len(keys):
            size = -(-max(8, int(GAMMA * len(keys))) // 8) * 8
            at = cls.position(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the hash already shows that a key is no member."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = self.position(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> "PerfectHash":
        levels, at = [], 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            levels.append(np.frombuffer(raw, np.uint8, n, at + 8))
            at += 8 + n
        return cls(levels)


def _digest_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :16]).view(U)


def _locators(table: pa.Table) -> np.ndarray:
    out = np.zeros(table.num_rows, LOCATOR)
    for k in ("n_chars", "row_id", "size"):
        out[k] = table.column(k).to_numpy()
    out["doc_id"] = table.column("doc_id").fill_null(0).to_numpy()
    out["no_id"] = table.column("doc_id").is_null().to_numpy()
    return out


def _build_bucket(table: pa.Table) -> pa.Table:
    digests = _digest_matrix(table.column("digest"))
    hashed = PerfectHash.build(_keys(digests))
    order = np.argsort(hashed.slots(_keys(digests)))
    columns = {
        "bucket": table.column("bucket").slice(0, 1),
        "hash": pa.array([hashed.dump()], pa.binary()),
        "digests": pa.array([digests[order].tobytes()], pa.binary()),
        "locators": pa.array([_locators(table)[order].tobytes()], pa.binary()),
    }
    return pa.table(columns)


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    prefix = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return df.withColumn("bucket", F.pmod(prefix, F.lit(buckets)).cast("int"))


def build_history(digests: DataFrame, buckets: int) -> DataFrame:
    """The index: a row for each bucket with its hash function, its slots' digests and its slots' locators."""
    return with_bucket(digests, buckets).groupBy("bucket").applyInArrow(_build_bucket, "bucket int, hash binary, digests binary, locators binary")


def _wins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where locator a stays rather than b."""
    keys = [(-a["n_chars"], -b["n_chars"]), (a["no_id"], b["no_id"]), (a["doc_id"], b["doc_id"]), (a["row_id"], b["row_id"])]
    out, tied = np.zeros(len(a), bool), np.ones(len(a), bool)
    for x, y in keys:
        out |= tied & (x < y)
        tied &= x == y
    return out


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """Groups of one bucket: the history's slots with their repeats added, and nonmembers as groups of their own."""
    fresh, found = _digest_matrix(new.column("digest")), _locators(new)
    slots_digest, slots = np.zeros((0, 32), np.uint8), np.zeros(0, LOCATOR)
    member = np.zeros(len(fresh), bool)
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        slots_digest = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        slots = np.frombuffer(row["locators"], LOCATOR).copy()
        if len(fresh):
            at = PerfectHash.load(row["hash"]).slots(_keys(fresh))
            member = (at >= 0) & (slots_digest[at] == fresh).all(axis=1)  # byte check
            mine, theirs = at[member], found[member]
            total = slots["size"][mine] + theirs["size"]
            better = _wins(theirs, slots[mine])
            slots[mine[better]] = theirs[better]
            slots["size"][mine] = total
    digests = np.concatenate((slots_digest, fresh[~member]))
    groups = np.concatenate((slots, found[~member]))
    return pa.table(
        {
            "digest": pa.array([x.tobytes() for x in digests], pa.binary()),
            "keep_row": pa.array(groups["row_id"], pa.int64()),
            "keep_id": pa.array(groups["doc_id"], pa.int64(), mask=groups["no_id"].astype(bool)),
            "group_size": pa.array(groups["size"], pa.int64()),
        }
    )


def groups_against(history: DataFrame, new: DataFrame) -> DataFrame:
    """Groups of equal texts over the history's and the new digest rows: digest, keep_row, keep_id, group_size."""
    old, fresh = distinct_digests(history), distinct_digests(new)
    buckets = scaled(history.count() + new.count(), BUCKET_DIGESTS)
    index = build_history(old, buckets)
    return index.groupBy("bucket").cogroup(with_bucket(fresh, buckets).groupBy("bucket")).applyInArrow(_look_up, GROUP_SCHEMA)


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_id (of monotonically_increasing_id).

    The older half of the rows by doc_id is the history and the rest is looked up in it.
    """
    rows = cut(digest_rows(docs), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    groups = groups_against(rows.filter(old), rows.filter(~old)).filter("group_size > 1")
    joined = rows.join(groups, "digest", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir, "doc_id", "text")).drop("row_id")


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY h) AS c,
      first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k FROM n)
SELECT doc_id, k AS keep_id, CAST(c AS BIGINT) AS group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""

