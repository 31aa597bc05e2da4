"""Mutual information of return series: the Gaussian value, binned and nearest-neighbour estimates, entropies, null floor.

Histograms are products of indicators within a date, then relational. The nearest-neighbour estimate is numpy in grouped Arrow functions, a task for each date and share of pairs.
"""

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import _dense
from corvane.plans.config import Information

RHO_BOUND = 1 - 1e-12
CHUNKS = 8
PAIRS_EACH = 64


def gaussian(c: Column) -> Column:
    bounded = F.least(F.greatest(c, F.lit(-RHO_BOUND)), F.lit(RHO_BOUND))
    return F.when(c.isNotNull(), -0.5 * F.log1p(-bounded * bounded))


def bins(windows: DataFrame, n: int = 6, scheme: str = "quantile") -> DataFrame:
    """rebal, t, ticker, bin: by quantile edges (equal ones count once) or equal widths; a value on an edge is in the lower bin."""
    if scheme == "quantile":
        edges = F.array_distinct(F.percentile("r", F.array(*[F.lit(i / n) for i in range(n + 1)])))
    elif scheme == "uniform":
        edges = F.array_distinct(F.array(*[F.min("r") + (F.max("r") - F.min("r")) * F.lit(i / n) for i in range(n + 1)]))
    else:
        raise ValueError(f"unknown bin scheme: {scheme}")
    of = windows.groupBy("rebal", "ticker").agg(edges.alias("edges"))
    place = F.size(F.filter("edges", lambda e: e < F.col("r"))) - 1
    held = F.greatest(F.lit(0), F.least(place, F.size("edges") - 2))
    return windows.join(of, ["rebal", "ticker"]).select("rebal", "t", "ticker", F.when(F.size("edges") < 2, 0).otherwise(held).alias("bin"))


def entropies(binned: DataFrame) -> DataFrame:
    """date, ticker, h in nats."""
    counts = binned.groupBy("rebal", "ticker", "bin").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("rebal", "ticker"))
    return counts.withColumn("p", p).groupBy(F.col("rebal").alias("date"), "ticker").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))


def joint_counts(placed: DataFrame) -> DataFrame:
    """rebal, a, b, x, y, n: sessions with a in bin x and b in bin y. A date's counts are one product of its indicator matrix with itself, so that only counts move."""

    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["t", "ticker", "bin"]).to_pandas()
        wide = frame.pivot(index="t", columns="ticker", values="bin").sort_index(axis=1)
        names, held = np.array(wide.columns, object), wide.to_numpy()
        width = int(np.nanmax(held)) + 1
        marks = (held[:, :, None] == np.arange(width)).reshape(len(held), -1).astype(np.float32)
        counts = np.rint(marks.T @ marks).astype(np.int64)
        i, j = np.nonzero(counts)
        keep = i // width < j // width
        i, j = i[keep], j[keep]
        date = pa.array([table.column("rebal")[0].as_py()] * len(i), pa.date32())
        return pa.table({"rebal": date, "a": pa.array(names[i // width], pa.string()), "b": pa.array(names[j // width], pa.string()), "x": pa.array(i % width, pa.int32()), "y": pa.array(j % width, pa.int32()), "n": counts[i, j]})

    return placed.groupBy("rebal").applyInArrow(run, "rebal date, a string, b string, x int, y int, n long")


def binned(joint: DataFrame, correct: bool = True) -> DataFrame:
    """date, a, b, mi: the plug-in value less (bx - 1)(by - 1) / 2T over non-empty bins, not under 0. joint: joint_counts' rows."""
    w = lambda *c: Window.partitionBy("rebal", "a", "b", *c)
    each = joint.select("*", F.sum("n").over(w()).alias("t"), F.sum("n").over(w("x")).alias("nx"), F.sum("n").over(w("y")).alias("ny"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    mi = F.sum(term) - ((F.countDistinct("x") - 1) * (F.countDistinct("y") - 1) / (2.0 * F.max("t")) if correct else 0.0)
    return each.groupBy(F.col("rebal").alias("date"), "a", "b").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def normalised(mi: DataFrame, h: DataFrame) -> DataFrame:
    """Adds nmi = mi / sqrt(ha hb) within [0, 1], 0 without entropy."""
    joined = mi.join(h.select("date", F.col("ticker").alias("a"), F.col("h").alias("ha")), ["date", "a"]).join(h.select("date", F.col("ticker").alias("b"), F.col("h").alias("hb")), ["date", "b"])
    size = F.sqrt(F.col("ha") * F.col("hb"))
    return joined.select("date", "a", "b", "mi", F.when(size > 0, F.least(F.greatest(F.col("mi") / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("nmi"))


def similarity(nmi: DataFrame, corr: DataFrame, signed: bool = True) -> DataFrame:
    """date, a, b, s, delta: nmi, where signed kept only for positive correlation, and what exceeds the Gaussian value."""
    joined = nmi.join(corr, ["date", "a", "b"])
    s = F.when(F.col("c") > 0, F.col("nmi")).otherwise(0.0) if signed else F.col("nmi")
    return joined.select("date", "a", "b", s.alias("s"), (F.col("mi") - gaussian(F.col("c"))).alias("delta"))


def bin_places(v: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    edges = np.unique(np.quantile(v, np.linspace(0, 1, n + 1)))
    if len(edges) < 2:
        return np.zeros(len(v), int), 1
    return np.clip(np.searchsorted(edges, v, "left") - 1, 0, len(edges) - 2), len(edges) - 1


def estimate_binned(x: np.ndarray, y: np.ndarray, n: int = 6) -> float:
    (a, na), (b, nb) = bin_places(x, n), bin_places(y, n)
    joint = np.bincount(a * nb + b, minlength=na * nb).reshape(na, nb) / len(x)
    px, py = joint.sum(1), joint.sum(0)
    i, j = np.nonzero(joint)
    plain = float((joint[i, j] * np.log(joint[i, j] / (px[i] * py[j]))).sum())
    return max(plain - ((px > 0).sum() - 1) * ((py > 0).sum() - 1) / (2 * len(x)), 0.0)


def digamma_table(n: int) -> np.ndarray:
    """Digamma at 0 (unused) to n: harmonic numbers less Euler's constant."""
    return np.r_[0.0, -0.5772156649015329 + np.r_[0.0, np.cumsum(1 / np.arange(1, n))]]


def estimate_ksg(x: np.ndarray, y: np.ndarray, k: int = 4, seed: int = 0) -> float:
    """The first estimator of Kraskov, Stoegbauer and Grassberger (2004), with ties broken by a little noise; not under 0."""
    n = len(x)
    rng = np.random.default_rng(seed)
    shaped = []
    for v in (x, y):
        scale = v.std() or 1.0
        v = v / scale
        shaped.append(v + 1e-10 * max(1.0, np.abs(v).mean()) * rng.standard_normal(n))
    dx, dy = (np.abs(v[:, None] - v[None, :]) for v in shaped)
    reach = np.partition(np.maximum(dx, dy), k, axis=1)[:, k]
    nx, ny = ((d < reach[:, None]).sum(1) - 1 for d in (dx, dy))
    psi = digamma_table(n + 1)
    return max(float(psi[n] + psi[k] - np.mean(psi[nx + 1] + psi[ny + 1])), 0.0)


ESTIMATORS = {"binned": estimate_binned, "ksg": estimate_ksg}


def estimator(name: str):
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {name}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def estimator_arguments(settings: Information) -> dict:
    return {"k": settings.n_neighbors} if settings.estimator == "ksg" else {"n": settings.bins}


def all_pairs(windows: DataFrame, settings: Information) -> DataFrame:
    """date, a, b, mi by an estimator on series: each pair once, dealt to tasks by date and share of pairs, of PAIRS_EACH or so."""
    assets = windows.select("ticker").distinct().count()
    shares_each = max(1, -(-assets * (assets - 1) // (2 * PAIRS_EACH)))
    estimate, more = estimator(settings.estimator), estimator_arguments(settings)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        i, j = np.triu_indices(len(tickers), 1)
        i, j = i[key[1].as_py() :: shares_each], j[key[1].as_py() :: shares_each]
        names = np.array(tickers, object)
        return pa.table({"date": pa.array([date] * len(i), pa.date32()), "a": pa.array(names[i], pa.string()), "b": pa.array(names[j], pa.string()), "mi": np.array([estimate(window[:, a], window[:, b], **more) for a, b in zip(i, j, strict=True)], float)})

    shares = windows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares_each - 1))))
    return shares.groupBy("rebal", "share").applyInArrow(run, "date date, a string, b string, mi double")


def sequence_meta(nmi: DataFrame, excess: DataFrame, floor: float = 0.0) -> DataFrame:
    """date, mean_mi, mean_nmi, mean_delta, frac_above_null over pairs. excess: date, a, b, delta; floor: the null's 95th percentile."""
    return nmi.join(excess.select("date", "a", "b", "delta"), ["date", "a", "b"]).groupBy("date").agg(
        F.avg("mi").alias("mean_mi"), F.avg("nmi").alias("mean_nmi"), F.avg("delta").alias("mean_delta"), F.avg((F.col("mi") > floor).cast("double")).alias("frac_above_null")
    )


def validate(spark, rhos: list[float], settings: Information, t: int = 252, trials: int = 20, seed: int = 0) -> DataFrame:
    """rho, estimator, mi_true, mean, std, bias on Gaussian draws; a task for each rho and trial."""
    estimators = {k: (f, {"n": settings.bins} if k == "binned" else {"k": settings.n_neighbors}) for k, f in ESTIMATORS.items()}

    def run(batches):
        for batch in batches:
            rows = {"rho": [], "estimator": [], "mi": []}
            for rho, trial in zip(batch.column("rho").to_pylist(), batch.column("trial").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, trial, int((rho + 1) * 1e6)])
                x, e = rng.standard_normal((2, t))
                y = rho * x + (1 - rho * rho) ** 0.5 * e
                for name, (f, more) in estimators.items():
                    for k, v in zip(rows, (rho, name, f(x, y, **more)), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("rho", pa.float64()), ("estimator", pa.string()), ("mi", pa.float64())]))

    asked = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*[F.lit(float(x)) for x in rhos])).alias("rho")).repartition(8)
    got = asked.mapInArrow(run, "rho double, estimator string, mi double")
    out = got.groupBy("rho", "estimator").agg(F.avg("mi").alias("mean"), F.stddev_pop("mi").alias("std")).withColumn("mi_true", gaussian(F.col("rho")))
    return out.withColumn("bias", F.col("mean") - F.col("mi_true"))


def null_draws(windows: DataFrame, settings: Information, seed: int = 0) -> DataFrame:
    """rebal, pair, mi: estimates on shuffled series of sampled pairs; the sample is the method's own."""
    estimate, more = estimator(settings.estimator), estimator_arguments(settings)
    pairs, perms = settings.n_pairs, settings.n_perm

    def run(key: tuple, table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        out, share = {"pair": [], "mi": []}, key[1].as_py()
        for p in range(share, pairs, CHUNKS):
            rng = np.random.default_rng([seed, p])
            a = int(rng.integers(len(tickers)))
            b = (a + int(rng.integers(1, len(tickers)))) % len(tickers)
            for _ in range(perms):
                out["pair"].append(p)
                out["mi"].append(estimate(window[:, a], rng.permutation(window[:, b]), **more))
        return pa.table({"date": pa.array([date] * len(out["mi"]), pa.date32()), "pair": pa.array(out["pair"], pa.int64()), "mi": pa.array(out["mi"], pa.float64())})

    shares = windows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1)))).repartition(CHUNKS, "rebal", "share")  # few bytes, much work: not to be coalesced
    return shares.groupBy("rebal", "share").applyInArrow(run, "date date, pair long, mi double")


def null_floor(draws: DataFrame) -> DataFrame:
    """date, mean, std, p95, p99, n_draws."""
    q = lambda p: F.percentile("mi", F.lit(p))
    return draws.groupBy("date").agg(F.avg("mi").alias("mean"), F.stddev_pop("mi").alias("std"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.count(F.lit(1)).alias("n_draws"))


def timings(windows: DataFrame, settings: Information, n_dates: int, n_pairs: int = 200) -> DataFrame:
    """date, estimator, assets, pair_s (seconds for a pair, from n_pairs timed on a window), total_s (for all pairs of n_dates such windows)."""
    more = {k: estimator_arguments(replace(settings, estimator=k)) for k in ESTIMATORS}

    def run(table: pa.Table) -> pa.Table:
        import time

        date, tickers, window = _dense(table)
        rng, rows = np.random.default_rng(0), []
        for name, estimate in ESTIMATORS.items():
            began = time.perf_counter()
            for _ in range(n_pairs):
                a = int(rng.integers(len(tickers)))
                estimate(window[:, a], window[:, (a + 1) % len(tickers)], **more[name])
            each = (time.perf_counter() - began) / n_pairs
            rows.append({"date": date, "estimator": name, "assets": len(tickers), "pair_s": each, "total_s": each * len(tickers) * (len(tickers) - 1) / 2 * n_dates})
        return pa.Table.from_pylist(rows, pa.schema([("date", pa.date32()), ("estimator", pa.string()), ("assets", pa.int32()), ("pair_s", pa.float64()), ("total_s", pa.float64())]))

    return windows.groupBy("rebal").applyInArrow(run, "date date, estimator string, assets int, pair_s double, total_s double")
