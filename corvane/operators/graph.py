"""Per-date correlation graphs: windows, market-mode removal, shrunk correlation, nearest-neighbour edges, diagnostics.

Dense linear algebra on one date's window (sessions by assets) runs in a grouped Arrow function, one group a date; pairs, neighbours and
all graph measures are relational. Edge lists hold a < b once; a date's node table gives nodes without edges their rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stats import spectral_edge
from corvane.plans.config import Graph


def residualise(window: np.ndarray, n_factors: int) -> np.ndarray:
    """Centres a window and takes out its first principal components; with none asked, the window as it is."""
    if n_factors <= 0:
        return window.copy()
    centred = window - window.mean(axis=0)
    _, _, components = np.linalg.svd(centred, full_matrices=False)
    lead = components[:n_factors]
    return centred - centred @ lead.T @ lead


def shrunk_correlation(window: np.ndarray, method: str = "ledoit_wolf") -> tuple[np.ndarray, float]:
    """Correlation from a covariance shrunk to a multiple of the identity by the Ledoit-Wolf intensity, or from the sample's."""
    x = window - window.mean(axis=0)
    n, p = x.shape
    cov, intensity = x.T @ x / n, 0.0
    if method == "ledoit_wolf":
        mu = np.trace(cov) / p
        distance = (cov**2).sum() - 2 * mu * np.trace(cov) + p * mu**2
        noise = (((x**2).T @ (x**2)) / n - cov**2).sum() / n
        intensity = float(min(noise, distance) / distance) if distance > 0 else 0.0
        cov = (1 - intensity) * cov + intensity * mu * np.eye(p)
    elif method != "sample":
        raise ValueError(f"unknown shrinkage: {method}")
    scale = np.sqrt(np.diag(cov))
    if not (scale > 0).all():
        raise ValueError("a series has no variance in its window")
    corr = np.clip(cov / np.outer(scale, scale), -1, 1)
    np.fill_diagonal(corr, 1.0)
    return corr, intensity


def _dense(table: pa.Table) -> tuple[object, list[str], np.ndarray]:
    """A group's date, its tickers in order, and the window as sessions by tickers."""
    frame = table.select(["t", "ticker", "r"]).to_pandas()
    wide = frame.pivot(index="t", columns="ticker", values="r").sort_index(axis=1)
    return table.column("rebal")[0].as_py(), list(wide.columns), wide.to_numpy(float)


def _pair_table(date, tickers: list[str], matrix: np.ndarray, name: str) -> dict:
    i, j = np.triu_indices(len(tickers), 1)
    names = np.array(tickers, object)
    return {"date": pa.array([date] * len(i), pa.date32()), "a": pa.array(names[i], pa.string()), "b": pa.array(names[j], pa.string()), name: matrix[i, j]}


def correlations(windows: DataFrame, settings: Graph) -> DataFrame:
    """date, a, b, c for each pair of each rebalance date. windows: rebal, t, ticker, r."""
    n_factors, method = settings.n_factors, settings.shrinkage

    def run(table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        return pa.table(_pair_table(date, tickers, shrunk_correlation(residualise(window, n_factors), method)[0], "c"))

    return windows.groupBy("rebal").applyInArrow(run, "date date, a string, b string, c double")


def residual_windows(windows: DataFrame, n_factors: int) -> DataFrame:
    """rebal, t, ticker, r: windows without their first principal components."""

    def run(table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        left = residualise(window, n_factors)
        t = np.unique(table.column("t").to_numpy())
        return pa.table({"rebal": pa.array([date] * left.size, pa.date32()), "t": pa.array(np.repeat(t, len(tickers)), pa.int32()), "ticker": tickers * len(t), "r": left.ravel()})

    return windows.groupBy("rebal").applyInArrow(run, "rebal date, t int, ticker string, r double")


def spectra(windows: DataFrame, settings: Graph) -> DataFrame:
    """date, shrinkage, mean_corr, top_eigval_frac, n_eigs_above_mp."""
    n_factors, method = settings.n_factors, settings.shrinkage

    def run(table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        corr, intensity = shrunk_correlation(residualise(window, n_factors), method)
        values = np.linalg.eigvalsh(corr)
        upper = corr[np.triu_indices(len(tickers), 1)]
        edge = spectral_edge(len(tickers), len(window))
        return pa.table({"date": pa.array([date], pa.date32()), "shrinkage": [intensity], "mean_corr": [float(upper.mean())], "top_eigval_frac": [float(values[-1] / values.sum())], "n_eigs_above_mp": [int((values > edge).sum())]})

    return windows.groupBy("rebal").applyInArrow(run, "date date, shrinkage double, mean_corr double, top_eigval_frac double, n_eigs_above_mp long")


def shrinkage_intensity(windows: DataFrame) -> DataFrame:
    """date, shrinkage from moments, without a matrix: the Ledoit-Wolf closed form. Sums of pairs come from products of sessions (Gram sums), for N < T the N by N ones."""

    def run(table: pa.Table) -> pa.Table:
        date, tickers, window = _dense(table)
        x = window - window.mean(axis=0)
        n, p = x.shape
        gram = x.T @ x / n if p <= n else x @ x.T / n  # either has the same sum of squares and trace
        return pa.table({"date": pa.array([date], pa.date32()), "s2": [float((gram**2).sum())], "q": [float(((x**2).sum(1) ** 2).mean())], "tr": [float(np.trace(gram))], "p": [p], "n": [n]})

    total = windows.groupBy("rebal").applyInArrow(run, "date date, s2 double, q double, tr double, p long, n long")
    distance = F.col("s2") - F.col("tr") ** 2 / F.col("p")
    noise = (F.col("q") - F.col("s2")) / F.col("n")
    return total.select("date", F.when(distance > 0, F.least(noise, distance) / distance).otherwise(0.0).alias("shrinkage"))


def similarity(pairs: DataFrame, kind: str = "signed", column: str = "c") -> DataFrame:
    if kind not in ("signed", "absolute"):
        raise ValueError(f"unknown similarity: {kind}")
    return pairs.select("date", "a", "b", (F.abs(column) if kind == "absolute" else F.col(column)).alias("s"))


def ranked_neighbours(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """date, node, other, s, rank: each node's others from most to least similar, ties by name."""
    both = pairs.select("date", F.col("a").alias("node"), F.col("b").alias("other"), "s").union(pairs.select("date", "b", "a", "s"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("date", "node").orderBy(F.desc("s"), "other")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def knn_edges(ranked: DataFrame, k: int, symmetrise: str = "union", weighted: bool = True) -> DataFrame:
    """date, a, b, weight: an edge if either (union) or both (intersection) of its ends rank the other within k. A weight of zero is kept as a selected edge."""
    if symmetrise not in ("union", "intersection"):
        raise ValueError(f"unknown symmetrisation: {symmetrise}")
    if k < 1:
        raise ValueError("k must be 1 or more")
    near = ranked.filter(F.col("rank") <= k).groupBy("date", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"))
    return near.filter(F.col("n") >= (1 if symmetrise == "union" else 2)).select("date", "a", "b", (F.col("s") if weighted else F.lit(1.0)).alias("weight"))


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select("date", F.col("a").alias("node")).union(pairs.select("date", "b")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """date, node, degree; edges of weight zero are none here."""
    real = edges.filter("weight <> 0")
    ends = real.select("date", F.col("a").alias("node")).union(real.select("date", "b"))
    return nodes.join(ends.groupBy("date", "node").agg(F.count(F.lit(1)).alias("degree")), ["date", "node"], "left").select("date", "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def gini(counted: DataFrame, column: str = "degree", by: str = "date") -> DataFrame:
    """date, gini: 2 sum(i v) / (n sum(v)) - (n + 1) / n over values in order; 0 without a positive sum."""
    placed = counted.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(column)))
    sums = placed.groupBy(by).agg(F.sum(F.col("i") * F.col(column)).alias("iv"), F.sum(column).alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.select(by, F.when(F.col("v") > 0, 2.0 * F.col("iv") / (F.col("n") * F.col("v")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def component_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """date, node, label: the first name of the node's component. A date's graph of assets is small and is one task's union-find."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = sorted(left.column("node").to_pylist())
        parent = {x: x for x in names}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        dates = left.column("date").slice(0, 1).to_pylist() * len(names)
        return pa.table({"date": pa.array(dates, pa.date32()), "node": names, "label": [root(x) for x in names]})

    real = edges.filter("weight <> 0").select(*[F.col(c).alias(c) for c in ("date", "a", "b")])
    return nodes.groupBy("date").cogroup(real.groupBy("date")).applyInArrow(run, "date date, node string, label string")


def diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """date, n_edges, density, mean_degree, min_degree, max_degree, degree_gini, n_components, is_connected."""
    counted = degrees(edges, nodes)
    n = F.col("n")
    base = counted.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree")
    )
    parts = component_labels(edges, nodes).groupBy("date").agg(F.countDistinct("label").alias("n_components"))
    out = base.join(gini(counted).withColumnRenamed("gini", "degree_gini"), "date").join(parts, "date")
    return out.select(
        "date", "n_edges", (2.0 * F.col("n_edges") / (n * (n - 1))).alias("density"), "mean_degree", "min_degree", "max_degree", "degree_gini", "n_components", (F.col("n_components") == 1).alias("is_connected")
    )


def jaccard(one: DataFrame, two: DataFrame, dates: DataFrame) -> DataFrame:
    """date, jaccard of two graphs' edge sets at each of dates; 0 where both are empty."""
    x, y = (g.filter("weight <> 0").select("date", "a", "b", F.lit(1).alias(n)) for g, n in ((one, "x"), (two, "y")))
    met = x.join(y, ["date", "a", "b"], "full").groupBy("date").agg((F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)) / F.count(F.lit(1))).alias("j"))
    return dates.select("date").join(met, "date", "left").select("date", F.coalesce("j", F.lit(0.0)).alias("jaccard"))


def persistence(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """date, jaccard with the rebalance date before; the first date has none."""
    after = dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))
    shifted = edges.join(after, "date").filter("next is not null").select(F.col("next").alias("date"), "a", "b", "weight")
    return jaccard(edges, shifted, after.filter("next is not null").select(F.col("next").alias("date")))


def sweep(ranked: DataFrame, nodes: DataFrame, dates: DataFrame, settings: Graph) -> DataFrame:
    """A row for each k. ranked: neighbours to the largest k at least."""
    out = None
    for k in settings.k_sweep:
        edges = knn_edges(ranked, k, settings.symmetrise, settings.weighted)
        whole = diagnostics(edges, nodes).agg(F.avg("mean_degree").alias("mean_degree"), F.avg("density").alias("density"), F.avg(F.col("is_connected").cast("double")).alias("frac_dates_connected"))
        kept = persistence(edges, dates).agg(F.avg("jaccard").alias("mean_persistence"), F.stddev_pop("jaccard").alias("std_persistence"))
        row = whole.join(kept, F.lit(True)).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def edge_homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """date, raw, expected, adjusted: share of edges within a label, its value under random mixing, and (raw - expected) / (1 - expected). labels: node, label."""
    small = labels.select("node", "label")
    real = edges.filter("weight <> 0").join(small.toDF("a", "la"), "a").join(small.toDF("b", "lb"), "b")
    raw = real.groupBy("date").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("raw"))
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    expected = counts.agg((F.sum(F.col("c") ** 2) / F.sum("c") ** 2).alias("expected"))
    adjusted = F.when(F.col("expected") < 1, (F.col("raw") - F.col("expected")) / (1 - F.col("expected")))
    return raw.join(F.broadcast(expected), F.lit(True)).select("date", "raw", "expected", adjusted.alias("adjusted"))


def assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """date, assortativity: (tr e - sum a^2) / (1 - sum a^2) of the mixing matrix over both directions of edges."""
    small = labels.select("node", "label")
    real = edges.filter("weight <> 0").join(small.toDF("a", "la"), "a").join(small.toDF("b", "lb"), "b")
    both = real.select("date", "la", "lb").union(real.select("date", "lb", "la"))
    total = both.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("tr"))
    ends = both.groupBy("date", "la").agg(F.count(F.lit(1)).alias("c")).groupBy("date").agg(F.sum(F.col("c") ** 2).alias("c2"))
    square = F.col("c2") / F.col("n") ** 2
    return total.join(ends, "date").select("date", F.when(square < 1, (F.col("tr") - square) / (1 - square)).alias("assortativity"))


def pair_distances(x: DataFrame, names: list[str]) -> DataFrame:
    """date, a, b, d2 and a squared difference for each feature (d_name), for pairs a < b of a date."""
    one = x.select("date", F.col("ticker").alias("a"), *[F.col(n).alias(f"_{n}") for n in names])
    two = x.select("date", F.col("ticker").alias("b"), *names)
    each = [((F.col(f"_{n}") - F.col(n)) ** 2).alias(f"d_{n}") for n in names]
    met = one.join(two, "date").filter("a < b").select("date", "a", "b", *each)
    return met.withColumn("d2", sum((F.col(f"d_{n}") for n in names), F.lit(0.0)))


def smoothness(distances: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """date and, for each column of squared distances, its mean over edges by its mean over all pairs; null without edges or distance."""
    marked = distances.join(edges.filter("weight <> 0").select("date", "a", "b", F.lit(1).alias("edge")), ["date", "a", "b"], "left")
    on = lambda c: F.avg(F.when(F.col("edge") == 1, F.col(c)))
    return marked.groupBy("date").agg(*[F.when(F.avg(c) > 0, on(c) / F.avg(c)).alias(c) for c in columns])


def analyse(edges: DataFrame, labels: DataFrame, distances: DataFrame, name: str) -> DataFrame:
    """graph, date, homophily (raw, expected, adjusted), assortativity, smoothness."""
    out = edge_homophily(edges, labels).join(assortativity(edges, labels), "date").join(smoothness(distances, edges, ["d2"]).withColumnRenamed("d2", "smoothness"), "date")
    return out.select(F.lit(name).alias("graph"), "date", *out.columns[1:])


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """date, silhouette: mean over nodes of (b - a) / max(a, b) on Euclidean distance; alone in its label, a node counts 0."""
    d = distances.select("date", "a", "b", F.sqrt("d2").alias("d"))
    both = d.select("date", F.col("a").alias("node"), F.col("b").alias("other"), "d").union(d.select("date", "b", "a", "d"))
    small = labels.select("node", "label")
    mean = both.join(small, "node").join(small.toDF("other", "lo"), "other").groupBy("date", "node", "label", "lo").agg(F.avg("d").alias("d"))
    per = mean.groupBy("date", "node").agg(F.max(F.when(F.col("label") == F.col("lo"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("lo"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("date").agg(F.avg(value).alias("silhouette"))
