"""Graph convolution and self-supervised embeddings under a walk-forward schedule.

Normalised adjacency and propagation with fixed weights are relational. Training is numpy with gradients in closed form, one task for each refit:
refits draw their own weights and so are independent of each other.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.config import Config

VALIDATION = 0.2


def normalised_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """date, node, other, w: D^-1/2 (A + I) D^-1/2 in both directions; degrees are bounded below, weights are not."""
    loops = nodes.select("date", "node", F.col("node").alias("other"), F.lit(1.0).alias("w"))
    both = edges.select("date", F.col("a").alias("node"), F.col("b").alias("other"), F.col("weight").alias("w")).union(edges.select("date", "b", "a", "weight")).union(loops)
    degree = both.groupBy("date", "node").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("d"))
    out = both.join(degree, ["date", "node"]).join(degree.toDF("date", "other", "e"), ["date", "other"])
    return out.select("date", "node", "other", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def propagate(adjacency: DataFrame, features: DataFrame, columns: list[str], weights: list[list[float]], relu: bool = False) -> DataFrame:
    """date, node, h0, h1, ...: adjacency times features times weights, with ReLU if asked. features: date, node, columns."""
    mixed = [sum((F.col(c) * F.lit(w[k]) for c, w in zip(columns, weights, strict=True)), F.lit(0.0)).alias(f"h{k}") for k in range(len(weights[0]))]
    sent = features.select("date", F.col("node").alias("other"), *mixed)
    names = [f"h{k}" for k in range(len(weights[0]))]
    out = adjacency.join(sent, ["date", "other"]).groupBy("date", "node").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
    return out.select("date", "node", *[F.greatest(F.col(n), F.lit(0.0)).alias(n) if relu else n for n in names])


def fixed_weights(rows: int, columns: int, seed: int) -> list[list[float]]:
    """Weights by a rule, for comparing engines."""
    return [[((i * 31 + j * 17 + seed * 7) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


def corrupted(x: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """date, node, donor, columns: each node of a date gets the features of the node that a shuffle puts in its place. The shuffle orders by a hash, which any engine can make."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("date").cast("string"), F.col("node")))
    placed = x.withColumn("_place", F.row_number().over(Window.partitionBy("date").orderBy("node"))).withColumn("_turn", F.row_number().over(Window.partitionBy("date").orderBy(key, "node")))
    given = placed.select("date", F.col("_turn").alias("_place"), F.col("node").alias("donor"), *columns)
    return placed.select("date", "node", "_place").join(given, ["date", "_place"]).select("date", "node", "donor", *columns)


def discriminate(z: DataFrame, judged: DataFrame, columns: list[str], weights: list[list[float]]) -> DataFrame:
    """date, node, logit = row' W s of judged's rows, with s the squashed mean of z's rows of the date."""
    summary = z.groupBy("date").agg(*[(1 / (1 + F.exp(-F.avg(c)))).alias(f"_s_{c}") for c in columns])
    logit = sum((F.col(a) * F.lit(w) * F.col(f"_s_{b}") for a, row in zip(columns, weights, strict=True) for b, w in zip(columns, row, strict=True)), F.lit(0.0))
    return judged.join(summary, "date").select("date", "node", logit.alias("logit"))


def head_loss(z: DataFrame, target: DataFrame, columns: list[str], weights: list[float], bias: float) -> DataFrame:
    """date, n_known, mse of a linear head over known targets; 0 where none is known. z: date, node, columns; target: date, node, y."""
    guess = sum((F.col(c) * F.lit(w) for c, w in zip(columns, weights, strict=True)), F.lit(bias))
    joined = z.join(target, ["date", "node"], "left")
    return joined.groupBy("date").agg(F.count("y").alias("n_known"), F.coalesce(F.avg((guess - F.col("y")) ** 2), F.lit(0.0)).alias("mse"))


def weight_draws(spark, sizes: list[int], seed: int) -> DataFrame:
    """layer, i, j, w, bound: the weights that a fresh encoder of these sizes starts with."""
    drawn = Encoder(sizes, 0.0, np.random.default_rng(seed)).weights
    rows = [(k, i, j, float(x), float((6 / sum(w.shape)) ** 0.5)) for k, w in enumerate(drawn) for (i, j), x in np.ndenumerate(w)]
    return spark.createDataFrame(rows, "layer int, i int, j int, w double, bound double")


def normalise(a: np.ndarray) -> np.ndarray:
    with_loops = a + np.eye(len(a))
    scale = 1 / np.sqrt(np.maximum(with_loops.sum(1), 1e-12))
    return with_loops * scale[:, None] * scale[None, :]


def kaiming(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    """For comparison: uniform weights that keep the variance through a ReLU."""
    bound = (6 / rows) ** 0.5
    return rng.uniform(-bound, bound, (rows, columns))


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    bound = (6 / (rows + columns)) ** 0.5
    return rng.uniform(-bound, bound, (rows, columns))


def corrupt(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows in another order: each node gets another's features."""
    return x[rng.permutation(len(x))]


class Encoder:
    """Graph convolutions without bias; ReLU and dropout between layers and none after the last."""

    def __init__(self, sizes: list[int], dropout: float, rng: np.random.Generator):
        self.weights = [glorot(rng, a, b) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.dropout = dropout

    def forward(self, x: np.ndarray, a: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Output and what backward needs. rng: draws dropout; none in evaluation."""
        kept, h = [], x
        for k, w in enumerate(self.weights):
            inner = a @ h
            h = inner @ w
            gate = None
            if k < len(self.weights) - 1:
                gate = (h > 0).astype(float)
                if rng is not None and self.dropout > 0:
                    gate *= (rng.random(h.shape) >= self.dropout) / (1 - self.dropout)
                h = h * gate
            kept.append((inner, gate))
        return h, kept

    def backward(self, a: np.ndarray, kept: list, slope: np.ndarray) -> list[np.ndarray]:
        out = [None] * len(self.weights)
        for k in range(len(self.weights) - 1, -1, -1):
            inner, gate = kept[k]
            if gate is not None:
                slope = slope * gate
            out[k] = inner.T @ slope
            slope = a.T @ (slope @ self.weights[k].T)
        return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def infomax(z: np.ndarray, zc: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of telling real from corrupt nodes by z' W s with s the squashed mean of the real ones; slopes for z, zc, w."""
    n = len(z)
    s = _sigmoid(z.mean(0))
    v = w @ s
    real, fake = z @ v, zc @ v
    loss = float((_softplus(-real).sum() + _softplus(fake).sum()) / (2 * n))
    dr, df = -(1 - _sigmoid(real)) / (2 * n), _sigmoid(fake) / (2 * n)
    dv = z.T @ dr + zc.T @ df
    dz = np.outer(dr, v) + ((w.T @ dv) * s * (1 - s))[None, :] / n
    return loss, dz, np.outer(df, v), np.outer(dv, s)


def masked_mse(guess: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean square over known targets, and its slope; 0 if none is known."""
    known = np.isfinite(y)
    slope = np.zeros(len(y))
    if not known.any():
        return 0.0, slope
    slope[known] = 2 * (guess[known] - y[known]) / known.sum()
    return float(((guess[known] - y[known]) ** 2).mean()), slope


class Model:
    def __init__(self, in_dim: int, config: Config, seed: int):
        m, rng = config.model, np.random.default_rng(seed)
        self.encoder = Encoder([in_dim] + [m.hidden] * (m.layers - 1) + [m.embed], m.dropout, rng)
        self.judge = glorot(rng, m.embed, m.embed)
        self.head, self.bias = glorot(rng, m.embed, 1)[:, 0], np.zeros(1)
        self.vol_lambda = config.training.vol_lambda

    def parameters(self) -> list[np.ndarray]:
        return [*self.encoder.weights, self.judge, *([self.head, self.bias] if self.vol_lambda > 0 else [])]

    def load(self, values: list[np.ndarray]) -> None:
        for x, v in zip(self.parameters(), values, strict=True):
            x[...] = v

    def loss(self, dates: list[tuple], rng: np.random.Generator, train: bool) -> tuple[float, list[np.ndarray]]:
        """Mean over dates of (features, adjacency, target), and slopes."""
        total, slopes = 0.0, [np.zeros_like(x) for x in self.parameters()]
        drop = rng if train else None
        for x, a, y in dates:
            z, kept = self.encoder.forward(x, a, drop)
            zc, kept_c = self.encoder.forward(corrupt(x, rng), a, drop)
            loss, dz, dzc, dw = infomax(z, zc, self.judge)
            parts = [dw]
            if self.vol_lambda > 0:
                more, slope = masked_mse(z @ self.head + self.bias, y)
                loss += self.vol_lambda * more
                dz = dz + self.vol_lambda * np.outer(slope, self.head)
                parts += [self.vol_lambda * z.T @ slope, np.array([self.vol_lambda * slope.sum()])]
            total += loss
            if train:
                layers = [p + q for p, q in zip(self.encoder.backward(a, kept, dz), self.encoder.backward(a, kept_c, dzc), strict=True)]
                for have, add in zip(slopes, [*layers, *parts], strict=True):
                    have += add / len(dates)
        return total / len(dates), slopes


def train(dates: list[tuple], config: Config, seed: int) -> tuple[Model, dict]:
    """Adam with L2 on the slopes, a step an epoch; stops early on the last fifth of dates and keeps the best weights."""
    t = config.training
    n_val = max(1, int(VALIDATION * len(dates)))
    if len(dates) - n_val < 1:
        raise ValueError(f"{len(dates)} dates leave none to train on")
    fit, aside = dates[: len(dates) - n_val], dates[len(dates) - n_val :]
    model, rng = Model(dates[0][0].shape[1], config, seed), np.random.default_rng([seed, 1])
    m = [np.zeros_like(x) for x in model.parameters()]
    v = [np.zeros_like(x) for x in model.parameters()]
    curves, best, kept, at, stopped = ([], []), np.inf, None, 0, False
    for epoch in range(1, t.epochs + 1):
        loss, slopes = model.loss(fit, rng, True)
        for x, g, a, b in zip(model.parameters(), slopes, m, v, strict=True):
            g = g + t.weight_decay * x
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= t.lr * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.999**epoch)) + 1e-8)
        now, _ = model.loss(aside, np.random.default_rng([seed, 2]), False)
        curves[0].append(loss)
        curves[1].append(now)
        if now < best:
            best, at, kept = now, epoch, [x.copy() for x in model.parameters()]
        elif epoch - at >= t.patience:
            stopped = True
            break
    model.load(kept)
    return model, {"epochs": len(curves[0]), "best_epoch": at, "early_stop": stopped, "train_first": curves[0][0], "train_final": curves[0][at - 1], "val_best": best, "train_curve": curves[0], "val_curve": curves[1]}


def effective_rank(z: np.ndarray) -> float:
    s = np.linalg.svd(z, compute_uv=False)
    p = s[s > 0] / s.sum() if s.sum() > 0 else np.ones(1)
    return float(np.exp(-(p * np.log(p)).sum()))


def schedule(dates: DataFrame, window: int, embargo: int, refit: int) -> DataFrame:
    """refit, ordinal, role (train or embed): dates of each refit; the last one embeds what is left. dates: ordinal from 0."""
    last = dates.agg((F.max("ordinal") + 1).alias("n")).filter(F.col("n") > window + embargo)
    refits = last.select("n", F.explode(F.expr(f"sequence(0, cast((n - 1 - {window + embargo}) div {refit} as int))")).alias("refit"))
    start = F.col("refit") * refit
    stop = F.least(start + window + embargo + refit, F.col("n").cast("int"))
    at = lambda a, b: F.explode(F.sequence(a, b - 1)).alias("ordinal")
    fit = refits.select("refit", F.lit("train").alias("role"), at(start, start + window))
    return fit.union(refits.select("refit", F.lit("embed"), at(start + window + embargo, stop))).select("refit", "role", F.col("ordinal").cast("int").alias("ordinal"))


def walk_forward(x: DataFrame, edges: DataFrame, target: DataFrame, dates: DataFrame, config: Config) -> DataFrame:
    """refit, date, ticker, z array<float>, log: embeddings of each refit's dates, and a row without ticker with its log as JSON. Dates before the first embedded one have no row.

    A refit's dates, features and edges meet in one task; their number is set by the schedule, not by the length of history.
    """
    names = [c for c in x.columns if c not in ("date", "ticker")]
    plan = schedule(dates, config.training.window, config.training.embargo, config.training.refit).join(dates.select("ordinal", "date"), "ordinal")
    rows = x.join(target.select("date", "ticker", "y"), ["date", "ticker"], "left").select("date", "ticker", F.array(*names).alias("x"), "y")
    left, right = plan.join(rows, "date"), plan.select("refit", "date").distinct().join(edges.select("date", "a", "b", "weight"), "date")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own beside the other side's

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        refit = key[0].as_py()
        table, links = one.to_pandas().sort_values(["date", "ticker"]), two.to_pandas()
        tickers = sorted(table["ticker"].unique())
        place = {t: i for i, t in enumerate(tickers)}
        made = {}
        for date, part in table.groupby("date"):
            part = part.set_index("ticker").reindex(tickers)
            a = np.zeros((len(tickers), len(tickers)))
            own = links[links["date"] == date]
            i, j = own["a"].map(place).to_numpy(int), own["b"].map(place).to_numpy(int)
            a[i, j] = a[j, i] = own["weight"]
            made[date] = (np.stack(part["x"].to_list()), normalise(a), part["y"].to_numpy(float))
        roles = table.drop_duplicates("date").set_index("date")["role"]
        model, log = train([made[d] for d in roles.index if roles[d] == "train"], config, config.training.seed + refit)
        out = {"date": [], "ticker": [], "z": []}
        ranks, spreads, skill = [], [], []
        for date in (d for d in roles.index if roles[d] == "embed"):
            features, a, y = made[date]
            z, _ = model.encoder.forward(features, a)
            ranks.append(effective_rank(z))
            spreads.append(float(z.var(0).mean()))
            known = np.isfinite(y)
            if model.vol_lambda > 0 and known.sum() >= 3:
                skill.append(spearman((z @ model.head + model.bias)[known], y[known]))
            for t, row in zip(tickers, z, strict=True):
                out["date"].append(date)
                out["ticker"].append(t)
                out["z"].append(row.astype(np.float32))
        log |= {"erank_mean": float(np.mean(ranks)), "erank_min": float(np.min(ranks)), "var_mean": float(np.mean(spreads)), "vol_spearman": float(np.mean(skill)) if skill else None, "n_embed": len(ranks)}
        n = len(out["date"])
        return pa.table(
            {
                "refit": pa.array([refit] * (n + 1), pa.int32()),
                "date": pa.array([*out["date"], roles.index[0]], pa.date32()),
                "ticker": pa.array([*out["ticker"], None], pa.string()),
                "z": pa.array([*out["z"], None], pa.list_(pa.float32())),
                "log": pa.array([None] * n + [json.dumps(log)], pa.string()),
            }
        )

    return left.groupBy("refit").cogroup(right.groupBy("refit")).applyInArrow(run, "refit int, date date, ticker string, z array<float>, log string")


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    def ranks(v):
        order = np.argsort(v, kind="stable")
        out = np.empty(len(v))
        out[order] = np.arange(1, len(v) + 1)
        _, back, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.bincount(back, out) / counts)[back]

    x, y = ranks(a), ranks(b)
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else float("nan")


def spearman_by(df: DataFrame, x: str, y: str, by: str = "date") -> DataFrame:
    """by, rho: rank correlation with ties sharing their mean rank; pairs with a null go first; null under three pairs."""
    from corvane.functions.stats import average_rank

    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = both.select(by, average_rank("_x", by).alias("rx"), average_rank("_y", by).alias("ry"))
    return ranked.groupBy(by).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("rx", "ry")).alias("rho"))


def embedding_variance(z: DataFrame, columns: list[str]) -> DataFrame:
    """date, variance: population variance of each dimension over nodes, averaged."""
    return z.groupBy("date").agg((sum((F.var_pop(c) for c in columns), F.lit(0.0)) / len(columns)).alias("variance"))


def spectra(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """date, erank, n90 (components for nine tenths of the variance), pca1, pca2 (shares of the first two)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        z = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        power = np.linalg.svd(z - z.mean(0), compute_uv=False) ** 2
        share = power / power.sum() if power.sum() > 0 else np.zeros(len(power))
        share = np.r_[share, 0.0]
        return pa.table({"date": pa.array([key[0].as_py()], pa.date32()), "erank": [effective_rank(z)], "n90": [int((np.cumsum(share) < 0.9).sum()) + 1], "pca1": [float(share[0])], "pca2": [float(share[1])]})

    return matrix.groupBy("date").applyInArrow(run, "date date, erank double, n90 long, pca1 double, pca2 double")


def adjacency_spectrum(adjacency: DataFrame) -> DataFrame:
    """date, lambda_max, lambda_2, lambda_min, n_ones of the normalised adjacency."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        wide = table.to_pandas().pivot(index="node", columns="other", values="w").fillna(0.0)
        values = np.linalg.eigvalsh(wide.to_numpy())[::-1]
        return pa.table({"date": pa.array([key[0].as_py()], pa.date32()), "lambda_max": [float(values[0])], "lambda_2": [float(values[1])], "lambda_min": [float(values[-1])], "n_ones": [int((np.abs(values - 1) < 1e-8).sum())]})

    return adjacency.groupBy("date").applyInArrow(run, "date date, lambda_max double, lambda_2 double, lambda_min double, n_ones long")


def consecutive(dates: DataFrame) -> DataFrame:
    """date, before: each date with the one before it."""
    return dates.select("date", F.lag("date").over(Window.orderBy("date")).alias("before"))
