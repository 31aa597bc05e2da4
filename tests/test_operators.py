import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.stats import spectral_edge
from corvane.operators import clean, embedding, features, graph, information
from corvane.plans.config import WEEKLY, Config, Features, Information, Training, Universe

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def prices(spark, closes, volume=10.0):
    """closes: a list for each ticker, None where there is no row."""
    data = [(d, t, c, c, c, c, volume) for t, values in closes.items() for d, c in zip(days(10_000), values) if c is not None]
    return spark.createDataFrame(data, "date date, ticker string, open double, high double, low double, close double, volume double")


def returns_panel(spark, n, names, seed=0, betas=None):
    rng = np.random.default_rng(seed)
    market = rng.normal(0, 0.01, n)
    data = []
    for k, t in enumerate(names):
        r = (betas[k] if betas else 1.0) * market + rng.normal(0, 0.004, n)
        close = 100 * np.exp(np.cumsum(r))
        data += [(d, i, t, float(close[i]), float(r[i]) if i else None, float(rng.lognormal(16, 0.5))) for i, d in enumerate(days(n))]
    return spark.createDataFrame(data, "date date, pos int, ticker string, close double, log_ret double, dollar_volume double")


# cleaning


def test_fill_is_bounded_and_returns_span_the_gap(spark):
    values = {"A": [1.0] * 5 + [None] * 3 + [2.0] * 4, "B": [1.0] * 12}
    raw = prices(spark, values)
    calendar, kept = clean.sessions(raw), raw.select("ticker").distinct()
    got = {x.pos: x for x in clean.derive(clean.fill(clean.grid(raw, calendar, kept), 3)).filter("ticker = 'A'").collect()}
    assert [got[i].is_filled for i in range(5, 9)] == [True, True, True, False]
    assert got[6].log_ret is None and got[6].volume is None and got[8].log_ret == pytest.approx(math.log(2))
    wider = prices(spark, {"A": [1.0] * 5 + [None] * 4 + [2.0] * 3, "B": [1.0] * 12})
    with pytest.raises(ValueError, match="A"):
        clean.build_panel(wider, Universe(min_history=3, max_missing=0.9, min_coverage=0.1, start_tolerance=0), check=True)


def test_zero_volume_is_missing(spark):
    raw = prices(spark, {"A": [1.0] * 4}, volume=0.0)
    assert clean.fill(clean.grid(raw, clean.sessions(raw), raw.select("ticker").distinct()), 3).filter("volume is not null").count() == 0


@pytest.mark.parametrize(("tolerance", "kept"), [(0, ["DAY0"]), (3, ["DAY0", "DAY3"]), (7, ["DAY0", "DAY3"]), (60, ["DAY0", "DAY3", "DAY60"])])
def test_full_history_tolerance(spark, tolerance, kept):
    raw = prices(spark, {"DAY0": [1.0] * 100, "DAY3": [None] * 3 + [1.0] * 97, "DAY60": [None] * 60 + [1.0] * 40})
    calendar = clean.sessions(raw)
    assert [x.ticker for x in clean.filter_full_history(clean.coverage(raw, calendar), calendar, tolerance).orderBy("ticker").collect()] == kept


def test_coverage_tells_late_from_gappy(spark):
    raw = prices(spark, {"LATE": [None] * 4 + [1.0] * 6, "GAPPY": [1.0, None, None, None, 1.0] + [1.0] * 5, "ALL": [1.0] * 10})
    none = spark.createDataFrame([(DAY, "NEVER", None)], "date date, ticker string, close double")
    got = {x.ticker: x.frac_internal_nan for x in clean.coverage(raw.select("date", "ticker", "close").union(none), clean.sessions(raw)).collect()}
    assert got == {"LATE": 0.0, "GAPPY": pytest.approx(0.3), "NEVER": 1.0, "ALL": 0.0}


def test_download_report_and_differences(spark):
    raw = prices(spark, {"A": [1.0] * 30, "B": [1.0] * 30, "C": [1.0] * 10})
    assert {x.ticker: x.ends_early for x in clean.download_report(raw).collect()} == {"A": False, "B": False, "C": True}
    asked = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    assert {(x.ticker, x.kind) for x in clean.symbol_differences(asked, raw.select("ticker").distinct()).collect()} == {("Z", "absent"), ("B", "unexpected"), ("C", "unexpected")}


# features


def test_known_values(spark):
    n = 300
    data = [(d, i, "A", 100 * math.exp(0.001 * i), 0.001 if i else None, 1e6) for i, d in enumerate(days(n))]
    panel = spark.createDataFrame(data, "date date, pos int, ticker string, close double, log_ret double, dollar_volume double")
    last = features.rolling_features(panel).orderBy(F.desc("pos")).first()
    assert last.mom_252_21 == pytest.approx(0.231) and last.dist_52w_high == 0 and last.vol_21 == pytest.approx(0, abs=1e-9)
    assert last.semivol_63 is None and last.log_adv_63 == pytest.approx(math.log(1e6))
    assert features.rolling_features(panel).filter("pos < 16 and vol_21 is not null").count() == 0


def test_beta_is_recovered(spark):
    panel = returns_panel(spark, 400, list("ABCDEF"), betas=[0.5, 1.0, 1.5, 1.0, 0.7, 1.3])
    got = {x.ticker: x.beta_252 for x in features.rolling_features(panel).filter("pos = 399").collect()}
    assert got["A"] == pytest.approx(0.5, abs=0.15) and got["C"] == pytest.approx(1.5, abs=0.15)
    assert sum(got.values()) / 6 == pytest.approx(1.0, abs=1e-6)


def test_no_lookahead(spark):
    panel = returns_panel(spark, 320, list("ABC"))
    turned = panel.withColumn("log_ret", F.when(F.col("pos") > 300, F.lit(0.5)).otherwise(F.col("log_ret"))).withColumn("close", F.when(F.col("pos") > 300, F.lit(1e4)).otherwise(F.col("close")))
    one, two = features.rolling_features(panel), features.rolling_features(turned)
    assert one.filter("pos <= 300").exceptAll(two.filter("pos <= 300")).count() == 0
    assert one.filter("pos > 300").exceptAll(two.filter("pos > 300")).count() > 0


def standardised(spark, values):
    df = spark.createDataFrame([(DAY, str(i), v) for i, v in enumerate(values)], "date date, ticker string, v double")
    return [x.v for x in features.standardise(df, ["v"]).orderBy(F.col("ticker").cast("int")).collect()]


def test_standardise(spark):
    assert max(standardised(spark, [1.0, 2.0, 3.0, 4.0, 500.0])) == 3.0
    assert standardised(spark, [2.0] * 5) == [0.0] * 5
    assert standardised(spark, [None] * 4) == [None] * 4
    sparse = standardised(spark, [0.0] * 9 + [1.0])
    assert sparse[0] == 0 and 0 < sparse[9] <= 3
    got, x = standardised(spark, [1.0, 2.0, 4.0, None]), [1.0, 2.0, 4.0]
    mad = 1.4826 * np.median(np.abs(np.array(x) - 2))
    assert got[:3] == pytest.approx([(v - 2) / mad for v in x]) and got[3] is None


def test_unknown_exclusion(spark):
    with pytest.raises(ValueError, match="nope"):
        features.feature_names(("nope",))
    assert len(features.feature_names(Features().exclude)) == 13


def test_rebalance_dates_and_windows(spark):
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days(100))], "date date, pos int")
    got = features.rebalance_dates(calendar, 40).collect()
    assert [x.date for x in got] == [dt.date(2020, 2, 29), dt.date(2020, 3, 31), days(100)[-1]]
    returns = calendar.select("date", "pos", F.lit("A").alias("ticker"), F.col("pos").cast("double").alias("r"))
    w = features.trailing_windows(returns, features.rebalance_dates(calendar, 40), 10).filter(F.col("rebal") == dt.date(2020, 2, 29)).orderBy("t").collect()
    assert [x.r for x in w] == list(range(50, 60)) and [x.t for x in w] == list(range(10))
    with pytest.raises(ValueError, match="history"):
        features.check_windows(calendar.filter("pos = 5"), 10)


def test_forward_vol_is_left_open_right_closed(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 1, 30)
    rows = spark.createDataFrame([(d, "A", float(x)) for d, x in zip(days(30), r)], "date date, ticker string, log_ret double")
    dates = spark.createDataFrame([(days(30)[9],), (days(30)[19],)], "date date")
    got = {x.date: x.y for x in features.forward_vol(rows, dates).collect()}
    assert got[days(30)[9]] == pytest.approx(np.std(r[10:20], ddof=1) * 252**0.5) and got[days(30)[19]] is None


# graphs


def pair_frame(spark, matrix):
    n = len(matrix)
    return spark.createDataFrame([(DAY, f"n{i}", f"n{j}", float(matrix[i][j])) for i in range(n) for j in range(i + 1, n)], "date date, a string, b string, s double")


def test_knn_union_and_intersection(spark):
    s = [[0, 0.9, 0.8, 0.1], [0.9, 0, 0.2, 0.3], [0.8, 0.2, 0, 0.05], [0.1, 0.3, 0.05, 0]]
    ranked = graph.ranked_neighbours(pair_frame(spark, s))
    edges = lambda how: {(x.a, x.b, x.weight) for x in graph.knn_edges(ranked, 1, how).collect()}
    assert edges("union") == {("n0", "n1", 0.9), ("n0", "n2", 0.8), ("n1", "n3", 0.3)} and edges("intersection") == {("n0", "n1", 0.9)}
    with pytest.raises(ValueError):
        graph.knn_edges(ranked, 0)
    with pytest.raises(ValueError):
        graph.similarity(pair_frame(spark, s), "odd")


def edge_frame(spark, pairs, date=DAY):
    return spark.createDataFrame([(date, a, b, 1.0) for a, b in pairs], "date date, a string, b string, weight double")


def test_jaccard_and_empty_union(spark):
    dates = spark.createDataFrame([(DAY,), (days(2)[1],)], "date date")
    one, two = edge_frame(spark, [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]), edge_frame(spark, [("a", "b"), ("c", "d"), ("x", "y"), ("z", "w")])
    got = {x.date: x.jaccard for x in graph.jaccard(one, two, dates).collect()}
    assert got == {DAY: pytest.approx(1 / 3), days(2)[1]: 0.0}


def test_diagnostics_count_lonely_nodes_and_skip_zero_weights(spark):
    edges = edge_frame(spark, [("a", "b"), ("b", "c")]).union(edge_frame(spark, [("c", "d")]).withColumn("weight", F.lit(0.0)))
    nodes = spark.createDataFrame([(DAY, x) for x in "abcd"], "date date, node string")
    got = graph.diagnostics(edges, nodes).first()
    assert (got.n_edges, got.min_degree, got.max_degree, got.n_components, got.is_connected) == (2, 0, 2, 2, False)
    assert got.degree_gini == pytest.approx(2 * (0 * 1 + 1 * 2 + 1 * 3 + 2 * 4) / (4 * 4) - 5 / 4)


def test_shrunk_correlation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)) + rng.normal(size=(60, 1))
    corr, intensity = graph.shrunk_correlation(x)
    c = x - x.mean(0)
    s = c.T @ c / 60
    mu = np.trace(s) / 8
    b2 = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in c]) / 60
    assert intensity == pytest.approx(min(b2 / ((s - mu * np.eye(8)) ** 2).sum(), 1))
    assert np.allclose(np.diag(corr), 1) and np.linalg.eigvalsh(corr)[0] > 0 and np.allclose(corr, corr.T)
    assert np.allclose(graph.shrunk_correlation(x, "sample")[0], np.corrcoef(x.T))
    with pytest.raises(ValueError):
        graph.shrunk_correlation(np.c_[x, np.ones(60)], "sample")


def test_residualise_takes_out_the_market():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 1)) @ np.ones((1, 12)) + 0.15 * rng.normal(size=(300, 12))
    assert np.abs(np.corrcoef(graph.residualise(x, 1).T)[np.triu_indices(12, 1)]).mean() < 0.2
    assert (graph.residualise(x, 0) == x).all() and spectral_edge(105, 252) == pytest.approx(2.708, abs=1e-3)


def test_residual_windows_and_moments(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5)) + rng.normal(size=(40, 1))
    rows = spark.createDataFrame([(DAY, i, "edcba"[k], float(x[i, k])) for i in range(40) for k in range(5)], "rebal date, t int, ticker string, r double")
    left = graph.residual_windows(rows, 1).toPandas().pivot(index="t", columns="ticker", values="r")
    want = graph.residualise(x[:, ::-1], 1)
    assert np.allclose(left.to_numpy(), want) and list(left.columns) == list("abcde")
    assert graph.shrinkage_intensity(rows).first().shrinkage == pytest.approx(graph.shrunk_correlation(x)[1])


def test_nearest_dates(spark):
    rng = np.random.default_rng(9)
    left, right = ([DAY + dt.timedelta(int(i)) for i in rng.choice(900, n, replace=False)] for n in (60, 25))
    frame = lambda d: spark.createDataFrame([(x,) for x in d], "date date")
    got = {x.date: x.nearest for x in features.nearest(frame([*left, left[0]]), frame(right)).collect()}
    assert got == {x: min(right, key=lambda y: (abs((y - x).days), y)) for x in left}
    assert [x.nearest for x in features.nearest(frame(left[:1]), frame([])).collect()] == [None]


def test_homophily_of_perfect_and_mixed_graphs(spark):
    labels = spark.createDataFrame([(x, int(x in "cd")) for x in "abcd"], "node string, label int")
    perfect = graph.edge_homophily(edge_frame(spark, [("a", "b"), ("c", "d")]), labels).first()
    assert (perfect.raw, perfect.expected, perfect.adjusted) == (1.0, 0.5, 1.0)
    assert graph.assortativity(edge_frame(spark, [("a", "b"), ("c", "d")]), labels).first().assortativity == 1.0
    assert graph.assortativity(edge_frame(spark, [("a", "c"), ("b", "d")]), labels).first().assortativity == -1.0


def test_smoothness_of_clusters(spark):
    x = spark.createDataFrame([(DAY, t, float(v)) for t, v in zip("abcd", (0, 1, 20, 21))], "date date, ticker string, f double")
    d = graph.pair_distances(x, ["f"])
    assert graph.smoothness(d, edge_frame(spark, [("a", "b"), ("c", "d")]), ["d2"]).first().d2 < 0.01
    assert graph.smoothness(d, edge_frame(spark, [("a", "c")]), ["d2"]).first().d2 > 1
    assert graph.smoothness(d, edge_frame(spark, []), ["d2"]).first().d2 is None


# information


@pytest.mark.parametrize("rho", [0.0, 0.3, 0.6, 0.9])
def test_estimators_recover_the_gaussian_value(rho):
    rng = np.random.default_rng(3)
    x, e = rng.standard_normal((2, 2000))
    y = rho * x + (1 - rho**2) ** 0.5 * e
    true = -0.5 * math.log(1 - rho**2)
    assert information.estimate_ksg(x, y) == pytest.approx(true, abs=0.06)
    assert information.estimate_binned(x, y, 8) == pytest.approx(true, abs=0.2)


def test_estimators_see_what_correlation_misses_and_keep_bounds():
    x = np.random.default_rng(4).standard_normal(1500)
    assert information.estimate_ksg(x, x**2) > 0.8 and abs(np.corrcoef(x, x**2)[0, 1]) < 0.2
    assert information.estimate_binned(x, x, 6) <= math.log(6)
    assert information.estimate_binned(x, np.exp(x)) == pytest.approx(information.estimate_binned(x, x))
    assert information.estimate_binned(x, np.ones(1500)) == pytest.approx(0)
    y = np.random.default_rng(5).standard_normal(1500)
    assert information.estimate_ksg(x, y) == pytest.approx(information.estimate_ksg(y, x), abs=1e-3)
    with pytest.raises(ValueError):
        information.estimator("odd")


def test_binned_relational_equals_numpy(spark):
    rng = np.random.default_rng(6)
    data = np.round(rng.standard_normal((120, 3)), 1)
    rows = spark.createDataFrame([(DAY, i, "abc"[k], float(data[i, k])) for i in range(120) for k in range(3)], "rebal date, t int, ticker string, r double")
    got = {(x.a, x.b): x.mi for x in information.binned(information.joint_counts(information.bins(rows))).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert got["abc"[i], "abc"[j]] == pytest.approx(information.estimate_binned(data[:, i], data[:, j]))
    direct = {(x.a, x.b): x.mi for x in information.all_pairs(rows, Information(estimator="binned")).collect()}
    assert direct == pytest.approx(got)


# embeddings


def small(lam):
    return Config(model=WEEKLY.model, training=Training(vol_lambda=lam, epochs=60, patience=60, window=4))


def made_dates(n=12, dates=6, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(dates):
        label = np.arange(n) % 2
        a = (rng.random((n, n)) < np.where(label[:, None] == label, 0.6, 0.05)).astype(float)
        a = np.triu(a, 1)
        y = rng.standard_normal(n)
        y[0] = np.nan
        out.append((rng.standard_normal((n, 5)) + label[:, None], embedding.normalise(a + a.T), y))
    return out


@pytest.mark.parametrize("lam", [0.0, 0.5])
def test_slopes_equal_finite_differences(lam):
    dates = made_dates()[:2]
    model = embedding.Model(5, small(lam), 1)
    model.encoder.dropout = 0.0
    _, slopes = model.loss(dates, np.random.default_rng(7), True)
    for x, g in zip(model.parameters(), slopes):
        for at in list(np.ndindex(x.shape))[:6]:
            keep, step = x[at], 1e-6
            x[at] = keep + step
            up, _ = model.loss(dates, np.random.default_rng(7), False)
            x[at] = keep - step
            down, _ = model.loss(dates, np.random.default_rng(7), False)
            x[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_training_starts_near_log_two_and_falls():
    model, log = embedding.train(made_dates(), small(0.0), 3)
    assert log["train_first"] == pytest.approx(math.log(2), abs=0.15)
    assert log["val_best"] < log["val_curve"][0] and log["best_epoch"] >= 1
    again, _ = embedding.train(made_dates(), small(0.0), 3)
    assert all((a == b).all() for a, b in zip(model.parameters(), again.parameters()))


def test_head_without_weight_is_left_alone():
    before = embedding.Model(5, small(0.0), 3).head.copy()
    after, _ = embedding.train(made_dates(), small(0.0), 3)
    assert (after.head == before).all()


def test_encoder_follows_a_renaming_of_nodes():
    x, a, _ = made_dates()[0]
    encoder = embedding.Encoder([5, 8, 3], 0.2, np.random.default_rng(0))
    order = np.random.default_rng(1).permutation(len(x))
    assert np.allclose(encoder.forward(x[order], a[np.ix_(order, order)])[0], encoder.forward(x, a)[0][order])


def test_corruption_keeps_rows_and_masked_loss_skips_unknown():
    x = np.arange(20.0).reshape(10, 2)
    assert sorted(map(tuple, embedding.corrupt(x, np.random.default_rng(0)))) == sorted(map(tuple, x))
    assert embedding.masked_mse(np.ones(3), np.array([np.nan, 1.0, 3.0]))[0] == 2.0
    assert embedding.masked_mse(np.ones(3), np.full(3, np.nan))[0] == 0.0
    assert embedding.effective_rank(np.eye(4)) == pytest.approx(4) and embedding.effective_rank(np.ones((5, 3))) == pytest.approx(1)


def test_schedule(spark):
    dates = spark.range(12).select(F.col("id").cast("int").alias("ordinal"))
    got = embedding.schedule(dates, 4, 1, 2).collect()
    embeds = {r: sorted(x.ordinal for x in got if x.refit == r and x.role == "embed") for r in {x.refit for x in got}}
    assert embeds == {0: [5, 6], 1: [7, 8], 2: [9, 10], 3: [11]}
    assert sorted(x.ordinal for x in got if x.refit == 3 and x.role == "train") == [6, 7, 8, 9]
    assert embedding.schedule(dates.filter("ordinal < 5"), 4, 1, 2).count() == 0


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(DAY, 1.0, 2.0), (DAY, 1.0, 1.0), (DAY, 3.0, 5.0), (DAY, None, 9.0), (days(2)[1], 1.0, 1.0)], "date date, x double, y double")
    got = {x.date: x.rho for x in embedding.spearman_by(rows, "x", "y").collect()}
    assert got[DAY] == pytest.approx(embedding.spearman(np.array([1.0, 1, 3]), np.array([2.0, 1, 5]))) and got[days(2)[1]] is None
