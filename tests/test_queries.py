import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from corvane.plans.base import base
from corvane.plans.queries import ORACLES, QUERIES, _z


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 5)
    return str(x)[:10] if hasattr(x, "isoformat") else x


def rows(table, columns):
    out = [tuple(cell(r[c]) for c in columns) for r in table]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    assert not got or sorted(got[0]) == sorted(columns)
    a, b = rows(got, sorted(columns)), rows(want, sorted(columns))
    assert len(a) == len(b)
    assert all(near(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


# queries without SQL, against computations of another kind


def asked(spark, folder, name):
    assert name in TESTED
    return QUERIES[name](spark, folder).toPandas()


TESTED = {
    "d07_adjacency_spectrum", "d08_initialisations", "d09_components_for_90", "d10_pca_shares", "m04_ksg_mi", "m10_validation", "m11_null_floor",
    "m12_timing", "n06_training_log", "n09_embeddings", "n12_effective_rank", "n15_weight_draws",
}


def matrices(frame, columns):
    return {d: x[columns].to_numpy(float) for d, x in frame.toPandas().groupby("date")}


def test_spectra_by_eigenvalues(spark, sf_dir):
    b = base(spark, sf_dir)
    x, z = matrices(b.x, b.names), matrices(_z(b), [f"z{k}" for k in range(4)])
    got = asked(spark, sf_dir, "n12_effective_rank").set_index("date")
    n90, shares = (asked(spark, sf_dir, k).set_index("date") for k in ("d09_components_for_90", "d10_pca_shares"))
    assert len(got) == len(x) == len(n90) == len(shares)
    for date in x:
        for name, m in (("erank_x", x[date]), ("erank_z", z[date])):
            s = np.sqrt(np.clip(np.linalg.eigvalsh(m.T @ m), 0, None))
            p = s[s > 1e-9] / s.sum()
            assert got[name][date] == pytest.approx(np.prod(p**-p), abs=1e-4)
        values = np.sort(np.linalg.eigvalsh(np.cov(x[date].T)))[::-1]
        part = np.cumsum(values) / values.sum()
        assert n90.n90[date] == 1 + (part < 0.9).sum()
        assert (shares.pca1[date], shares.pca1[date] + shares.pca2[date]) == pytest.approx((part[0], part[1]), abs=1e-5)


def test_adjacency_spectrum_by_dense_matrices(spark, sf_dir):
    b = base(spark, sf_dir)
    edges, nodes = b.edges.toPandas(), b.nodes.toPandas()
    got = asked(spark, sf_dir, "d07_adjacency_spectrum").set_index("date")
    for date, own in nodes.groupby("date"):
        names = sorted(own.node)
        a = np.eye(len(names))
        for e in edges[edges.date == date].itertuples():
            a[names.index(e.a), names.index(e.b)] = a[names.index(e.b), names.index(e.a)] = e.weight
        d = np.maximum(a.sum(1), 1e-12)
        values = np.sort(np.linalg.eigvals(a / np.sqrt(np.outer(d, d))).real)
        assert [got.lambda_max[date], got.lambda_2[date], got.lambda_min[date]] == pytest.approx([values[-1], values[-2], values[0]], abs=1e-5)


def loops_ksg(x, y, k):
    """The estimator by plain loops; series without ties need no noise."""
    n, psi = len(x), lambda m: -0.57721566490153286 + sum(1 / i for i in range(1, m))
    x, y = x / x.std(), y / y.std()
    total = 0.0
    for i in range(n):
        reach = sorted(max(abs(x[i] - x[j]), abs(y[i] - y[j])) for j in range(n) if j != i)[k - 1]
        total += sum(psi(sum(abs(v[i] - v[j]) < reach for j in range(n) if j != i) + 1) for v in (x, y))
    return max(psi(n) + psi(k) - total / n, 0.0)


def test_nearest_neighbour_information_covers_all_dates(spark, sf_dir):
    b = base(spark, sf_dir)
    got = asked(spark, sf_dir, "m04_ksg_mi")
    held = b.residuals.toPandas()
    n = held.groupby("rebal").ticker.nunique()
    assert len(n) > 2 and got.groupby("date").size().to_dict() == {d: k * (k - 1) // 2 for d, k in n.items()}
    for row in got.sample(12, random_state=1).itertuples():
        one, two = (held[(held.rebal == row.date) & (held.ticker == t)].sort_values("t").r.to_numpy() for t in (row.a, row.b))
        assert row.mi == pytest.approx(loops_ksg(one, two, 4), abs=1e-4)


def test_null_floor_and_timing(spark, sf_dir):
    b = base(spark, sf_dir)
    got = asked(spark, sf_dir, "m11_null_floor").iloc[0]
    held = b.residuals.toPandas()
    own = held[held.rebal == got.date].pivot(index="t", columns="ticker", values="r").to_numpy()
    rng = np.random.default_rng(11)
    draws = [loops_ksg(own[:, i % own.shape[1]], rng.permutation(own[:, (i + 1) % own.shape[1]]), 4) for i in range(60)]
    assert got.n_draws == 100 * 200 and got["mean"] == pytest.approx(np.mean(draws), abs=4 * np.std(draws) / 60**0.5)
    assert got["std"] == pytest.approx(np.std(draws), rel=0.5) and got["mean"] < got.p95 < got.p99 < 0.5
    timed = asked(spark, sf_dir, "m12_timing").set_index("estimator")
    assert set(timed.index) == {"ksg", "binned"} and (timed.date == got.date).all()
    assert (timed.pair_s > 0).all() and (timed.total_s > timed.pair_s).all()


def test_validation_is_unbiased_enough(spark, sf_dir):
    got = asked(spark, sf_dir, "m10_validation")
    assert len(got) == 8 and got.mi_true.tolist() == pytest.approx([-0.5 * math.log(1 - r * r) for r in got.rho], abs=1e-6)
    assert (got["mean"] - got.mi_true).tolist() == pytest.approx(got.bias.tolist(), abs=2e-6)
    assert (got[got.estimator == "ksg"].bias.abs() < 0.06).all() and (got["std"] > 0).any()


def test_embeddings_and_their_log(spark):
    folder = "/root/testdata/sf0.01"
    b = base(spark, folder)
    z, log = asked(spark, folder, "n09_embeddings"), asked(spark, folder, "n06_training_log").set_index("refit")
    plan = QUERIES["n10_schedule"](spark, folder).toPandas()
    dates = b.dates.toPandas().set_index("ordinal").date
    want = {(r.refit, dates[r.ordinal]) for r in plan[plan.role == "embed"].itertuples()}
    assert set(zip(z.refit, z.date)) == want and log.n_embed.sum() == len(want)
    assert log.train_first.tolist() == pytest.approx([math.log(2)] * len(log), abs=0.2) and (log.best_epoch <= log.epochs).all()
    for refit, own in z.groupby("refit"):
        ranks, spread = [], []
        for _, part in own.groupby("date"):
            m = part.pivot(index="ticker", columns="dim", values="value").to_numpy(float)
            s = np.sqrt(np.clip(np.linalg.eigvalsh(m.T @ m), 0, None))
            p = s[s > 1e-7] / s.sum()
            ranks.append(np.prod(p**-p))
            spread.append(m.var(0).mean())
        assert (log.erank_mean[refit], log.var_mean[refit]) == pytest.approx((np.mean(ranks), np.mean(spread)), rel=1e-3, abs=1e-4)


def test_weight_draws(spark, sf_dir):
    drawn = asked(spark, sf_dir, "n15_weight_draws")
    sizes = {k: (x.i.max() + 1, x.j.max() + 1) for k, x in drawn.groupby("layer")}
    assert sizes == {0: (13, 16), 1: (16, 4)} and (drawn.w.abs() <= drawn.bound + 1e-6).all()
    for _, x in drawn.groupby("layer"):
        assert x.bound.iloc[0] == pytest.approx((6 / (x.i.max() + 1 + x.j.max() + 1)) ** 0.5, abs=1e-6)
        assert x.w.std() == pytest.approx(x.bound.iloc[0] / 3**0.5, rel=0.3)
    got = asked(spark, sf_dir, "d08_initialisations").pivot(index="date", columns="rule", values="variance")
    assert (got.kaiming / got.glorot).tolist() == pytest.approx([(6 / 13) / (6 / 21)] * len(got), rel=1e-3)


def test_every_query_without_sql_is_tested():
    assert TESTED == set(QUERIES) - set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_part():
    code = "import sys; sys.modules['corvane.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(QUERIES)), str(len(ORACLES)), "False"]
