"""The base tables in DuckDB's SQL, written apart from the Spark code, as common table expressions."""

from corvane.plans.config import EXCLUDED, FEATURES

NAMES = [x for x in FEATURES if x not in EXCLUDED]
_W = {n: f"OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (21, 63, 252)}
_MIN = {21: 16, 63: 50, 252: 201}


def _g(value: str, counted: str, n: int) -> str:
    return f"CASE WHEN count({counted}) {_W[n]} >= {_MIN[n]} THEN {value} END"


_COVERAGE = """SELECT c.ticker, count(close) AS n_obs, min(date) FILTER (close IS NOT NULL) AS first_date, max(date) FILTER (close IS NOT NULL) AS last_date,
  count(close) / (SELECT count(*) FROM {cal}) AS frac_sessions,
  CASE WHEN count(close) = 0 THEN 1.0 ELSE 1 - count(close) / (max(pos) FILTER (close IS NOT NULL) - min(pos) FILTER (close IS NOT NULL) + 1) END AS frac_internal_nan
  FROM {rows} c JOIN {cal} s USING (date) GROUP BY c.ticker"""
_STD = ", ".join(
    f"CASE WHEN greatest(-3.0, least(3.0, ({c} - m_{c}) / CASE WHEN a_{c} > 0 THEN a_{c} WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END)) IS NULL OR {c} IS NULL OR m_{c} IS NULL THEN 0.0"
    f" ELSE greatest(-3.0, least(3.0, ({c} - m_{c}) / CASE WHEN a_{c} > 0 THEN a_{c} WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END)) END AS {c}"
    for c in NAMES
)

STEPS = 45
#: Read more than once and costly.
KEPT = {"raw", "panel", "win", "wc", "pj", "wr", "rc", "lw", "corr", "bin", "jm", "mi", "x", "feat", "edge"}

CTES = {
    "li": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS ticker, n_regionkey AS label, l_extendedprice AS e, l_quantity AS q, l_shipdate AS sd, l_orderkey AS ok, l_linenumber AS ln FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "raw": "SELECT date, ticker, label, arg_min(e / q, (sd, ok, ln)) AS open, max(e / q) AS high, min(e / q) AS low, CAST(sum(CAST(e AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS close, CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM li GROUP BY date, ticker, label",
    "ses": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM raw)",
    "cov0": _COVERAGE.format(cal="ses", rows="raw"),
    "k1": "SELECT ticker FROM cov0 WHERE n_obs >= 200 AND frac_internal_nan <= 0.25",
    "part": "SELECT date, count(close) / (SELECT count(*) FROM k1) AS share FROM raw WHERE ticker IN (FROM k1) GROUP BY date",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM part WHERE share >= 0.8",
    "raw1": "SELECT * FROM raw WHERE ticker IN (FROM k1)",
    "cov1": _COVERAGE.format(cal="cal", rows="raw1"),
    "k2": "SELECT ticker FROM cov1 WHERE n_obs >= 200 AND frac_internal_nan <= 0.25",
    "k3": "SELECT ticker FROM cov1 WHERE ticker IN (FROM k2) AND first_date <= (SELECT min(date) FROM cal)",
    "grid": "SELECT c.date, c.pos, k.ticker, r.open, r.high, r.low, r.close, r.volume FROM cal c CROSS JOIN k3 k LEFT JOIN raw r ON r.date = c.date AND r.ticker = k.ticker",
    "fl": "SELECT date, pos, ticker, close IS NULL AND last_value(close IGNORE NULLS) OVER w IS NOT NULL AS is_filled, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close, volume AS v0 FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "panel0": "SELECT date, pos, ticker, open, high, low, close, CASE WHEN NOT is_filled AND v0 > 0 THEN v0 END AS volume, is_filled, CASE WHEN NOT is_filled THEN ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY pos) END AS log_ret FROM fl",
    "panel": "SELECT *, close * volume AS dollar_volume FROM panel0 WHERE close IS NOT NULL",
    "mk": "SELECT *, avg(log_ret) OVER (PARTITION BY date) AS market, log_ret AS r, CASE WHEN log_ret <= 0 THEN log_ret END AS dn, abs(log_ret) / dollar_volume AS ratio FROM panel",
    "mk2": "SELECT *, CASE WHEN r IS NOT NULL THEN market END AS m FROM mk",
    "f0": "SELECT date, pos, ticker, "
    + ", ".join(
        f"{v} AS {k}"
        for k, v in {
            "vol_21": _g(f"stddev_samp(r) {_W[21]} * sqrt(252.0)", "r", 21),
            "vol_63": _g(f"stddev_samp(r) {_W[63]} * sqrt(252.0)", "r", 63),
            "semivol_63": f"CASE WHEN count(dn) {_W[63]} >= 20 AND count(r) {_W[63]} >= 50 THEN stddev_samp(dn) {_W[63]} * sqrt(252.0) END",
            "skew_252": _g(f"skewness(r) {_W[252]}", "r", 252),
            "kurt_252": _g(f"kurtosis(r) {_W[252]}", "r", 252),
            "log_adv_63": _g(f"ln(avg(dollar_volume) {_W[63]})", "dollar_volume", 63),
            "amihud_63": _g(f"CASE WHEN avg(ratio) {_W[63]} > 0 THEN ln(avg(ratio) {_W[63]}) END", "ratio", 63),
            "zero_ret_frac_63": _g(f"avg(CASE WHEN r IS NOT NULL THEN CAST(abs(r) < 1e-8 AS INTEGER) END) {_W[63]}", "r", 63),
            "beta_252": _g(f"CASE WHEN var_samp(m) {_W[252]} > 0 THEN covar_samp(r, m) {_W[252]} / var_samp(m) {_W[252]} END", "m", 252),
            "idio_vol_252": _g(f"CASE WHEN var_samp(m) {_W[252]} > 0 THEN sqrt(greatest(var_samp(r) {_W[252]} - pow(covar_samp(r, m) {_W[252]}, 2) / var_samp(m) {_W[252]}, 0.0)) * sqrt(252.0) END", "m", 252),
            "mom_21": _g(f"sum(r) {_W[21]}", "r", 21),
            "mom_63": _g(f"sum(r) {_W[63]}", "r", 63),
            "m252": _g(f"sum(r) {_W[252]}", "r", 252),
            "dist_52w_high": _g(f"ln(close / max(close) {_W[252]})", "close", 252),
        }.items()
    )
    + " FROM mk2",
    "feat": f"SELECT *, {_g(f'stddev_samp(vol_21) {_W[63]}', 'vol_21', 63)} AS volofvol_63, m252 - mom_21 AS mom_252_21 FROM f0",
    "reb": "SELECT date, pos, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT max(date) AS date, max(pos) AS pos FROM cal WHERE pos >= 252 GROUP BY date_trunc('month', date))",
    "fr": "SELECT feat.* FROM feat SEMI JOIN reb USING (date)",
    "med": "SELECT date, " + ", ".join(f"median({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NAMES) + " FROM fr GROUP BY date",
    "mad": "SELECT date, " + ", ".join(f"median(abs({c} - m_{c})) * 1.4826 AS a_{c}" for c in NAMES) + " FROM fr JOIN med USING (date) GROUP BY date",
    "x": f"SELECT date, ticker, {_STD} FROM fr JOIN med USING (date) JOIN mad USING (date)",
    "long": "SELECT date, ticker, feature, value FROM x UNPIVOT (value FOR feature IN (" + ", ".join(NAMES) + "))",
    "ret": "SELECT date, pos - 1 AS pos, ticker, coalesce(log_ret, 0.0) AS r FROM panel WHERE pos > 0",
    "win": "SELECT b.date AS rebal, r.pos - (b.pos - 1 - 251) AS t, r.ticker, r.r FROM reb b JOIN ret r ON r.pos BETWEEN b.pos - 1 - 251 AND b.pos - 1",
    # the projector on a window's first principal component: the covariance squared STEPS times, scaled to trace one
    "wc": "SELECT rebal, t, ticker, r - avg(r) OVER (PARTITION BY rebal, ticker) AS c FROM win",
    "sc": "SELECT x.rebal, x.ticker AS a, y.ticker AS b, sum(x.c * y.c) AS s FROM wc x JOIN wc y ON x.rebal = y.rebal AND x.t = y.t GROUP BY 1, 2, 3",
    "sm": "SELECT rebal, list(a ORDER BY a) AS names, list(row ORDER BY a) AS m FROM (SELECT rebal, a, list(s ORDER BY b) AS row FROM sc GROUP BY 1, 2) GROUP BY rebal",
    "pw": f"SELECT rebal, names, m, 0 AS step FROM sm UNION ALL SELECT rebal, names, list_transform(m, lambda x: list_transform(m, lambda y: list_dot_product(x, y) / total)), step + 1 FROM (SELECT *, list_sum(list_transform(m, lambda z: list_dot_product(z, z))) AS total FROM pw) WHERE step < {STEPS}",
    "pj": f"SELECT rebal, a, unnest(names) AS b, unnest(row) AS p FROM (SELECT rebal, names, unnest(names) AS a, unnest(m) AS row FROM pw WHERE step = {STEPS})",
    "wr": "SELECT x.rebal, x.t, x.ticker, any_value(x.c) - sum(y.c * p.p) AS r FROM wc x JOIN pj p ON p.rebal = x.rebal AND p.a = x.ticker JOIN wc y ON y.rebal = x.rebal AND y.t = x.t AND y.ticker = p.b GROUP BY 1, 2, 3",
    "rc": "SELECT x.rebal, x.ticker AS a, y.ticker AS b, avg(x.r * y.r) AS s FROM wr x JOIN wr y ON x.rebal = y.rebal AND x.t = y.t AND x.ticker <= y.ticker GROUP BY 1, 2, 3",
    "rq": "SELECT rebal, avg(pow(u, 2)) AS q, count(*) AS n FROM (SELECT rebal, t, sum(r * r) AS u FROM wr GROUP BY 1, 2) GROUP BY rebal",
    "lw": "SELECT rebal, tr / p AS mu, CASE WHEN d > 0 THEN least((q - s2) / n, d) / d ELSE 0.0 END AS shrinkage FROM (SELECT *, s2 - tr * tr / p AS d FROM (SELECT rebal, sum(CASE WHEN a = b THEN s * s ELSE 2 * s * s END) AS s2, sum(s) FILTER (a = b) AS tr, count(*) FILTER (a = b) AS p FROM rc GROUP BY rebal) JOIN rq USING (rebal))",
    "corr": "SELECT c.rebal AS date, c.a, c.b, greatest(-1.0, least(1.0, (1 - l.shrinkage) * c.s / sqrt(((1 - l.shrinkage) * x.s + l.shrinkage * mu) * ((1 - l.shrinkage) * y.s + l.shrinkage * mu)))) AS c FROM rc c JOIN lw l USING (rebal) JOIN rc x ON x.rebal = c.rebal AND x.a = c.a AND x.b = c.a JOIN rc y ON y.rebal = c.rebal AND y.a = c.b AND y.b = c.b WHERE c.a < c.b",
    "node": "SELECT DISTINCT date, a AS node FROM corr UNION SELECT date, b FROM corr",
    "dirs": "SELECT date, a AS node, b AS other, c AS s FROM corr UNION ALL SELECT date, b, a, c FROM corr",
    "rk": "SELECT *, row_number() OVER (PARTITION BY date, node ORDER BY s DESC, other) AS rank FROM dirs",
    "edge": "SELECT date, least(node, other) AS a, greatest(node, other) AS b, max(s) AS weight, count(*) AS n FROM rk WHERE rank <= 5 GROUP BY 1, 2, 3",
    "lab": "SELECT n_name AS node, n_regionkey AS label FROM nation WHERE n_name IN (FROM k3)",
    "ends": "SELECT date, a AS node, b AS other, weight FROM edge UNION ALL SELECT date, b, a, weight FROM edge",
    "deg": "SELECT n.date, n.node, count(e.other) AS degree FROM node n LEFT JOIN ends e ON n.date = e.date AND n.node = e.node AND e.weight <> 0 GROUP BY 1, 2",
    "gin": "SELECT date, CASE WHEN sum(degree) > 0 THEN 2.0 * sum(i * degree) / (count(*) * sum(degree)) - (count(*) + 1) / count(*) ELSE 0.0 END AS gini FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY degree, node) AS i FROM deg) GROUP BY date",
    "reach": "SELECT date, node, node AS label FROM node UNION SELECT r.date, e.other, r.label FROM reach r JOIN ends e ON r.date = e.date AND r.node = e.node AND e.weight <> 0",
    "comp": "SELECT date, node, min(label) AS label FROM reach GROUP BY date, node",
    "le": "SELECT e.date, x.label AS la, y.label AS lb FROM edge e JOIN lab x ON x.node = e.a JOIN lab y ON y.node = e.b WHERE e.weight <> 0",
    "mix": "SELECT * FROM le UNION ALL SELECT date, lb, la FROM le",
    "pd": "SELECT p.date, p.ticker AS a, q.ticker AS b, " + ", ".join(f"pow(p.{c} - q.{c}, 2) AS d_{c}" for c in NAMES) + ", " + " + ".join(f"pow(p.{c} - q.{c}, 2)" for c in NAMES) + " AS d2 FROM x p JOIN x q ON p.date = q.date AND p.ticker < q.ticker",
    "pe": "SELECT pd.*, e.a IS NOT NULL AS on_edge FROM pd LEFT JOIN edge e ON pd.date = e.date AND pd.a = e.a AND pd.b = e.b AND e.weight <> 0",
    "bed": "SELECT rebal, ticker, list_distinct(quantile_cont(r, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0])) AS edges FROM wr GROUP BY rebal, ticker",
    "bin": "SELECT w.rebal, w.t, w.ticker, CASE WHEN len(edges) < 2 THEN 0 ELSE greatest(0, least(len(list_filter(edges, lambda e: e < r)) - 1, len(edges) - 2)) END AS bin FROM wr w JOIN bed USING (rebal, ticker)",
    "ent": "SELECT rebal AS date, ticker, -sum(p * ln(p)) AS h FROM (SELECT rebal, ticker, bin, count(*) / sum(count(*)) OVER (PARTITION BY rebal, ticker) AS p FROM bin GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "joint": "SELECT a.rebal, a.ticker AS a, b.ticker AS b, a.bin AS x, b.bin AS y, count(*) AS n FROM bin a JOIN bin b ON a.rebal = b.rebal AND a.t = b.t AND a.ticker < b.ticker GROUP BY ALL",
    "jm": "SELECT *, sum(n) OVER (PARTITION BY rebal, a, b) AS t, sum(n) OVER (PARTITION BY rebal, a, b, x) AS nx, sum(n) OVER (PARTITION BY rebal, a, b, y) AS ny FROM joint",
    "mi": "SELECT rebal AS date, a, b, greatest(sum(n / t * ln(n * t / (nx * ny))) - (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) / (2.0 * max(t)), 0.0) AS mi FROM jm GROUP BY 1, 2, 3",
    "nmi": "SELECT mi.date, a, b, mi, CASE WHEN p.h * q.h > 0 THEN least(greatest(mi / sqrt(p.h * q.h), 0.0), 1.0) ELSE 0.0 END AS nmi FROM mi JOIN ent p ON p.date = mi.date AND p.ticker = a JOIN ent q ON q.date = mi.date AND q.ticker = b",
    "adj0": "SELECT date, node, other, weight AS w FROM ends UNION ALL SELECT date, node, node, 1.0 FROM node",
    "adjd": "SELECT date, node, greatest(sum(w), 1e-12) AS d FROM adj0 GROUP BY 1, 2",
    "adj": "SELECT z.date, z.node, z.other, w / sqrt(p.d * q.d) AS w FROM adj0 z JOIN adjd p ON p.date = z.date AND p.node = z.node JOIN adjd q ON q.date = z.date AND q.node = z.other",
    "fwd": "SELECT b.date, r.ticker, stddev_samp(r.log_ret) * sqrt(252.0) AS y FROM (SELECT date, lead(date) OVER (ORDER BY date) AS stop FROM reb) b JOIN panel r ON r.date > b.date AND r.date <= b.stop GROUP BY 1, 2",
    "fv": "SELECT b.date, k.ticker, f.y FROM reb b CROSS JOIN k3 k LEFT JOIN fwd f ON f.date = b.date AND f.ticker = k.ticker",
}


def oracle(select: str, *floats: str, digits: int = 6) -> str:
    """A query over the tables above, with floating columns rounded."""
    replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in floats)
    used, order = set(), list(CTES)

    def need(text: str) -> None:
        import re

        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in used:
                used.add(word)
                need(CTES[word])

    need(select)
    with_ = ", ".join(f"{k} AS {'MATERIALIZED ' if k in KEPT else ''}({CTES[k]})" for k in order if k in used)
    head = f"WITH RECURSIVE {with_} " if with_ else ""
    return f"{head}SELECT * {f'REPLACE ({replaced})' if floats else ''} FROM ({select})"
