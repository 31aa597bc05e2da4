"""One query for each operator, with its counterpart for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import clean, embedding, features, graph, information
from corvane.plans.base import Base, base, tidy
from corvane.plans.config import FEATURES, Config, read_settings
from corvane.plans.oracle_base import NAMES, oracle
from corvane.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *floats: str, digits: int = 6):
    """Registers make(base) under a name; its result is rounded, and so is the counterpart's.

    Prices are quotients of cents by whole numbers, which often end in a 5 at the seventh place: they take nine digits.
    """

    def put(make: Callable[[Base], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(make(base(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql, *floats, digits=digits)
        return make

    return put


def _folder(b: Base, label: str) -> str:
    return tables.shared_folder(b.spark, label)


PRICE = ("open", "high", "low", "close", "volume")

# ---- sources and sinks



def _source(b: Base):
    """A source that answers a batch with rows of the price table, and fails on each batch's first call."""
    asked: dict[tuple, int] = {}

    def download(batch: list[str]) -> DataFrame | None:
        asked[tuple(batch)] = asked.get(tuple(batch), 0) + 1
        if asked[tuple(batch)] == 1:
            raise ConnectionError("try again")
        return b.raw.filter(F.col("ticker").isin(batch)).select(*[x.split()[0] for x in tables.PRICES_SCHEMA.split(", ")])

    return download


_DOWNLOADED = "SELECT date, ticker, open, high, low, close, volume FROM raw"


@query("s01_download", _DOWNLOADED, *PRICE, digits=9)
def _(b):
    symbols = [x.n_name for x in b.table("nation").orderBy("n_name").collect()]  # what is asked for is a list by nature
    return tables.download_all(b.spark, _source(b), symbols, _folder(b, "batches"), size=10, sleep=lambda s: None)


@query("s02_retry", "SELECT date, ticker, open, high, low, close, volume FROM raw WHERE ticker IN ('NATION_1', 'NATION_2')", *PRICE, digits=9)
def _(b):
    return tables.fetch(_source(b), ["NATION_1", "NATION_2"], sleep=lambda s: None) or b.raw.limit(0).select(*[x.split()[0] for x in tables.PRICES_SCHEMA.split(", ")])


@query("s03_resume", _DOWNLOADED, *PRICE, digits=9)
def _(b):
    folder, symbols = _folder(b, "batches"), [x.n_name for x in b.table("nation").orderBy("n_name").collect()]
    tables.download_all(b.spark, _source(b), symbols[:10], folder, size=10, sleep=lambda s: None)

    def rest(batch: list[str]) -> DataFrame:
        if batch == symbols[:10]:
            raise AssertionError("a stored batch was asked for again")
        return b.raw.filter(F.col("ticker").isin(batch)).select(*[x.split()[0] for x in tables.PRICES_SCHEMA.split(", ")])

    return tables.download_all(b.spark, rest, symbols, folder, size=10, retries=1)


_PLACE = "CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS i"


@query("s07_npz_scan", f"SELECT 'balance' AS name, {_PLACE}, s_acctbal AS value FROM supplier UNION ALL SELECT 'nation', {_PLACE}, CAST(s_nationkey AS DOUBLE) FROM supplier", "value")
def _(b):
    folder = _folder(b, "arrays")
    tables.write_npz(b.table("supplier").orderBy("s_suppkey").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")), f"{folder}/supplier.npz")
    return tables.read_npz(b.spark, f"{folder}/*.npz").select("name", F.col("place")[0].alias("i"), "value")


@query("s08_settings", "SELECT ticker, label, 5 AS k, 252 AS corr_window FROM raw GROUP BY ticker, label")
def _(b):
    path = _folder(b, "config")
    b.spark.createDataFrame([(b.config.to_json(),)], "value string").coalesce(1).write.text(path)
    read = Config.from_dict(read_settings(b.spark.read.text(path, wholetext=True).filter("value <> ''").first().value)).graph
    return b.raw.select("ticker", "label").distinct().select("ticker", "label", F.lit(read.k).alias("k"), F.lit(read.window).alias("corr_window"))


@query("s04_parquet_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(b):
    return b.table("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("s05_projection", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1", "q")
def _(b):
    return b.table("lineitem").filter("l_shipdate >= timestamp_ntz '1995-01-01'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("s06_csv_scan", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier", "s_acctbal")
def _(b):
    path = _folder(b, "csv")
    tables.write_csv(b.table("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return b.spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_acctbal double")


@query("s09_parquet_sink", "SELECT date, ticker, close, volume FROM raw", "close", "volume", digits=9)
def _(b):
    path = _folder(b, "prices")
    tables.write_parquet(b.raw.select("date", "ticker", "close", "volume"), path, ("ticker",))
    return b.spark.read.parquet(path).select("date", "ticker", "close", "volume")


@query("s10_csv_sink", "SELECT ticker, n_obs, frac_sessions FROM cov0", "frac_sessions")
def _(b):
    path = _folder(b, "coverage")
    tables.write_csv(clean.coverage(b.raw, clean.sessions(b.raw)).select("ticker", "n_obs", "frac_sessions"), path)
    return b.spark.read.csv(path, header=True, schema="ticker string, n_obs long, frac_sessions double")


@query("s11_config_column", "SELECT ticker, label, 5 AS k, 'signed' AS similarity FROM raw GROUP BY ticker, label")
def _(b):
    path = _folder(b, "settings")
    tables.write_with_config(b.raw.select("ticker", "label").distinct(), path, b.config.to_json())
    return b.spark.read.parquet(path).select("ticker", "label", F.get_json_object("config_json", "$.graph.k").cast("int").alias("k"), F.get_json_object("config_json", "$.graph.similarity").alias("similarity"))


@query("s12_matrix_cache", "SELECT date, a, b, c FROM corr", "c")
def _(b):
    folder = _folder(b, "cache")
    tables.cached(b.spark, folder, b.config.digest(), lambda: b.corr)
    return tables.cached(b.spark, folder, b.config.digest(), lambda: 1 / 0).select("date", "a", "b", "c")


@query(
    "s13_universe",
    "SELECT DISTINCT replace(upper(trim(s_name)), '.', '-') AS symbol FROM supplier WHERE lower(CASE WHEN s_acctbal < 0 THEN ' Delisted' WHEN s_nationkey % 3 = 0 THEN 'renamed' ELSE 'active' END) NOT LIKE '%delisted'",
)
def _(b):
    status = F.when(F.col("s_acctbal") < 0, " Delisted").when(F.col("s_nationkey") % 3 == 0, "renamed")
    own = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit(" "), "s_name"))
    return tables.load_universe(b.table("supplier").select(F.col("s_name").alias("ticker"), own.alias("yahoo_ticker"), status.alias("status")))


@query("s14_labels", "SELECT node AS ticker, label FROM lab")
def _(b):
    return b.labels.withColumnRenamed("node", "ticker")


@query("s15_returns", "SELECT date, pos, ticker, r FROM ret", "r")
def _(b):
    return b.returns


# ---- projection, filters, reshaping


@query("p01_wide_to_long", "SELECT date, ticker, close, volume FROM raw", "close", "volume", digits=9)
def _(b):
    wide = b.raw.groupBy("date").pivot("ticker").agg(F.first("close").alias("Close"), F.first("volume").alias("Volume"))
    return tables.to_long(wide, ("close", "volume")).filter("close is not null")


_LABELS = [f"l{k}" for k in range(5)]  # the region dimension has five keys


@query("p02_pivot", f"SELECT date, {', '.join(f'max(close) FILTER (label = {k}) AS l{k}' for k in range(5))} FROM raw GROUP BY date", *_LABELS, digits=9)
def _(b):
    return b.raw.groupBy("date").pivot("label", list(range(5))).agg(F.max("close")).toDF("date", *_LABELS)


@query("p03_stack", "SELECT date, ticker, f, v FROM raw UNPIVOT (v FOR f IN (open, high, low, close, volume))", "v", digits=9)
def _(b):
    return b.raw.unpivot(["date", "ticker"], list(PRICE), "f", "v")


@query("p04_wide", "SELECT date, count(*) AS n, sum(close) AS total FROM raw GROUP BY date", "total", digits=9)
def _(b):
    wide = tables.to_wide(b.raw, "close")
    cells = F.array(*[F.col(f"`{c}`") for c in wide.columns if c != "date"])
    held = F.filter(cells, lambda x: x.isNotNull())
    return wide.select("date", F.size(held).cast("long").alias("n"), F.aggregate(held, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("p05_reindex", "SELECT date, pos, ticker, close FROM grid", "close", digits=9)
def _(b):
    return clean.grid(b.raw, *b.kept).select("date", "pos", "ticker", "close")


@query("p06_subset", "SELECT date, ticker, close FROM raw WHERE ticker IN (FROM k3)", "close", digits=9)
def _(b):
    return b.raw.join(b.kept[1], "ticker", "left_semi").select("date", "ticker", "close")


@query(
    "p07_dedup_last",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "value",
)
def _(b):
    return clean.dedup_last(b.table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("p08_null_filter", "SELECT date, ticker, close FROM grid WHERE close IS NOT NULL", "close", digits=9)
def _(b):
    return clean.grid(b.raw, *b.kept).dropna(subset=["close"]).select("date", "ticker", "close")


@query("p09_null_out", "SELECT date, ticker, volume, log_ret FROM panel", "volume", "log_ret", digits=9)
def _(b):
    return b.panel.select("date", "ticker", "volume", "log_ret")


@query("p10_exclude", f"SELECT date, ticker, {', '.join(NAMES)} FROM fr", *NAMES)
def _(b):
    return b.features.join(b.dates.select("date"), "date", "left_semi").select("date", "ticker", *features.feature_names(b.config.features.exclude))


@query("p11_subsample", "SELECT date, ordinal FROM reb WHERE ordinal IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM reb) - 1) / 6.0, 0) AS BIGINT) FROM range(7) t(i))")
def _(b):
    return features.subsample(b.dates, 7).select("date", "ordinal")


@query("p12_upper_triangle", "SELECT date, count(*) AS pairs FROM corr GROUP BY date")
def _(b):
    return b.corr.filter("a < b").groupBy("date").agg(F.count(F.lit(1)).alias("pairs"))


@query("p13_span", "SELECT r.ticker, count(*) AS sessions FROM cov0 r JOIN ses s ON s.date BETWEEN r.first_date AND r.last_date GROUP BY 1")
def _(b):
    calendar = clean.sessions(b.raw)
    spans = clean.coverage(b.raw, calendar).select("ticker", "first_date", "last_date")
    return calendar.join(spans, F.col("date").between(F.col("first_date"), F.col("last_date"))).groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"))


@query("p14_fill_tensor", "SELECT date, ticker, list_sum(list_value(" + ", ".join(NAMES) + ")) AS total, 13 AS width FROM x", "total")
def _(b):
    row = F.array(*b.names)
    return b.x.select("date", "ticker", F.aggregate(row, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size(row).alias("width"))


@query("p15_flatten", "SELECT date, ticker, feature, value FROM long", "value")
def _(b):
    return features.unpivot(b.x, b.names)


# ---- joins


@query("j01_equi_join", "SELECT date, ticker, log_ret - market AS excess FROM mk", "excess")
def _(b):
    market = b.panel.groupBy("date").agg(F.avg("log_ret").alias("market"))
    return b.panel.join(market, "date").select("date", "ticker", (F.col("log_ret") - F.col("market")).alias("excess"))


@query("j02_scalar_broadcast", "SELECT date, ticker, market FROM mk", "market")
def _(b):
    return features.with_market(b.panel).select("date", "ticker", "market")


@query("j03_left_outer", "SELECT n_name AS ticker, n_obs FROM nation LEFT JOIN cov0 ON ticker = n_name")
def _(b):
    return b.assets.select("ticker").join(clean.coverage(b.raw, clean.sessions(b.raw)).select("ticker", "n_obs"), "ticker", "left")


@query("j04_semi_join", "SELECT date, ticker, close FROM panel WHERE date IN (SELECT date FROM reb)", "close", digits=9)
def _(b):
    return b.panel.join(b.dates, "date", "left_semi").select("date", "ticker", "close")


@query("j05_anti_join", "SELECT n_name AS ticker FROM nation WHERE n_name NOT IN (FROM k3)")
def _(b):
    return b.assets.join(b.kept[1], "ticker", "left_anti").select("ticker")


@query("j06_common_dates", "SELECT DISTINCT date FROM x WHERE date IN (SELECT date FROM corr) AND date IN (SELECT date FROM edge)")
def _(b):
    return b.x.select("date").intersect(b.corr.select("date")).intersect(b.edges.select("date"))


@query("j07_pairs", "SELECT p.date, p.ticker AS a, q.ticker AS b, p.close / q.close AS ratio FROM panel p JOIN panel q ON p.date = q.date AND p.ticker < q.ticker JOIN reb ON reb.date = p.date", "ratio")
def _(b):
    rows = b.panel.join(b.dates.select("date"), "date", "left_semi").select("date", "ticker", "close")
    met = rows.select("date", F.col("ticker").alias("a"), F.col("close").alias("x")).join(rows.select("date", F.col("ticker").alias("b"), F.col("close").alias("y")), "date").filter("a < b")
    return met.select("date", "a", "b", (F.col("x") / F.col("y")).alias("ratio"))


@query("j08_trailing_window", "SELECT rebal, ticker, count(*) AS n, min(t) AS first, max(t) AS last, sum(r) AS total FROM win GROUP BY 1, 2", "total")
def _(b):
    return b.windows.groupBy("rebal", "ticker").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("r").alias("total"))


@query("j09_forward_vol", "SELECT date, ticker, y FROM fv", "y")
def _(b):
    return features.forward_vol(b.panel.select("date", "ticker", "log_ret"), b.dates)


@query(
    "j10_nearest_date",
    "SELECT o.date, (SELECT min(c.date) FROM cal c WHERE abs(date_diff('day', c.date, o.date)) = (SELECT min(abs(date_diff('day', d.date, o.date))) FROM cal d)) AS nearest FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders) o",
)
def _(b):
    months = b.table("orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).distinct()
    return features.nearest(months, b.calendar)


@query("j11_cross_join", "SELECT date, ticker FROM cal, k3")
def _(b):
    return b.calendar.select("date").crossJoin(b.kept[1])


@query("j12_edge_labels", "SELECT date, la, lb, count(*) AS n FROM le GROUP BY ALL")
def _(b):
    ends = b.labels
    return b.edges.filter("weight <> 0").join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").groupBy("date", "la", "lb").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates


@query(
    "a01_download_report",
    "SELECT ticker, n_rows, first_date, last_date, n_zero_volume, last_date < (SELECT last_date FROM (SELECT last_date, count(*) c FROM (SELECT ticker, max(date) AS last_date FROM raw GROUP BY 1) GROUP BY 1 ORDER BY c DESC, last_date LIMIT 1)) - 7 AS ends_early FROM (SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (coalesce(volume, 0) <= 0) AS n_zero_volume FROM raw GROUP BY 1)",
)
def _(b):
    return clean.download_report(b.raw)


@query("a02_mode", "SELECT event_type, min(user_id) AS most FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY event_type ORDER BY count(*) DESC) = 1) GROUP BY 1")
def _(b):
    return b.table("events").groupBy("event_type").agg(F.mode("user_id", deterministic=True).alias("most"))


@query("a03_ends_early", "SELECT ticker, last < (SELECT last FROM (SELECT last, count(*) AS c FROM (SELECT max(date) AS last FROM raw GROUP BY ticker) GROUP BY 1 ORDER BY c DESC, last LIMIT 1)) - 7 AS early FROM (SELECT ticker, max(date) AS last FROM raw GROUP BY 1)")
def _(b):
    return clean.download_report(b.raw).select("ticker", F.col("ends_early").alias("early"))


@query("a04_distinct", "SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS sessions FROM raw")
def _(b):
    return b.raw.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("sessions"))


@query("a05_coverage", "SELECT ticker, n_obs, first_date, last_date, frac_sessions FROM cov0", "frac_sessions")
def _(b):
    return clean.coverage(b.raw, clean.sessions(b.raw)).drop("frac_internal_nan")


@query("a06_internal_holes", "SELECT ticker, frac_internal_nan FROM cov1", "frac_internal_nan")
def _(b):
    first = clean.filter_universe(clean.coverage(b.raw, clean.sessions(b.raw)), b.config.universe.min_history, b.config.universe.max_missing)
    return clean.coverage(b.raw.join(first, "ticker", "left_semi"), b.calendar).select("ticker", "frac_internal_nan")


@query("a07_calendar", "SELECT date, pos FROM cal")
def _(b):
    return b.calendar


@query("a08_universe_filter", "SELECT ticker FROM k1")
def _(b):
    return clean.filter_universe(clean.coverage(b.raw, clean.sessions(b.raw)), b.config.universe.min_history, b.config.universe.max_missing)


@query("a09_full_history", "SELECT ticker FROM k3")
def _(b):
    return b.kept[1]


@query("a10_panel_report", "SELECT ticker, count(*) AS n_obs, max(abs(log_ret)) AS max_abs_ret, count(*) FILTER (is_filled) AS n_filled FROM panel GROUP BY 1", "max_abs_ret")
def _(b):
    return clean.panel_report(b.panel, b.calendar).select("ticker", "n_obs", "max_abs_ret", "n_filled")


@query("a11_market", "SELECT date, avg(log_ret) AS market FROM panel GROUP BY 1", "market")
def _(b):
    return b.panel.groupBy("date").agg(F.avg("log_ret").alias("market"))


@query("a12_cross_section", "SELECT date, any_value(m) AS med, median(abs(vol_63 - m)) AS mad, stddev_samp(vol_63) AS sd FROM (SELECT date, vol_63, median(vol_63) OVER (PARTITION BY date) AS m FROM feat) GROUP BY date", "med", "mad", "sd")
def _(b):
    centred = b.features.select("date", "vol_63", F.median("vol_63").over(Window.partitionBy("date")).alias("m"))
    return centred.groupBy("date").agg(F.any_value("m").alias("med"), F.median(F.abs(F.col("vol_63") - F.col("m"))).alias("mad"), F.stddev_samp("vol_63").alias("sd"))


_PAIRS = [(a, c) for i, a in enumerate(NAMES) for c in NAMES[i + 1 :]]
_CORR = "SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{c}', 'corr': corr({a}, {c})}}" for a, c in _PAIRS) + "], recursive := true) FROM x"


@query("a13_feature_correlation", f"SELECT a, b, corr FROM ({_CORR})", "corr")
def _(b):
    return features.feature_correlation(b.x, b.names)


@query("a14_diagnostic_summary", "SELECT avg(g) AS mean, min(g) AS low, max(g) AS high, stddev_pop(g) AS sd FROM (SELECT gini AS g FROM gin)", "mean", "low", "high", "sd")
def _(b):
    return graph.gini(graph.degrees(b.edges, b.nodes)).agg(F.avg("gini").alias("mean"), F.min("gini").alias("low"), F.max("gini").alias("high"), F.stddev_pop("gini").alias("sd"))


@query("a15_class_shares", "SELECT sum(pow(c / t, 2)) AS expected FROM (SELECT count(*) AS c, (SELECT count(*) FROM lab) AS t FROM lab GROUP BY label)", "expected")
def _(b):
    counts = b.labels.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg((F.sum(F.col("c") ** 2) / F.sum("c") ** 2).alias("expected"))


@query("a16_quantiles", "SELECT ticker, quantile_cont(r, 0.01) AS p01, quantile_cont(r, 0.95) AS p95, quantile_cont(r, 0.99) AS p99 FROM ret GROUP BY 1", "p01", "p95", "p99")
def _(b):
    q = lambda p: F.percentile("r", F.lit(p))
    return b.returns.groupBy("ticker").agg(q(0.01).alias("p01"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query("a17_joint_histogram", "SELECT rebal, a, b, x, y, n FROM joint")
def _(b):
    return b.joint


@query("a18_feature_counts", "SELECT feature, count(*) FILTER (abs(abs(value) - 3.0) < 1e-9) / count(*) AS clip_rate, count(DISTINCT round(value, 6)) AS distinct_values, count(*) FILTER (value = 0) AS zeros FROM long GROUP BY 1", "clip_rate")
def _(b):
    clip = F.avg((F.abs(F.abs("value") - b.config.features.winsor) < 1e-9).cast("double"))
    return features.unpivot(b.x, b.names).groupBy("feature").agg(clip.alias("clip_rate"), F.countDistinct(F.round("value", 6)).alias("distinct_values"), F.count_if(F.col("value") == 0).alias("zeros"))


@query("a19_pooled_skew", "SELECT feature, skewness(value) AS skew FROM long GROUP BY 1", "skew")
def _(b):
    from corvane.functions.stats import adjusted_skew

    return features.unpivot(b.x, b.names).groupBy("feature").agg(adjusted_skew(F.col("value")).alias("skew"))


_RANKED = "SELECT date, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM (SELECT x.date, x.vol_63 AS v, fv.y FROM x JOIN fv USING (date, ticker) WHERE fv.y IS NOT NULL)"


@query("a20_spearman", f"SELECT date, CASE WHEN count(*) >= 3 THEN corr(rv, ry) END AS rho FROM ({_RANKED}) GROUP BY 1", "rho")
def _(b):
    target = features.forward_vol(b.panel.select("date", "ticker", "log_ret"), b.dates)
    return embedding.spearman_by(b.x.select("date", "ticker", "vol_63").join(target, ["date", "ticker"]), "vol_63", "y")


# ---- windows


def _feature(name: str, *columns: str) -> None:
    @query(name, f"SELECT date, ticker, {', '.join(columns)} FROM feat", *columns)
    def _(b):
        return b.features.select("date", "ticker", *columns)


_feature("w01_vol", "vol_21", "vol_63")
_feature("w02_semivol", "semivol_63")
_feature("w03_volofvol", "volofvol_63")
_feature("w04_skew_kurt", "skew_252", "kurt_252")
_feature("w05_log_adv", "log_adv_63")
_feature("w06_amihud", "amihud_63")
_feature("w07_zero_returns", "zero_ret_frac_63")
_feature("w08_beta", "beta_252")
_feature("w09_idio_vol", "idio_vol_252")
_feature("w10_momentum", "mom_21", "mom_63", "mom_252_21")
_feature("w11_distance_from_high", "dist_52w_high")


@query("w12_log_return", "SELECT date, ticker, log_ret, dollar_volume FROM panel", "log_ret", "dollar_volume")
def _(b):
    return b.panel.select("date", "ticker", "log_ret", "dollar_volume")


@query("w13_bounded_fill", "SELECT date, ticker, open, high, low, close, is_filled FROM fl", "open", "high", "low", "close", digits=9)
def _(b):
    return clean.fill(clean.grid(b.raw, *b.kept), b.config.universe.max_fill).select("date", "ticker", "open", "high", "low", "close", "is_filled")


@query("w14_rebalance_dates", "SELECT date, pos, ordinal FROM reb")
def _(b):
    return b.dates


@query("w15_session_ordinal", "SELECT date, pos FROM ses")
def _(b):
    return clean.sessions(b.raw)


@query("w16_consecutive_dates", "SELECT date, lag(date) OVER (ORDER BY date) AS before FROM reb")
def _(b):
    return embedding.consecutive(b.dates)


@query("w17_next_date", "SELECT date, lead(date) OVER (ORDER BY date) AS next FROM reb")
def _(b):
    return b.dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))


@query("w18_top_k", "SELECT date, node, other, s, rank FROM rk WHERE rank <= 5", "s")
def _(b):
    return graph.ranked_neighbours(graph.similarity(b.corr), b.config.graph.k)


@query("w19_first_last_valid", "SELECT ticker, min(date) FILTER (close IS NOT NULL) AS first, max(date) FILTER (close IS NOT NULL) AS last FROM grid GROUP BY 1")
def _(b):
    at = F.when(F.col("close").isNotNull(), F.col("date"))
    return clean.grid(b.raw, *b.kept).groupBy("ticker").agg(F.min(at).alias("first"), F.max(at).alias("last"))


# ---- order, sets


@query("t01_sorted", "SELECT date, ticker, close FROM panel ORDER BY date, ticker", "close", digits=9)
def _(b):
    return b.panel.select("date", "ticker", "close").orderBy("date", "ticker")


@query("t02_shortest", "SELECT ticker, n_obs FROM cov0 ORDER BY n_obs, ticker LIMIT 8")
def _(b):
    return clean.coverage(b.raw, clean.sessions(b.raw)).select("ticker", "n_obs").orderBy("n_obs", "ticker").limit(8)


@query("t03_largest_moves", "SELECT ticker, max(abs(log_ret)) AS m FROM panel GROUP BY 1 ORDER BY m DESC, ticker LIMIT 8", "m")
def _(b):
    return b.panel.groupBy("ticker").agg(F.max(F.abs("log_ret")).alias("m")).orderBy(F.desc("m"), "ticker").limit(8)


@query("t04_top_pairs", f"SELECT a, b, corr FROM ({_CORR}) ORDER BY abs(corr) DESC, a, b LIMIT 10", "corr")
def _(b):
    return features.feature_correlation(b.x, b.names).orderBy(F.desc(F.abs("corr")), "a", "b").limit(10)


@query("t05_neighbour_sets", "SELECT date, node, string_agg(other, ',' ORDER BY rank) AS others FROM rk WHERE rank <= 5 GROUP BY 1, 2")
def _(b):
    near = b.ranked.filter(F.col("rank") <= b.config.graph.k)
    return near.groupBy("date", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x.other), ",").alias("others"))


_SMOOTH = "SELECT date, " + ", ".join(f"CASE WHEN avg(d_{c}) > 0 THEN avg(d_{c}) FILTER (on_edge) / avg(d_{c}) END AS {c}" for c in NAMES) + " FROM pe GROUP BY date"


@query("t06_ranked_smoothness", f"SELECT feature, avg(v) AS mean, row_number() OVER (ORDER BY round(avg(v), 9), feature) AS place FROM (FROM ({_SMOOTH}) UNPIVOT (v FOR feature IN ({', '.join(NAMES)}))) GROUP BY 1", "mean")
def _(b):
    each = graph.smoothness(b.distances, b.edges, [f"d_{n}" for n in b.names]).toDF("date", *b.names)
    mean = each.unpivot(["date"], b.names, "feature", "v").groupBy("feature").agg(F.avg("v").alias("mean"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.round("mean", 9), "feature")))


@query("t07_label_boundaries", "SELECT count(*) FILTER (label <> before) AS boundaries FROM (SELECT label, lag(label) OVER (ORDER BY label, node) AS before FROM lab)")
def _(b):
    before = F.lag("label").over(Window.orderBy("label", "node"))
    return b.labels.withColumn("before", before).agg(F.count_if(F.col("label") != F.col("before")).alias("boundaries"))


@query("o01_union", "SELECT date, ticker, 'kept' AS part FROM raw WHERE ticker IN (FROM k3) UNION ALL SELECT date, ticker, 'left out' FROM raw WHERE ticker NOT IN (FROM k3)")
def _(b):
    rows, kept = b.raw.select("date", "ticker"), b.kept[1]
    return rows.join(kept, "ticker", "left_semi").withColumn("part", F.lit("kept")).unionByName(rows.join(kept, "ticker", "left_anti").withColumn("part", F.lit("left out")))


@query("o02_intersect", "SELECT date FROM cal INTERSECT SELECT date FROM reb")
def _(b):
    return b.calendar.select("date").intersect(b.dates.select("date"))


@query("o03_except", "SELECT ticker FROM cov0 EXCEPT SELECT ticker FROM k3")
def _(b):
    return b.raw.select("ticker").distinct().subtract(b.kept[1])


_PERSIST = "SELECT n.date, coalesce(j, 0.0) AS jaccard FROM (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM reb) n LEFT JOIN (SELECT date, count(*) FILTER (x AND y) / count(*) AS j FROM (SELECT date, a, b, bool_or(k = 0) AS x, bool_or(k = 1) AS y FROM (SELECT date, a, b, 0 AS k FROM edge WHERE weight <> 0 UNION ALL SELECT r.date, e.a, e.b, 1 FROM edge e JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM reb) r ON r.p = e.date WHERE weight <> 0) GROUP BY 1, 2, 3) GROUP BY 1) USING (date) WHERE p IS NOT NULL"


@query("o04_jaccard", _PERSIST, "jaccard")
def _(b):
    return graph.persistence(b.edges, b.dates)


# ---- composites


@query("f01_standardise", f"SELECT date, ticker, {', '.join(NAMES)} FROM x", *NAMES)
def _(b):
    return features.assemble(b.features, b.dates, b.config.features)


@query("f02_features", f"SELECT date, ticker, {', '.join(FEATURES)} FROM feat", *FEATURES)
def _(b):
    return b.features.drop("pos")


@query("f03_assemble", "SELECT date, ticker, feature, value FROM long", "value")
def _(b):
    return features.unpivot(features.assemble(b.features, b.dates, b.config.features), b.names)


_Y = "SELECT date, ticker, y, median(y) OVER (PARTITION BY date) AS m, stddev_samp(y) OVER (PARTITION BY date) AS s FROM fv"


@query("f04_vol_target", f"SELECT date, ticker, CASE WHEN y IS NOT NULL THEN greatest(-3.0, least(3.0, (y - m) / CASE WHEN a > 0 THEN a WHEN s > 0 THEN s ELSE 1.0 END)) END AS y FROM (SELECT *, median(abs(y - m)) OVER (PARTITION BY date) * 1.4826 AS a FROM ({_Y}))", "y")
def _(b):
    return features.vol_target(b.panel.select("date", "ticker", "log_ret"), b.dates, b.config.features.winsor)


# ---- graphs


@query("g01_residualised_corr", "SELECT date, a, b, c FROM corr", "c")
def _(b):
    return graph.correlations(b.windows, b.config.graph)


@query("g01_residuals", "SELECT rebal, t, ticker, r FROM wr", "r")
def _(b):
    return b.residuals


_LW = "SELECT rebal AS date, CASE WHEN d > 0 THEN least((q - s2) / n, d) / d ELSE 0.0 END AS shrinkage FROM (SELECT *, s2 - 2 * tr / p * tr + p * pow(tr / p, 2) AS d FROM (SELECT rebal, sum(s * s) AS s2, sum(q) AS q, sum(s) FILTER (a = b) AS tr, count(*) FILTER (a = b) AS p, max(n) AS n FROM (SELECT x.rebal, x.ticker AS a, y.ticker AS b, avg(x.c * y.c) AS s, avg(pow(x.c * y.c, 2)) AS q, count(*) AS n FROM (SELECT *, r - avg(r) OVER (PARTITION BY rebal, ticker) AS c FROM win) x JOIN (SELECT *, r - avg(r) OVER (PARTITION BY rebal, ticker) AS c FROM win) y ON x.rebal = y.rebal AND x.t = y.t GROUP BY 1, 2, 3) GROUP BY 1))"


@query("g02_ledoit_wolf", _LW, "shrinkage")
def _(b):
    from dataclasses import replace

    return graph.spectra(b.windows, replace(b.config.graph, n_factors=0)).select("date", "shrinkage")


@query("g02_shrinkage_by_moments", _LW, "shrinkage")
def _(b):
    return graph.shrinkage_intensity(b.windows)


@query("g03_spectral_edge", "SELECT date, pow(1 + sqrt(count(*) / 252), 2) AS edge FROM node GROUP BY 1", "edge")
def _(b):
    return b.nodes.groupBy("date").agg(((F.lit(1) + F.sqrt(F.count(F.lit(1)) / b.config.graph.window)) ** 2).alias("edge"))


# Eigenvalues above the edge are the positive pivots of the correlations less the edge on the diagonal; the largest is read off the squared matrix.
_SPECTRA = """WITH RECURSIVE full0 AS (SELECT date, a, b, c FROM corr UNION ALL SELECT date, b, a, c FROM corr UNION ALL SELECT date, node, node, 1.0 FROM node),
fm AS (SELECT date, list(row ORDER BY a) AS m FROM (SELECT date, a, list(c ORDER BY b) AS row FROM full0 GROUP BY 1, 2) GROUP BY date),
fe AS (SELECT date, len(m) AS n, pow(1 + sqrt(len(m) / 252), 2) AS edge FROM fm),
pw2 AS (SELECT date, m, 0 AS step FROM fm UNION ALL SELECT date, list_transform(m, lambda x: list_transform(m, lambda y: list_dot_product(x, y) / total)), step + 1
  FROM (SELECT *, list_sum(list_transform(m, lambda z: list_dot_product(z, z))) AS total FROM pw2) WHERE step < 45),
top AS (SELECT p.date, list_sum(list_transform(range(1, len(p.m) + 1), lambda i: list_dot_product(p.m[i], f.m[i]))) AS first FROM pw2 p JOIN fm f USING (date) WHERE step = 45),
pv AS (SELECT fm.date, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN v - edge ELSE v END)) AS m, CAST(0 AS BIGINT) AS above FROM fm JOIN fe USING (date)
  UNION ALL SELECT date, list_transform(m[2:], lambda r: list_transform(r[2:], lambda v, j: v - r[1] * m[1][j + 1] / m[1][1])), above + CASE WHEN m[1][1] > 0 THEN 1 ELSE 0 END FROM pv WHERE len(m) > 0)
SELECT fe.date, lw.shrinkage, mean_corr, first / n AS top_eigval_frac, above AS n_eigs_above_mp FROM fe JOIN lw ON lw.rebal = fe.date JOIN (SELECT date, avg(c) AS mean_corr FROM corr GROUP BY 1) USING (date)
JOIN top USING (date) JOIN (SELECT date, above FROM pv WHERE len(m) = 0) USING (date)"""


@query("g04_spectra", _SPECTRA, "shrinkage", "mean_corr", "top_eigval_frac")
def _(b):
    return graph.spectra(b.windows, b.config.graph)


@query("g05_knn_union", "SELECT date, a, b, weight FROM edge", "weight")
def _(b):
    return graph.knn_edges(b.ranked, b.config.graph.k, "union")


@query("g05_knn_intersection", "SELECT date, a, b, weight FROM edge WHERE n = 2", "weight")
def _(b):
    return graph.knn_edges(b.ranked, b.config.graph.k, "intersection")


@query("g06_absolute_similarity", "SELECT date, a, b, abs(c) AS s FROM corr", "s")
def _(b):
    return graph.similarity(b.corr, "absolute")


@query("g07_graph_sequence", "SELECT date, a, b, weight FROM edge", "weight")
def _(b):
    pairs = graph.correlations(b.windows, b.config.graph)
    return graph.knn_edges(graph.ranked_neighbours(graph.similarity(pairs, b.config.graph.similarity), b.config.graph.k), b.config.graph.k, b.config.graph.symmetrise, b.config.graph.weighted)


@query("g08_persistence", _PERSIST, "jaccard")
def _(b):
    return graph.persistence(b.edges, b.dates)


_DIAG = "SELECT date, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, sum(degree) / (count(*) * (count(*) - 1)) AS density, avg(degree) AS mean_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM deg GROUP BY date"


@query("g09_degrees", _DIAG, "density", "mean_degree")
def _(b):
    return graph.diagnostics(b.edges, b.nodes).select("date", "n_edges", "density", "mean_degree", "min_degree", "max_degree")


@query("g10_degree_gini", "SELECT date, gini FROM gin", "gini")
def _(b):
    return graph.gini(graph.degrees(b.edges, b.nodes))


@query("g11_components", "SELECT date, node, label FROM comp")
def _(b):
    return graph.component_labels(b.edges, b.nodes)


_SWEEP = """WITH RECURSIVE ks AS (SELECT unnest([3, 5, 7]) AS k),
se AS (SELECT k, date, least(node, other) AS a, greatest(node, other) AS b, max(s) AS weight FROM rk JOIN ks ON rank <= k GROUP BY ALL HAVING max(s) <> 0),
sd AS (SELECT k, date, a AS node, b AS other FROM se UNION ALL SELECT k, date, b, a FROM se),
counted AS (SELECT ks.k, n.date, n.node, count(sd.other) AS degree FROM ks CROSS JOIN node n LEFT JOIN sd ON sd.k = ks.k AND sd.date = n.date AND sd.node = n.node GROUP BY ALL),
per AS (SELECT k, date, avg(degree) AS mean_degree, sum(degree) / (count(*) * (count(*) - 1)) AS density FROM counted GROUP BY ALL),
rs AS (SELECT ks.k, date, node, node AS label FROM node CROSS JOIN ks UNION SELECT r.k, r.date, sd.other, r.label FROM rs r JOIN sd ON r.k = sd.k AND r.date = sd.date AND r.node = sd.node),
whole AS (SELECT k, date, count(DISTINCT label) = 1 AS one FROM (SELECT k, date, node, min(label) AS label FROM rs GROUP BY ALL) GROUP BY ALL),
nx AS (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM reb),
both0 AS (SELECT k, date, a, b, 0 AS w FROM se UNION ALL SELECT k, nx.date, a, b, 1 FROM se JOIN nx ON nx.p = se.date),
jac AS (SELECT k, date, count(*) FILTER (c = 2) / count(*) AS j FROM (SELECT k, date, a, b, count(*) AS c FROM both0 GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT k, avg(coalesce(j, 0.0)) AS mean_persistence, stddev_pop(coalesce(j, 0.0)) AS std_persistence FROM ks CROSS JOIN nx LEFT JOIN jac USING (k, date) WHERE p IS NOT NULL GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, avg(mean_degree) AS mean_degree, avg(density) AS density, avg(CAST(one AS INTEGER)) AS frac_dates_connected, any_value(mean_persistence) AS mean_persistence, any_value(std_persistence) AS std_persistence
FROM per JOIN whole USING (k, date) JOIN kept USING (k) GROUP BY k"""


@query("g12_sweep_k", _SWEEP, "mean_degree", "density", "frac_dates_connected", "mean_persistence", "std_persistence")
def _(b):
    return graph.sweep(b.ranked, b.nodes, b.dates, b.config.graph)


_HOM = "SELECT h.date, raw, e AS expected, CASE WHEN e < 1 THEN (raw - e) / (1 - e) END AS adjusted FROM (SELECT date, avg(CAST(la = lb AS INTEGER)) AS raw FROM le GROUP BY 1) h, (SELECT sum(pow(c / t, 2)) AS e FROM (SELECT count(*) AS c, (SELECT count(*) FROM lab) AS t FROM lab GROUP BY label))"
_ASS = "SELECT date, CASE WHEN q < 1 THEN (tr - q) / (1 - q) END AS assortativity FROM (SELECT m.date, avg(CAST(la = lb AS INTEGER)) AS tr, (SELECT sum(pow(c, 2)) FROM (SELECT count(*) AS c FROM mix z WHERE z.date = m.date GROUP BY la)) / pow(count(*), 2) AS q FROM mix m GROUP BY m.date)"
_SMO = "SELECT date, CASE WHEN avg(d2) > 0 THEN avg(d2) FILTER (on_edge) / avg(d2) END AS smoothness FROM pe GROUP BY 1"


@query("g13_homophily", _HOM, "raw", "expected", "adjusted")
def _(b):
    return graph.edge_homophily(b.edges, b.labels)


@query("g14_assortativity", _ASS, "assortativity")
def _(b):
    return graph.assortativity(b.edges, b.labels)


@query("g15_pair_distances", "SELECT date, a, b, d2 FROM pd", "d2")
def _(b):
    return b.distances.select("date", "a", "b", "d2")


@query("g16_smoothness", _SMO, "smoothness")
def _(b):
    return graph.smoothness(b.distances, b.edges, ["d2"]).withColumnRenamed("d2", "smoothness")


@query("g17_feature_smoothness", f"SELECT feature, avg(v) AS mean FROM (FROM ({_SMOOTH}) UNPIVOT (v FOR feature IN ({', '.join(NAMES)}))) GROUP BY 1", "mean")
def _(b):
    each = graph.smoothness(b.distances, b.edges, [f"d_{n}" for n in b.names]).toDF("date", *b.names)
    return each.unpivot(["date"], b.names, "feature", "v").groupBy("feature").agg(F.avg("v").alias("mean"))


@query("g18_analysis", f"SELECT 'correlation' AS graph, date, raw, expected, adjusted, assortativity, smoothness FROM ({_HOM}) JOIN ({_ASS}) USING (date) JOIN ({_SMO}) USING (date)", "raw", "expected", "adjusted", "assortativity", "smoothness")
def _(b):
    return graph.analyse(b.edges, b.labels, b.distances, "correlation")


# ---- information


@query("m01_gaussian_mi", "SELECT date, a, b, -0.5 * ln(1 - c * c) AS mi FROM corr", "mi")
def _(b):
    return b.corr.select("date", "a", "b", information.gaussian(F.col("c")).alias("mi"))


@query("m02_bins", "SELECT rebal, t, ticker, bin FROM bin")
def _(b):
    return b.binned


_UNIFORM = "SELECT rebal, t, ticker, CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(len(list_filter(edges, lambda e: e < r)) - 1, 5)) END AS bin FROM (SELECT *, list_transform(range(7), lambda i: lo + (hi - lo) * (i / 6)) AS edges FROM (SELECT *, min(r) OVER (PARTITION BY rebal, ticker) AS lo, max(r) OVER (PARTITION BY rebal, ticker) AS hi FROM win))"


@query("m02_uniform_bins", _UNIFORM)
def _(b):
    return information.bins(b.windows, b.config.information.bins, "uniform")


@query("m03_binned_mi", "SELECT date, a, b, mi FROM mi", "mi")
def _(b):
    return information.binned(b.joint)


def _middle(b: Base) -> DataFrame:
    """The residuals of the middle rebalance date, on which the method measures its null and its time."""
    middle = b.dates.agg(F.expr("cast(count(*) div 2 as int)").alias("m"))
    date = b.dates.join(middle, F.col("ordinal") == F.col("m")).select(F.col("date").alias("rebal"))
    return b.residuals.join(date, "rebal", "left_semi")


@query("m04_ksg_mi")
def _(b):
    return information.all_pairs(b.residuals, b.config.information)


@query("m05_all_pairs", "SELECT date, a, b, mi FROM mi", "mi")
def _(b):
    from dataclasses import replace

    return information.all_pairs(b.residuals, replace(b.config.information, estimator="binned"))


@query("m06_entropies", "SELECT date, ticker, h FROM ent", "h")
def _(b):
    return information.entropies(b.binned)


@query("m07_nmi", "SELECT date, a, b, mi, nmi FROM nmi", "mi", "nmi")
def _(b):
    return b.nmi


@query("m08_signed_similarity", "SELECT date, a, b, CASE WHEN c > 0 THEN nmi ELSE 0.0 END AS s FROM nmi JOIN corr USING (date, a, b)", "s")
def _(b):
    return information.similarity(b.nmi, b.corr).select("date", "a", "b", "s")


@query("m09_nonlinear_excess", "SELECT date, a, b, mi + 0.5 * ln(1 - c * c) AS delta FROM nmi JOIN corr USING (date, a, b)", "delta")
def _(b):
    return information.similarity(b.nmi, b.corr).select("date", "a", "b", "delta")


@query("m10_validation")
def _(b):
    return information.validate(b.spark, [0.0, 0.3, 0.6, 0.9], b.config.information, trials=8)


@query("m11_null_floor")
def _(b):
    return information.null_floor(information.null_draws(_middle(b), b.config.information))


_MK = "SELECT date, least(node, other) AS a, greatest(node, other) AS b, max(s) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date, node ORDER BY s DESC, other) AS rank FROM (SELECT date, a AS node, b AS other, s FROM ss UNION ALL SELECT date, b, a, s FROM ss)) WHERE rank <= 5 GROUP BY 1, 2, 3"
_MIG = f"WITH ss AS (SELECT date, a, b, CASE WHEN c > 0 THEN round(nmi, 9) ELSE 0.0 END AS s FROM nmi JOIN corr USING (date, a, b)) {_MK}"


def _mi_edges(b: Base) -> DataFrame:
    s = information.similarity(b.nmi, b.corr).select("date", "a", "b", F.round("s", 9).alias("s"))
    return graph.knn_edges(graph.ranked_neighbours(s, b.config.graph.k), b.config.graph.k)


@query("m12_timing")
def _(b):
    return information.timings(_middle(b), b.config.information, b.dates.count())


@query("m13_meta", "SELECT date, avg(mi) AS mean_mi, avg(nmi) AS mean_nmi, avg(mi + 0.5 * ln(1 - c * c)) AS mean_delta, avg(CAST(mi > 0.05 AS INTEGER)) AS frac_above_null FROM nmi JOIN corr USING (date, a, b) GROUP BY 1", "mean_mi", "mean_nmi", "mean_delta", "frac_above_null")
def _(b):
    return information.sequence_meta(b.nmi, information.similarity(b.nmi, b.corr), 0.05)


@query("m13_mi_graph", _MIG, "weight", digits=9)  # similarities are rounded to nine digits once, before they are ranked
def _(b):
    return _mi_edges(b)


@query(
    "m14_compare_graphs",
    f"WITH me AS ({_MIG}) SELECT r.date, coalesce(j, 0.0) AS jaccard FROM reb r LEFT JOIN (SELECT date, count(*) FILTER (x AND y) / count(*) AS j FROM (SELECT date, a, b, bool_or(k = 0) AS x, bool_or(k = 1) AS y FROM (SELECT date, a, b, 0 AS k FROM edge WHERE weight <> 0 UNION ALL SELECT date, a, b, 1 FROM me WHERE weight <> 0) GROUP BY 1, 2, 3) GROUP BY 1) USING (date)",
    "jaccard",
)
def _(b):
    return graph.jaccard(b.edges, _mi_edges(b), b.dates)


@query("m15_estimator_arguments", "SELECT * FROM (VALUES ('binned', 'n', 6), ('ksg', 'k', 4)) t(estimator, name, value)")
def _(b):
    from dataclasses import replace

    rows = [(e, k, v) for e in sorted(information.ESTIMATORS) for k, v in information.estimator_arguments(replace(b.config.information, estimator=e)).items()]
    return b.spark.createDataFrame(rows, "estimator string, name string, value int")


# ---- embeddings

_W1, _W2 = embedding.fixed_weights(13, 8, 1), embedding.fixed_weights(8, 4, 2)
_H = [f"h{k}" for k in range(8)]


def _mul(columns: list[str], weights: list[list[float]], k: int) -> str:
    return " + ".join(f"{c} * CAST({w[k]} AS DOUBLE)" for c, w in zip(columns, weights, strict=True))


_L1 = "SELECT adj.date, adj.node, " + ", ".join(f"sum(w * ({_mul(NAMES, _W1, k)})) AS h{k}" for k in range(8)) + " FROM adj JOIN x ON x.date = adj.date AND x.ticker = adj.other GROUP BY 1, 2"
_R1 = "SELECT date, node, " + ", ".join(f"greatest(h{k}, 0.0) AS h{k}" for k in range(8)) + f" FROM ({_L1})"
_Z = "SELECT adj.date, adj.node, " + ", ".join(f"sum(w * ({_mul(_H, _W2, k)})) AS z{k}" for k in range(4)) + f" FROM adj JOIN ({_R1}) g ON g.date = adj.date AND g.node = adj.other GROUP BY 1, 2"
_ZS = [f"z{k}" for k in range(4)]


def _x(b: Base) -> DataFrame:
    return b.x.withColumnRenamed("ticker", "node")


def _z(b: Base) -> DataFrame:
    adjacency = embedding.normalised_adjacency(b.edges, b.nodes)
    hidden = embedding.propagate(adjacency, _x(b), b.names, _W1, relu=True)
    return embedding.propagate(adjacency, hidden, _H, _W2).toDF("date", "node", *_ZS)


@query("n01_normalised_adjacency", "SELECT date, node, other, w FROM adj", "w")
def _(b):
    return embedding.normalised_adjacency(b.edges, b.nodes)


@query("n02_gcn_layer", _L1, *_H)
def _(b):
    return embedding.propagate(embedding.normalised_adjacency(b.edges, b.nodes), _x(b), b.names, _W1)


@query("n03_gcn_encoder", _Z, *_ZS)
def _(b):
    return _z(b)


_SHUFFLED = "SELECT p.date, p.ticker AS node, q.ticker AS donor, " + ", ".join(f"q.{c}" for c in NAMES) + " FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) AS place FROM x) p JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5('42:' || CAST(date AS VARCHAR) || ':' || ticker), ticker) AS place FROM x) q USING (date, place)"


@query("n04_corruption", _SHUFFLED, *NAMES)
def _(b):
    return embedding.corrupted(_x(b), b.names, b.config.training.seed)


_W3 = embedding.fixed_weights(4, 4, 3)
_LOGIT = " + ".join(f"z{i} * CAST({w} AS DOUBLE) * s{j}" for i, row in enumerate(_W3) for j, w in enumerate(row))
_SUMMARY = "SELECT date, " + ", ".join(f"1 / (1 + exp(-avg(z{j}))) AS s{j}" for j in range(4)) + " FROM zz GROUP BY date"


@query("n05_discriminator", f"WITH zz AS ({_Z}) SELECT date, node, {_LOGIT} AS logit FROM zz JOIN ({_SUMMARY}) USING (date)", "logit")
def _(b):
    z = _z(b)
    return embedding.discriminate(z, z, _ZS, _W3)


_GUESS = "0.1 + " + " + ".join(f"z{k} * CAST({w[0]} AS DOUBLE)" for k, w in enumerate(embedding.fixed_weights(4, 1, 4)))


@query("n07_masked_loss", f"SELECT z.date, count(y) AS n_known, coalesce(avg(pow({_GUESS} - y, 2)), 0.0) AS mse FROM ({_Z}) z LEFT JOIN fv ON fv.date = z.date AND fv.ticker = z.node GROUP BY z.date", "mse")
def _(b):
    target = features.forward_vol(b.panel.select("date", "ticker", "log_ret"), b.dates).withColumnRenamed("ticker", "node")
    return embedding.head_loss(_z(b), target, _ZS, [w[0] for w in embedding.fixed_weights(4, 1, 4)], 0.1)


def _walk(b: Base) -> DataFrame:
    target = features.vol_target(b.panel.select("date", "ticker", "log_ret"), b.dates, b.config.features.winsor)
    return embedding.walk_forward(b.x, b.edges, target, b.dates, b.config)


@query("n06_training_log")
def _(b):
    log = _walk(b).filter("ticker is null")
    at = lambda c: F.get_json_object("log", f"$.{c}").cast("double").alias(c)
    return log.select("refit", *map(at, ("epochs", "best_epoch", "train_first", "train_final", "val_best", "erank_mean", "var_mean", "n_embed")))


@query("n09_embeddings")
def _(b):
    return _walk(b).filter("ticker is not null").select("refit", "date", "ticker", F.posexplode("z").alias("dim", "value"))


_SCHED = "SELECT CAST(r AS INTEGER) AS refit, role, CAST(o AS INTEGER) AS ordinal FROM (SELECT r, 'train' AS role, unnest(range(r * 6, r * 6 + 8)) AS o FROM rr UNION ALL SELECT r, 'embed', unnest(range(r * 6 + 9, least(r * 6 + 15, n))) FROM rr)"


@query("n10_schedule", f"WITH nn AS (SELECT count(*) AS n FROM reb), rr AS (SELECT unnest(range(0, (n - 1 - 9) // 6 + 1)) AS r, n FROM nn WHERE n > 9) {_SCHED}")
def _(b):
    t = b.config.training
    return embedding.schedule(b.dates, t.window, t.embargo, t.refit)


@query("n11_forward_vol", "SELECT date, ticker, y FROM fv", "y")
def _(b):
    return features.forward_vol(b.panel.select("date", "ticker", "log_ret"), b.dates)


@query("n12_effective_rank")
def _(b):
    x, z = (embedding.spectra(m, c).select("date", F.col("erank").alias(n)) for m, c, n in ((b.x, b.names, "erank_x"), (_z(b), _ZS, "erank_z")))
    return x.join(z, "date")


@query("n15_weight_draws")
def _(b):
    m = b.config.model
    return embedding.weight_draws(b.spark, [len(b.names)] + [m.hidden] * (m.layers - 1) + [m.embed], b.config.training.seed)


@query("n13_embedding_variance", f"SELECT date, ({' + '.join(f'var_pop({c})' for c in _ZS)}) / 4 AS variance FROM ({_Z}) GROUP BY 1", "variance")
def _(b):
    return embedding.embedding_variance(_z(b), _ZS)


@query("n14_skill", f"SELECT date, CASE WHEN count(*) >= 3 THEN corr(rv, ry) END AS rho FROM ({_RANKED.replace('x.vol_63', 'x.mom_63')}) GROUP BY 1", "rho")
def _(b):
    target = features.forward_vol(b.panel.select("date", "ticker", "log_ret"), b.dates)
    return embedding.spearman_by(b.x.select("date", "ticker", "mom_63").join(target, ["date", "ticker"]), "mom_63", "y")


# ---- reports

_SANE = ", ".join(f"{{'feature': '{c}', 'med': median({c}), 'p01': quantile_cont({c}, 0.01), 'p99': quantile_cont({c}, 0.99), 'low': min({c}), 'high': max({c})}}" for c in FEATURES)


@query("d01_sanity", f"SELECT feature, med, p01, p99, low, high FROM (SELECT unnest([{_SANE}], recursive := true) FROM feat)", "med", "p01", "p99", "low", "high")
def _(b):
    long = b.features.unpivot(["date", "ticker"], list(FEATURES), "feature", "v")
    q = lambda p: F.percentile("v", F.lit(p))
    return long.groupBy("feature").agg(F.median("v").alias("med"), q(0.01).alias("p01"), q(0.99).alias("p99"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("d02_mean_beta", "SELECT date, avg(beta_252) AS beta FROM feat GROUP BY 1", "beta")
def _(b):
    return b.features.groupBy("date").agg(F.avg("beta_252").alias("beta"))


@query("d03_idio_over_total", "SELECT count(*) FILTER (idio_vol_252 > v * sqrt(252.0) + 1e-9) AS violations FROM feat JOIN (SELECT date, ticker, stddev_samp(r) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS v FROM mk) USING (date, ticker)")
def _(b):
    from corvane.functions.stats import trailing

    total = b.panel.select("date", "ticker", (F.stddev_samp("log_ret").over(trailing(252)) * features.YEAR).alias("v"))
    return b.features.join(total, ["date", "ticker"]).agg(F.count_if(F.col("idio_vol_252") > F.col("v") + 1e-9).alias("violations"))


@query("d04_strongest_partner", f"SELECT feature, partner, corr FROM (SELECT a AS feature, b AS partner, corr FROM ({_CORR}) UNION ALL SELECT b, a, corr FROM ({_CORR})) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC, partner) = 1", "corr")
def _(b):
    pairs = features.feature_correlation(b.x, b.names)
    both = pairs.toDF("feature", "partner", "corr").union(pairs.select("b", "a", "corr"))
    best = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc(F.abs("corr")), "partner"))
    return both.withColumn("n", best).filter("n = 1").drop("n")


@query("d05_dead_features", "SELECT feature, stddev_samp(value) AS sd, stddev_samp(value) < 0.1 AS dead FROM long GROUP BY 1", "sd")
def _(b):
    return features.unpivot(b.x, b.names).groupBy("feature").agg(F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") < 0.1).alias("dead"))


@query("d06_no_lookahead", "SELECT count(*) AS changed FROM reb WHERE false")
def _(b):
    """Features up to a date do not change when all later prices do."""
    cut = b.calendar.agg(F.expr("cast(max(pos) * 3 div 4 as int)").alias("cut"))
    turned = b.panel.join(F.broadcast(cut), F.lit(True)).withColumn("log_ret", F.when(F.col("pos") > F.col("cut"), F.col("log_ret") * -3 + 0.1).otherwise(F.col("log_ret"))).drop("cut")
    early = lambda f: tidy(f.join(F.broadcast(cut), F.lit(True)).filter("pos <= cut").drop("cut"))
    return early(b.features).exceptAll(early(features.rolling_features(turned))).agg(F.count(F.lit(1)).alias("changed"))


@query("d07_adjacency_spectrum")
def _(b):
    return embedding.adjacency_spectrum(embedding.normalised_adjacency(b.edges, b.nodes))


@query("d07_negative_edges", "SELECT e.date, negative, min_row FROM (SELECT date, count(*) FILTER (weight < 0) AS negative FROM edge GROUP BY 1) e JOIN (SELECT date, min(total) AS min_row FROM (SELECT date, node, sum(w) AS total FROM adj0 GROUP BY 1, 2) GROUP BY 1) r USING (date)", "min_row")
def _(b):
    ends = b.edges.select("date", F.col("a").alias("node"), "weight").union(b.edges.select("date", "b", "weight")).union(b.nodes.select("date", "node", F.lit(1.0)))
    rows = ends.groupBy("date", "node").agg(F.sum("weight").alias("total")).groupBy("date").agg(F.min("total").alias("min_row"))
    return b.edges.groupBy("date").agg(F.count_if(F.col("weight") < 0).alias("negative")).join(rows, "date")


@query("d08_layer_variance", f"SELECT date, ({' + '.join(f'var_pop({c})' for c in NAMES)}) / 13 AS v_in, v1 FROM x JOIN (SELECT date, ({' + '.join(f'var_pop({c})' for c in _H)}) / 8 AS v1 FROM ({_L1}) GROUP BY 1) USING (date) GROUP BY date, v1", "v_in", "v1")
def _(b):
    layer = embedding.propagate(embedding.normalised_adjacency(b.edges, b.nodes), _x(b), b.names, _W1)
    return embedding.embedding_variance(b.x, b.names).withColumnRenamed("variance", "v_in").join(embedding.embedding_variance(layer, _H).withColumnRenamed("variance", "v1"), "date")


@query("d08_initialisations")
def _(b):
    """Variance after one layer under both rules of drawing weights."""
    import numpy as np

    adjacency, out = embedding.normalised_adjacency(b.edges, b.nodes), None
    for name, draw in (("glorot", embedding.glorot), ("kaiming", embedding.kaiming)):
        weights = draw(np.random.default_rng(b.config.training.seed), len(b.names), 8).tolist()
        row = embedding.embedding_variance(embedding.propagate(adjacency, _x(b), b.names, weights), _H).select("date", F.lit(name).alias("rule"), "variance")
        out = row if out is None else out.unionByName(row)
    return out


@query("d09_components_for_90")
def _(b):
    return embedding.spectra(b.x, b.names).select("date", "n90")


@query("d10_pca_shares")
def _(b):
    return embedding.spectra(b.x, b.names).select("date", "pca1", "pca2")


_SIL = "SELECT date, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT date, node, max(d) FILTER (label = lo) AS a, min(d) FILTER (label <> lo) AS b FROM (SELECT z.date, z.node, l.label, m.label AS lo, avg(z.d) AS d FROM (SELECT date, a AS node, b AS other, sqrt(d2) AS d FROM pd UNION ALL SELECT date, b, a, sqrt(d2) FROM pd) z JOIN lab l ON l.node = z.node JOIN lab m ON m.node = z.other GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1"


@query("d11_silhouette", _SIL, "silhouette")
def _(b):
    return graph.silhouette(b.distances, b.labels)


@query("d12_persistence_summary", f"SELECT avg(jaccard) AS mean, min(jaccard) AS low FROM ({_PERSIST})", "mean", "low")
def _(b):
    return graph.persistence(b.edges, b.dates).agg(F.avg("jaccard").alias("mean"), F.min("jaccard").alias("low"))

