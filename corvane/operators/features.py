"""Right-aligned rolling features of a panel, robust standardisation of cross-sections, and the rebalance clock."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stats import adjusted_kurtosis, adjusted_skew, clipped, min_periods, trailing
from corvane.plans.config import ANNUAL, FEATURES, Features

MIN_DOWN = 20
YEAR = float(ANNUAL) ** 0.5


def _guarded(value: Column, counted: Column, n: int) -> Column:
    """value over the last n rows, null under four fifths of them."""
    return F.when(F.count(counted).over(trailing(n)) >= min_periods(n), value)


def with_market(panel: DataFrame) -> DataFrame:
    """Adds market: the mean return of the session, null passed over."""
    return panel.withColumn("market", F.avg("log_ret").over(Window.partitionBy("date")))


def rolling_features(panel: DataFrame) -> DataFrame:
    """All features for each cell. One shuffle by date for the market, one by ticker for the windows, which share its sort."""
    r, m = F.col("log_ret"), F.col("market")
    down, ratio = F.when(r <= 0, r), F.abs(r) / F.col("dollar_volume")
    both = F.when(r.isNotNull() & m.isNotNull(), m)
    w21, w63, w252 = trailing(21), trailing(63), trailing(252)
    mean_ratio = F.avg(ratio).over(w63)
    var_m = F.var_samp(both).over(w252)
    beta = F.when(var_m > 0, F.covar_samp(r, m).over(w252) / var_m)
    base = with_market(panel).select(
        "date", "pos", "ticker", "log_ret", "market", "close",
        _guarded(F.stddev_samp(r).over(w21) * YEAR, r, 21).alias("vol_21"),
        _guarded(F.stddev_samp(r).over(w63) * YEAR, r, 63).alias("vol_63"),
        F.when((F.count(down).over(w63) >= MIN_DOWN) & (F.count(r).over(w63) >= min_periods(63)), F.stddev_samp(down).over(w63) * YEAR).alias("semivol_63"),
        _guarded(adjusted_skew(r, w252), r, 252).alias("skew_252"),
        _guarded(adjusted_kurtosis(r, w252), r, 252).alias("kurt_252"),
        _guarded(F.log(F.avg("dollar_volume").over(w63)), F.col("dollar_volume"), 63).alias("log_adv_63"),
        _guarded(F.when(mean_ratio > 0, F.log(mean_ratio)), ratio, 63).alias("amihud_63"),
        _guarded(F.avg(F.when(r.isNotNull(), (F.abs(r) < 1e-8).cast("double"))).over(w63), r, 63).alias("zero_ret_frac_63"),
        _guarded(beta, both, 252).alias("beta_252"),
        _guarded(F.when(var_m > 0, F.sqrt(F.greatest(F.var_samp(r).over(w252) - beta * F.covar_samp(r, m).over(w252), F.lit(0.0))) * YEAR), both, 252).alias("idio_vol_252"),
        _guarded(F.sum(r).over(w21), r, 21).alias("mom_21"),
        _guarded(F.sum(r).over(w63), r, 63).alias("mom_63"),
        _guarded(F.sum(r).over(w252), r, 252).alias("_mom_252"),
        _guarded(F.log(F.col("close") / F.max("close").over(w252)), F.col("close"), 252).alias("dist_52w_high"),
    )
    nested = _guarded(F.stddev_samp("vol_21").over(w63), F.col("vol_21"), 63)
    out = base.withColumn("volofvol_63", nested).withColumn("mom_252_21", F.col("_mom_252") - F.col("mom_21"))
    return out.select("date", "pos", "ticker", *FEATURES)


def rebalance_dates(calendar: DataFrame, burn_in: int = 252) -> DataFrame:
    """date, pos, ordinal: the last session of each month once the longest window is full."""
    last = calendar.filter(F.col("pos") >= burn_in).groupBy(F.trunc("date", "MM").alias("_m")).agg(F.max("date").alias("date"), F.max("pos").alias("pos"))
    return last.select("date", "pos", (F.row_number().over(Window.orderBy("date")) - 1).alias("ordinal"))


def subsample(dates: DataFrame, most: int) -> DataFrame:
    """At most so many evenly spaced dates, first and last included; positions are rounded half to even."""
    total = dates.agg(F.count(F.lit(1)).alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("i")
    wanted = total.select("n", step).select(F.bround(F.col("i") * (F.col("n") - 1) / max(most - 1, 1)).cast("int").alias("ordinal")).distinct()
    return dates.join(wanted, "ordinal", "left_semi")


def standardise(df: DataFrame, columns: list[str], winsor: float = 3.0, by: str = "date") -> DataFrame:
    """Centres columns on the date's median and scales by 1.4826 MAD, by the standard deviation if that is no scale, and by 1 if neither is; clips last."""
    w = Window.partitionBy(by)
    dev = df.select("*", *[(F.col(c) - F.median(c).over(w)).alias(f"_d_{c}") for c in columns])
    scaled = dev.select(
        "*",
        *[(F.median(F.abs(f"_d_{c}")).over(w) * 1.4826).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).over(w).alias(f"_s_{c}") for c in columns],
    )
    scale = lambda c: F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}")).when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    kept = [x for x in df.columns if x not in columns]
    return scaled.select(*kept, *[clipped(F.col(f"_d_{c}") / scale(c), winsor).alias(c) for c in columns])


def feature_names(exclude: tuple[str, ...]) -> list[str]:
    unknown = set(exclude) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return [x for x in FEATURES if x not in exclude]


def assemble(features: DataFrame, dates: DataFrame, settings: Features) -> DataFrame:
    """Standardised features of the rebalance dates, null as 0. Cross-sections are apart from each other, so only these dates are standardised."""
    names = feature_names(settings.exclude)
    rows = features.join(dates.select("date"), "date", "left_semi").select("date", "ticker", *names)
    out = standardise(rows, names, settings.winsor)
    return out.select("date", "ticker", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def unpivot(x: DataFrame, names: list[str]) -> DataFrame:
    """date, ticker, feature, value."""
    return x.unpivot(["date", "ticker"], names, "feature", "value")


def feature_correlation(x: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr over all rows for pairs of features a < b; one pass over x."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = x.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def forward_vol(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """date, ticker, y: annualised deviation of returns after a rebalance date up to the next, that included; null on the last.

    Each session is given its own interval's start, so that the join is on equal dates.
    """
    spans = dates.select(F.col("date").alias("start"), F.lead("date").over(Window.orderBy("date")).alias("stop"))
    calendar = returns.select("date").distinct()
    inside = calendar.join(spans, (F.col("date") > F.col("start")) & (F.col("date") <= F.col("stop"))).select("date", "start")
    vol = returns.join(inside, "date").groupBy("start", "ticker").agg((F.stddev_samp("log_ret") * YEAR).alias("y"))
    every = dates.select("date").crossJoin(returns.select("ticker").distinct())
    return every.join(vol.withColumnRenamed("start", "date"), ["date", "ticker"], "left")


def vol_target(returns: DataFrame, dates: DataFrame, winsor: float = 3.0) -> DataFrame:
    return standardise(forward_vol(returns, dates), ["y"], winsor)


def trailing_windows(returns: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """rebal, t, ticker, r: each rebalance date's last window of returns, as an equi-join on positions. dates: date and pos on the returns' axis."""
    place = F.explode(F.sequence(F.col("pos") - window + 1, F.col("pos"))).alias("pos")
    wanted = dates.select(F.col("date").alias("rebal"), (F.col("pos") - window + 1).alias("_from"), place)
    return returns.select("pos", "ticker", "r").join(wanted, "pos").select("rebal", (F.col("pos") - F.col("_from")).alias("t"), "ticker", "r")


def check_windows(dates: DataFrame, window: int) -> None:
    short = dates.filter(F.col("pos") < window - 1).orderBy("date").limit(1).collect()
    if short:
        raise ValueError(f"{short[0].date} has too little history for a window of {window}")


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """date, nearest: for each left date the nearest right one, the earlier of two as near; null if there is none.

    Dates meet in an equi-join on months; what lies beyond a month's edges comes from the one row that each month has.
    """
    month = F.trunc("date", "MM").alias("month")
    asked, held = left.select("date").distinct().select("date", month), right.select("date").distinct().select(F.col("date").alias("other"), month)
    ends = held.groupBy("month").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    months = asked.select("month").union(held.select("month")).distinct().join(ends, "month", "left")
    up, down = (Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc("month"), F.desc("month")))
    edges = months.select("month", F.max("high").over(up).alias("before"), F.min("low").over(down).alias("after"))
    met = asked.join(held, "month", "left").groupBy("date", "month").agg(F.max(F.when(F.col("other") <= F.col("date"), F.col("other"))).alias("a"), F.min(F.when(F.col("other") >= F.col("date"), F.col("other"))).alias("b"))
    found = met.join(edges, "month").select("date", F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
    later = F.col("a").isNull() | (F.datediff("b", "date") < F.datediff("date", "a"))
    return left.join(found.select("date", F.when(F.coalesce(later, F.lit(False)), F.col("b")).otherwise(F.col("a")).alias("nearest")), "date", "left").select("date", "nearest")
