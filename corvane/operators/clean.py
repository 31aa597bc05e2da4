"""Cleaning a long price table to a complete panel: coverage, calendar, universe, bounded fill, derived series.

Assets and sessions are small beside prices; the grid of both is the panel's own size. All per-asset work shares one partitioning by ticker.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.config import Universe

PRICES = ("open", "high", "low", "close")


def dedup_last(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key by sequence, which must order a key's rows."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in sequence])
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def sessions(df: DataFrame) -> DataFrame:
    """date, pos: distinct dates in order. One row a session."""
    return df.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def coverage(closes: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, n_obs, first_date, last_date, frac_sessions, frac_internal_nan (holes between first and last). closes: a row for each asked cell; an asset without any close has 1.0."""
    held = F.col("close").isNotNull()
    at = lambda c: F.when(held, F.col(c))
    found = closes.join(calendar, "date").groupBy("ticker").agg(
        F.count("close").alias("n_obs"), F.min(at("date")).alias("first_date"), F.max(at("date")).alias("last_date"), F.min(at("pos")).alias("_a"), F.max(at("pos")).alias("_b")
    )
    total = calendar.agg(F.count(F.lit(1)).alias("_n"))
    hole = F.when(F.col("n_obs") == 0, 1.0).otherwise(1 - F.col("n_obs") / (F.col("_b") - F.col("_a") + 1))
    return found.join(F.broadcast(total), F.lit(True)).select("ticker", "n_obs", "first_date", "last_date", (F.col("n_obs") / F.col("_n")).alias("frac_sessions"), hole.alias("frac_internal_nan"))


def filter_universe(report: DataFrame, min_history: int, max_missing: float) -> DataFrame:
    return report.filter((F.col("n_obs") >= min_history) & (F.col("frac_internal_nan") <= max_missing)).select("ticker")


def build_calendar(closes: DataFrame, min_coverage: float) -> DataFrame:
    """Sessions at which the share of assets with a close is min_coverage or more."""
    total = closes.agg(F.countDistinct("ticker").alias("_n"))
    counted = closes.groupBy("date").agg(F.count("close").alias("n")).join(F.broadcast(total), F.lit(True))
    return sessions(counted.filter(F.col("n") / F.col("_n") >= min_coverage))


def filter_full_history(report: DataFrame, calendar: DataFrame, tolerance: int) -> DataFrame:
    """Assets whose first close is within tolerance days of the first session, that day included."""
    start = calendar.agg(F.min("date").alias("_start"))
    return report.join(F.broadcast(start), F.lit(True)).filter(F.col("first_date") <= F.date_add("_start", tolerance)).select("ticker")


def grid(raw: DataFrame, calendar: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each session and kept asset, with null where raw has none."""
    spine = calendar.crossJoin(kept)  # the panel's rectangle itself
    return spine.join(raw, ["date", "ticker"], "left")


def fill(cells: DataFrame, most: int) -> DataFrame:
    """Carries prices forward over at most so many sessions, and tells where. Volume is not carried, and zero volume is none."""
    back = Window.partitionBy("ticker").orderBy("pos").rowsBetween(-most, 0)
    carried: Column = F.last("close", ignorenulls=True).over(back)
    filled = F.col("close").isNull() & carried.isNotNull()
    prices = [F.last(c, ignorenulls=True).over(back).alias(c) for c in PRICES]
    volume = F.when(~filled & (F.col("volume") > 0), F.col("volume")).alias("volume")
    return cells.select("date", "pos", "ticker", *prices, volume, filled.alias("is_filled"))


def derive(filled: DataFrame) -> DataFrame:
    """Adds log_ret (null on carried cells; the next real one spans the gap) and dollar_volume."""
    before = F.lag(F.log("close")).over(Window.partitionBy("ticker").orderBy("pos"))
    return filled.withColumn("log_ret", F.when(~F.col("is_filled"), F.log("close") - before)).withColumn("dollar_volume", F.col("close") * F.col("volume"))


def kept_assets(raw: DataFrame, settings: Universe) -> tuple[DataFrame, DataFrame]:
    """The calendar and the assets: filtered before the calendar, so that one bad series sets no session, and again on it."""
    first = filter_universe(coverage(raw, sessions(raw)), settings.min_history, settings.max_missing)
    calendar = build_calendar(raw.join(first, "ticker", "left_semi"), settings.min_coverage)
    report = coverage(raw.join(first, "ticker", "left_semi"), calendar)
    kept = filter_universe(report, settings.min_history, settings.max_missing)
    if settings.full_history:
        kept = filter_full_history(report.join(kept, "ticker", "left_semi"), calendar, settings.start_tolerance)
    return calendar, kept


def build_panel(raw: DataFrame, settings: Universe, check: bool = False) -> DataFrame:
    """date, pos, ticker, prices, volume, is_filled, log_ret, dollar_volume. check: raises if a cell stays empty though full history is asked for."""
    calendar, kept = kept_assets(raw, settings)
    panel = derive(fill(grid(raw, calendar, kept), settings.max_fill))
    if check and settings.full_history:
        holes = panel.filter("close is null").select("ticker").distinct().orderBy("ticker").limit(20).collect()
        if holes:
            raise ValueError(f"empty closes after filling: {[x.ticker for x in holes]}")
    return panel.filter("close is not null")


def panel_report(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Coverage of the filled close, with max_abs_ret and n_filled."""
    more = panel.groupBy("ticker").agg(F.max(F.abs("log_ret")).alias("max_abs_ret"), F.count_if("is_filled").alias("n_filled"))
    return coverage(panel.select("date", "ticker", "close"), calendar.select("date", "pos")).join(more, "ticker")


def download_report(panel: DataFrame) -> DataFrame:
    """ticker, n_rows, first_date, last_date, n_zero_volume, ends_early (a week or more before most)."""
    each = panel.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.coalesce("volume", F.lit(0.0)) <= 0).alias("n_zero_volume")
    )
    modal = each.agg(F.mode("last_date", deterministic=True).alias("_modal"))
    return each.join(F.broadcast(modal), F.lit(True)).withColumn("ends_early", F.col("last_date") < F.date_sub("_modal", 7)).drop("_modal")


def symbol_differences(asked: DataFrame, got: DataFrame) -> DataFrame:
    """ticker, kind: absent (asked, not got) or unexpected."""
    absent = asked.select("ticker").subtract(got.select("ticker")).withColumn("kind", F.lit("absent"))
    return absent.union(got.select("ticker").subtract(asked.select("ticker")).withColumn("kind", F.lit("unexpected")))
