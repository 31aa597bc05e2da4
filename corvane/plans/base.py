"""Base tables that queries share: each is built on first use and, where it is used again, written to the shared folder."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.stats import rounded
from corvane.operators import clean, features, graph, information
from corvane.plans.config import WEEKLY, Config
from corvane.sources import tables


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded."""
    return df.select(*[rounded(x.name, digits).alias(x.name) if isinstance(x.dataType, (T.DoubleType, T.FloatType)) else F.col(x.name) for x in df.schema])


class Base:
    """Tables derived from one folder. Those that take a shuffle to build (panel, features, correlations, edges) are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = WEEKLY, unit: str = "week"):
        self.spark, self.sf_dir, self.config, self.unit = spark, sf_dir, config, unit

    def store(self, df: DataFrame) -> DataFrame:
        """Writes a table that several queries read; plans start from its files."""
        return tables.stored(df)

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return self.store(tables.raw_prices(self.spark, self.sf_dir, self.unit))

    @cached_property
    def assets(self) -> DataFrame:
        """ticker, label."""
        return self.table("nation").select(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("label"))

    @cached_property
    def kept(self) -> tuple[DataFrame, DataFrame]:
        calendar, kept = clean.kept_assets(self.raw, self.config.universe)
        return self.store(calendar), self.store(kept)

    @property
    def calendar(self) -> DataFrame:
        return self.kept[0]

    @cached_property
    def panel(self) -> DataFrame:
        filled = clean.fill(clean.grid(self.raw, *self.kept), self.config.universe.max_fill)
        return self.store(clean.derive(filled).filter("close is not null"))

    @cached_property
    def features(self) -> DataFrame:
        return self.store(features.rolling_features(self.panel))

    @cached_property
    def dates(self) -> DataFrame:
        return self.store(features.rebalance_dates(self.panel.select("date", "pos").distinct(), self.config.features.burn_in))

    @cached_property
    def names(self) -> list[str]:
        return features.feature_names(self.config.features.exclude)

    @cached_property
    def x(self) -> DataFrame:
        return self.store(features.assemble(self.features, self.dates, self.config.features))

    @cached_property
    def returns(self) -> DataFrame:
        return tables.load_returns(self.panel)

    @cached_property
    def windows(self) -> DataFrame:
        on_returns = self.dates.select("date", (F.col("pos") - 1).alias("pos"))
        return self.store(features.trailing_windows(self.returns, on_returns, self.config.graph.window))

    @cached_property
    def residuals(self) -> DataFrame:
        """windows without their first principal components: what graphs and information are made from."""
        return self.store(graph.residual_windows(self.windows, self.config.graph.n_factors))

    @cached_property
    def corr(self) -> DataFrame:
        """Shrunk correlations of residuals."""
        return self.store(graph.correlations(self.residuals, replace(self.config.graph, n_factors=0)))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.store(graph.nodes_of(self.corr))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.store(graph.ranked_neighbours(graph.similarity(self.corr), max(self.config.graph.k_sweep)))

    @cached_property
    def edges(self) -> DataFrame:
        return self.store(graph.knn_edges(self.ranked, self.config.graph.k))

    @cached_property
    def labels(self) -> DataFrame:
        """node, label of the panel's assets."""
        return self.store(tables.load_labels(self.panel.select("ticker").distinct(), self.assets).withColumnRenamed("ticker", "node"))

    @cached_property
    def distances(self) -> DataFrame:
        return self.store(graph.pair_distances(self.x, self.names))

    @cached_property
    def binned(self) -> DataFrame:
        return self.store(information.bins(self.residuals, self.config.information.bins, self.config.information.scheme))

    @cached_property
    def joint(self) -> DataFrame:
        return self.store(information.joint_counts(self.binned))

    @cached_property
    def nmi(self) -> DataFrame:
        return self.store(information.normalised(information.binned(self.joint), information.entropies(self.binned)))


_bases: dict[tuple, Base] = {}


def base(spark: SparkSession, sf_dir: str) -> Base:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        _bases[key] = Base(spark, sf_dir)
    return _bases[key]


def forget(spark: SparkSession) -> None:
    """Has base tables built anew, for timing."""
    _bases.clear()
    spark.catalog.clearCache()
