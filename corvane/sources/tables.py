"""Sources and sinks: Parquet, CSV and NPZ tables, a universe dimension, cached batches, and a price panel from line items."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIVERSE_SCHEMA = "ticker string, name string, sector string, yahoo_ticker string, status string, notes string"
PRICES_SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double"
FIELDS = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_prices(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """A long price table from line items: an asset is a nation of suppliers, a session a week or a day.

    Money is summed as decimals, so that sums do not depend on order. The dimensions are joined before the one aggregation; Spark's own size
    check decides whether they are broadcast.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    assets = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("label"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = item.join(assets, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("date", F.to_date(F.date_trunc(unit, "l_shipdate")))
    return rows.groupBy("date", "ticker", "label").agg(
        F.min_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (money("l_extendedprice") / money("l_quantity")).alias("close"),
        money("l_quantity").alias("volume"),
    )


def load_universe(source: DataFrame) -> DataFrame:
    """Symbols to ask for: dead ones left out, the source's own symbol before the ticker, dots as dashes; distinct and sorted."""
    status = F.lower(F.trim(F.coalesce("status", F.lit("active"))))
    own = F.trim(F.coalesce("yahoo_ticker", F.lit("")))
    symbol = F.when(own != "", own).otherwise(F.trim("ticker"))
    live = source.filter(status != "delisted")
    return live.select(F.replace(F.upper(symbol), F.lit("."), F.lit("-")).alias("symbol")).filter("symbol <> ''").distinct().orderBy("symbol")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=UNIVERSE_SCHEMA)


def load_labels(keys: DataFrame, dimension: DataFrame) -> DataFrame:
    """ticker, label for all keys; raises if a key has none."""
    missing = keys.join(dimension.filter("label is not null"), "ticker", "left_anti")
    if names := [x.ticker for x in missing.select("ticker").distinct().orderBy("ticker").limit(20).collect()]:
        raise ValueError(f"no label for {names}")
    return keys.join(dimension, "ticker", "left").select("ticker", "label")


def load_returns(panel: DataFrame) -> DataFrame:
    """date, pos, ticker, r: the first session, which has no returns, goes; other nulls count as 0. pos counts from 0 on what stays."""
    return panel.filter("pos > 0").select("date", (F.col("pos") - 1).alias("pos"), "ticker", F.coalesce("log_ret", F.lit(0.0)).alias("r"))


def to_long(wide: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Columns named ticker_field to a row for each ticker; a ticker's absent field is null."""
    names = {c: c.rsplit("_", 1) for c in wide.columns if c != "date"}
    tickers = sorted({t for t, f in names.values() if f.lower() in fields})
    lower = {(t, f.lower()): c for c, (t, f) in names.items()}
    value = lambda t, f: F.col(f"`{lower[t, f]}`").cast("double") if (t, f) in lower else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[value(t, f).alias(f) for f in fields]) for t in tickers])
    return wide.select("date", F.explode(rows).alias("x")).select("date", "x.*")


def to_wide(panel: DataFrame, value: str, tickers: list[str] | None = None) -> DataFrame:
    """A date by ticker rectangle, for reports; long tables serve all else."""
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first(value))


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_with_config(df: DataFrame, path: str, config_json: str) -> None:
    """A table with its settings as a JSON column, so that they go where the rows go."""
    df.withColumn("config_json", F.lit(config_json)).write.mode("overwrite").parquet(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).select("config_json").first()[0])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that driver and executors share; of our own only where none is set, as on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/corvane-shared"
    return f"{root.rstrip('/')}/corvane-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read again: later plans are short, and a lost executor costs a read."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, folder: str, digest: str, make: Callable[[], DataFrame], by: str = "date") -> DataFrame:
    """Rows made once for each digest of settings and stored by date; other settings never see them."""
    path = f"{folder}/config={digest}"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    make().write.mode("overwrite").partitionBy(by).parquet(path)
    return spark.read.parquet(path)


def read_npz(spark: SparkSession, pattern: str) -> DataFrame:
    """Arrays of .npy and .npz files as path, name, place array<int>, value; files are read by Spark's binary source."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got = np.load(io.BytesIO(raw), allow_pickle=False)
                arrays = {k: got[k] for k in got.files} if hasattr(got, "files") else {"": got}
                for name, x in arrays.items():
                    if x.dtype.kind in "fiub":
                        index = np.indices(x.shape, np.int32).reshape(x.ndim, -1).T.ravel()
                        place = pa.ListArray.from_arrays(pa.array(np.arange(x.size + 1) * x.ndim, pa.int32()), pa.array(index, pa.int32()))
                        yield pa.RecordBatch.from_pydict({"path": [path] * x.size, "name": [name] * x.size, "place": place, "value": x.astype(float).ravel()})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "path string, name string, place array<int>, value double")


def write_npz(df: DataFrame, path: str) -> None:
    """Columns of a small ordered table as the arrays of one .npz file, which is a driver's file by nature."""
    import io

    import numpy as np
    import pyarrow.fs

    held, raw = df.toPandas(), io.BytesIO()
    np.savez(raw, **{c: held[c].to_numpy() for c in held.columns})
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(raw.getvalue())


def fetch(download: Callable[[list[str]], DataFrame | None], batch: list[str], retries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame | None:
    """Asks a source for a batch of symbols, again after growing pauses if it fails or gives no row; None if it never does."""
    for attempt in range(retries):
        try:
            got = download(batch)
            if got is not None and not got.isEmpty():
                return got
        except Exception:  # a source's own errors, of any kind: asked again below
            if attempt == retries - 1:
                return None
        if attempt < retries - 1:
            sleep(pause * 2**attempt)
    return None


def download_all(spark: SparkSession, download: Callable, symbols: list[str], folder: str, size: int = 25, use_cache: bool = True, **retry) -> DataFrame:
    """Symbols by batches, each stored when it has come, so that a run that broke off goes on where it was; rows without close go."""
    got = []
    for k in range(0, len(symbols), size):
        path, part = f"{folder}/batch={k // size}", None
        if use_cache:
            try:
                part = spark.read.schema(PRICES_SCHEMA).parquet(path)
                part.isEmpty()
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                part = None
        if part is None:
            part = fetch(download, symbols[k : k + size], **retry)
            if part is None:
                continue
            part.write.mode("overwrite").parquet(path)
            part = spark.read.schema(PRICES_SCHEMA).parquet(path)
        got.append(part)
    empty = spark.createDataFrame([], T._parse_datatype_string(PRICES_SCHEMA))
    out = empty
    for part in got:
        out = out.unionByName(part)
    return out.withColumn("date", F.to_date("date")).dropna(subset=["close"]).orderBy("date", "ticker")
