import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.plans.config import Config
from corvane.sources import tables
from corvane.streaming import windows

DAY = dt.date(2020, 1, 1)


def test_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name,sector,yahoo_ticker,status,notes\nAAA,a,x,,active,\nbrk.b,b,x,,,\nOLD,c,x,NEW,renamed,\nGONE,d,x,,delisted,\n AAA ,e,x,,active,\n")
    got = tables.load_universe(tables.read_universe(spark, str(tmp_path / "u.csv")))
    assert [x.symbol for x in got.collect()] == ["AAA", "BRK-B", "NEW"]


def batch(spark, names):
    return spark.createDataFrame([(DAY, n, 1.0, 1.0, 1.0, None if n == "NONE" else 1.0, 1.0) for n in names], tables.PRICES_SCHEMA)


def test_fetch_asks_again_with_growing_pauses(spark):
    asked, slept = [], []

    def download(names):
        asked.append(names)
        if len(asked) == 1:
            raise OSError
        return batch(spark, names if len(asked) > 2 else [])

    assert tables.fetch(download, ["A"], 3, 1.0, slept.append).count() == 1
    assert slept == [1.0, 2.0] and tables.fetch(lambda n: None, ["A"], 2, 1.0, slept.append) is None


def test_download_goes_on_where_it_was(spark, tmp_path):
    asked = []

    def download(names):
        asked.append(names)
        return None if "BAD" in names else batch(spark, names)

    run = lambda: tables.download_all(spark, download, ["A", "NONE", "BAD", "B"], str(tmp_path), 2, retries=1)
    assert [x.ticker for x in run().collect()] == ["A"] and len(asked) == 2
    assert [x.ticker for x in run().collect()] == ["A"] and asked[2:] == [["BAD", "B"]]


def test_labels_must_be_complete(spark):
    keys = spark.createDataFrame([("A",), ("B",)], "ticker string")
    with pytest.raises(ValueError, match="B"):
        tables.load_labels(keys, spark.createDataFrame([("A", 1), ("B", None)], "ticker string, label int"))


def test_wide_to_long_fills_absent_fields(spark):
    wide = spark.createDataFrame([(DAY, 1.0, 2.0)], "date date, A_Close double, `B.X_close` double")
    got = {x.ticker: x.asDict() for x in tables.to_long(wide).collect()}
    assert got["A"]["close"] == 1.0 and got["B.X"]["close"] == 2.0 and got["A"]["open"] is None
    long = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 2.0)], "date date, ticker string, close double")
    assert tables.to_wide(long, "close").first().asDict() == {"date": DAY, "A": 1.0, "B": 2.0}


def test_cache_depends_on_settings(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(DAY, 1)], "date date, v int")

    one, two = Config().digest(), Config.from_dict({"graph": {"k": 3}}).digest()
    for digest in (one, one, two):
        assert tables.cached(spark, str(tmp_path), digest, make).count() == 1
    assert len(made) == 2


def test_settings_travel_with_rows(spark, tmp_path):
    tables.write_with_config(spark.range(3).toDF("x"), str(tmp_path / "t"), Config().to_json())
    assert tables.read_config(spark, str(tmp_path / "t")) == json.loads(Config().to_json())
    with pytest.raises(ValueError):
        Config.from_dict({"odd": {}})


def test_npz(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3), names=np.array(["a", "b"]))
    np.save(tmp_path / "b.npy", np.array([True, False]))
    got = {(x.name, tuple(x.place)): x.value for x in tables.read_npz(spark, str(tmp_path) + "/*.np*").collect()}
    assert got["x", (1, 2)] == 5.0 and got["", (0,)] == 1.0 and len(got) == 8


def test_returns_start_at_the_second_session(spark):
    panel = spark.createDataFrame([(DAY, 0, "A", None), (DAY, 1, "A", 0.1), (DAY, 2, "A", None)], "date date, pos int, ticker string, log_ret double")
    assert [(x.pos, x.r) for x in tables.load_returns(panel).orderBy("pos").collect()] == [(0, 0.1), (1, 0.0)]


def test_streams_equal_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    events.repartitionByRange(3, "ts").write.parquet(folder)
    for name, make in (("tumbling", windows.tumbling), ("sessions", windows.sessions)):
        query = make(windows.read_events(spark, folder, 3), late="3650 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        tidy = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert tidy(spark.table(name)) == tidy(make(spark.read.parquet(folder)))
