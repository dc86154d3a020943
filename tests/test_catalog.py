"""Import to the catalog and lookups, end to end."""

import os

import numpy as np
import pytest

from ephyspark import catalog
from ephyspark.functions import text as T
from ephyspark.operators import signal as S
from ephyspark.operators import tables as U

from . import writers
from .test_formats import EXTENDED


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rec")
    r = np.random.default_rng(4)
    data = [r.integers(-30000, 30000, (900, 3)) for _ in range(2)]
    ns = 1_000_000_000
    writers.nsx(folder / "day1.ns3", "3.0", packets=[(0, data[0]), (9 * ns, data[1])], resolution=ns)
    writers.nsx(folder / "day1.ns2", "3.0", packets=[(0, data[1])], resolution=ns)
    spikes = [("spike", 1, {"timestamp": 30000 * k, "waveform": np.array([k, -k] * 2, dtype="<i2").tobytes()}) for k in range(1, 4)]
    comments = [("comment", 65535, {"timestamp": 683033, "data": 255, "tail": b"hello"})]
    writers.nev(folder / "day1.nev", "2.3", EXTENDED, spikes + comments)
    prefix = str(folder / "catalog")
    found = catalog.import_nsp(spark, str(folder / "day1.ns3"), prefix, exclude_events=())
    return folder, prefix, data, found


def test_collection(spark, recording):
    _, prefix, _, found = recording
    assert sorted(found.nsx) == ["ns2", "ns3"] and "event_comment" in found.nev and "day1" not in found.describe()
    assert catalog.get_nsx(spark, prefix, "ns3").first().channel_count == 3
    assert catalog.get_nsx(spark, prefix, 7) is None
    assert catalog.get_event(spark, prefix, "Comment").first().comment == "hello"
    assert catalog.get_event(spark, prefix, "log") is None
    assert catalog.get_event(spark, prefix, "spike").count() == 3
    assert catalog.spike_waveforms(spark, prefix).first().waveform is not None
    assert [r.label for r in catalog.electrode_labels(spark, prefix).collect()] == ["ch1"]
    assert {"signals", "channels", "partition_info", "nev_scans", "nsx_scans"} <= set(catalog.load_all(spark, prefix))
    scan = spark.read.parquet(f"{prefix}/nev_scans").first()
    assert scan.acq_time == "2023-0718T09:05:07.042" and scan.file_spec == "2.3"
    with pytest.raises(ValueError):
        catalog.get_nsx(spark, prefix, 12)
    with pytest.raises(FileNotFoundError):
        catalog.get_nsp(spark, prefix + "none")
    with pytest.raises(FileNotFoundError):
        catalog.import_nsp(spark, prefix + "none.nev", prefix)


def test_partitions(spark, recording):
    _, prefix, _, _ = recording
    p = spark.read.parquet(f"{prefix}/partition_info").where("which_nsx = 3").orderBy("partition").collect()
    assert [(r.relative_time, round(r.duration, 9), r.sample_rate, r.n_samples) for r in p] == [(0.0, 0.45, 2000.0, 900), (9.0, 0.45, 2000.0, 900)]


def test_channel(spark, recording):
    _, prefix, data, _ = recording
    c = catalog.get_channel(spark, prefix, 2)
    assert c.info.first().which_nsp == 3 and "2000 Hz" in c.describe()
    assert catalog.load_table(spark, f"{prefix}/partition_info", ram=True).num_rows == 3
    assert {r.partition: r.n_samples for r in c.dims().collect()} == {1: 900, 2: 900}
    got = c.samples().where("partition = 2").orderBy("sample").collect()
    assert np.array_equal([r.value for r in got], data[1][:, 1] * 0.25) and got[3].time == pytest.approx(9 + 3 / 2000)
    assert [r.value for r in c.slice(1, 5, 8).orderBy("sample").collect()] == (data[0][5:9, 1] * 0.25).tolist()
    assert catalog.get_channel(spark, prefix, 77) is None
    plan = c.blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "electrode_id" in plan.split("PartitionFilters")[1][:200]
    want = spark.sql("SELECT * FROM VALUES (0, 4L), (1, 5000L), (2, 4L) AS t(`order`, sample)")
    rows = S.subset(c.samples().where("partition = 1").select("sample", "value"), want).collect()
    assert [r.value for r in rows] == [data[0][4, 1] * 0.25, None, data[0][4, 1] * 0.25]


def test_import_again_replaces(spark, recording):
    folder, prefix, data, _ = recording
    catalog.import_nsp(spark, str(folder / "day1"), prefix, exclude_events="spike", exclude_nsx="2")
    assert spark.read.parquet(f"{prefix}/event_comment").count() == 1
    assert spark.read.parquet(f"{prefix}/partition_info").count() == 3
    assert spark.read.parquet(f"{prefix}/signals").where("which_nsx = 3 AND electrode_id = 1").selectExpr("sum(size(data))").first()[0] == 1800


def test_compare(spark, recording):
    _, prefix, _, _ = recording
    a = catalog.get_channel(spark, prefix, 1).samples().select("partition", "sample", "value")
    assert S.compare(a, a, ["partition", "sample"]).first().equal
    b = a.selectExpr("partition", "sample", "value + 0.001 AS value")
    assert not S.compare(a, b, ["partition", "sample"]).first().equal
    assert S.compare(a, a.where("sample > 0"), ["partition", "sample"]).first().n_missing == 2


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "f string, x int")
    U.upsert_parquet(spark, path, rows(("a", 1), ("b", 2), (None, 3)), "f", ["a"])
    U.upsert_parquet(spark, path, spark.createDataFrame([("a", 9, "n")], "f string, x int, note string"), "f", ["a"], tsv=True, keep_backup=True)
    got = {(r.f, r.x, r.note) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 9, "n"), ("b", 2, None), (None, 3, None)}
    assert spark.read.option("sep", "\t").option("header", True).csv(path + ".tsv").count() == 3
    assert any("backup_" in p.name for p in tmp_path.iterdir())
    U.upsert_parquet(spark, path, rows().limit(0), "f", ["a"])
    assert spark.read.parquet(path).count() == 3
    assert U.append_table(None, rows(("a", 1))).count() == 1
    assert U.backup_name("/d/x_[backup_20200101_000000].rds", 0).count("backup_") == 1


def test_index_text(spark):
    df = spark.createDataFrame([("1-3,5, 9:7 ,x,2",), ("",), (None,), ("4|6,10-",)], "t string")
    assert [r.a for r in df.select(T.parse_svec(df.t).alias("a")).collect()] == [[1, 2, 3, 5, 9, 8, 7], [], None, [4, 5, 6]]
    assert df.select(T.parse_svec(df.t, sort=True, unique=False).alias("a")).first().a == [1, 2, 2, 3, 5, 7, 8, 9]
    n = spark.createDataFrame([([5, 1, 2, 3, 9, 3, None],), ([],), ([4],)], "n array<bigint>")
    assert [r.s for r in n.select(T.deparse_svec(n.n).alias("s")).collect()] == ["1-3,5,9", "", "4"]
    assert n.select(T.deparse_svec(n.n, max_lag=4).alias("s")).first().s == "1-9"


def test_two_recordings_in_one_prefix(spark, tmp_path):
    """Importing a second recording leaves the first one's signals alone; progress names every table."""
    x = np.arange(40, dtype=np.int16).reshape(20, 2)
    channels = [{"electrode_id": k + 1, "electrode_label": f"c{k}"} for k in range(2)]
    for name, factor in (("one", 1), ("two", 3)):
        writers.nsx(tmp_path / f"{name}.ns5", channels=channels, packets=[(0, factor * x)], period=1)
    prefix, told = str(tmp_path / "catalog"), []
    for name in ("one", "two", "one"):
        catalog.import_nsp(spark, str(tmp_path / f"{name}.ns5"), prefix, progress=told.append)
    got = {r.file_id: r.n for r in spark.read.parquet(f"{prefix}/signals").selectExpr("file_id", "size(data) AS n").groupBy("file_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {"one.ns5": 40, "two.ns5": 40}
    assert spark.read.parquet(f"{prefix}/packets").count() == 2
    assert told.count("one.ns5") == 2 and "two.ns5: packets" in told


def test_broken_off_upsert_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    U.upsert_parquet(spark, path, spark.range(3))
    os.rename(path, path + U._OLD)
    assert U.read_table(spark, path).count() == 3 and not os.path.exists(path + U._OLD)
    U.upsert_parquet(spark, path, spark.range(3, 5), "id", spark.range(2))
    assert sorted(r.id for r in U.read_table(spark, path).collect()) == [2, 3, 4]
    assert sorted(os.listdir(tmp_path)) == ["t"]


def test_first_match(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w")], "k string, n int, v string")
    assert sorted(r.v for r in U.first_match(rows, ["k"], "n").collect()) == ["y", "z"]
    assert sorted(r.v for r in U.first_match(rows, ["k"], "n", last=True).collect()) == ["w", "x"]


def test_descriptions(spark, tmp_path):
    from ephyspark.describe import describe
    from ephyspark.operators.arrays import ArrayStore
    from ephyspark.specs import get_specification

    x = np.arange(40, dtype=np.int16).reshape(20, 2)
    writers.nsx(tmp_path / "d.ns5", packets=[(0, x)], period=1, channels=[{"electrode_id": k + 1, "electrode_label": f"c{k}"} for k in range(2)])
    writers.nev(tmp_path / "d.nev", extended=EXTENDED, packets=[("digital_inputs", 0, {"timestamp": 30 * k}) for k in range(7)])
    prefix = str(tmp_path / "catalog")
    found = catalog.import_nsp(spark, str(tmp_path / "d.nev"), prefix)
    tables = catalog.load_all(spark, prefix)
    assert "signals: ns5" in describe(found) and describe(catalog.get_channel(spark, prefix, 2)).startswith("<channel 2 c1>")
    for table, text in {"nsx_header": "signal file header: 1", "nev_header": "event file header: 1", "channel_info": "channels: 2", "channels": "channels: 2", "event_digital_inputs": "and 2 more", "packets": "20 samples at 0.0000 s", "partition_info": "partitions: 1", "ext_NEUEVLBL": "header records", "signals": "table: 2"}.items():
        assert text in describe(tables[table]), table
    s = get_specification("2.3", "nev")
    assert "event spike (1 to 2048)" in describe(s) and describe(s.header[0]) == "<field file_type: string, 8 bytes at 0>" and "waveform" in describe(s.events[1])
    assert "packet: header, timestamp" in describe(get_specification("3.0", "nsx"))
    store = ArrayStore(spark, str(tmp_path / "array"))
    assert describe(store).startswith("<no array>") and describe(store.allocate([2, 3])).startswith("<array 2 x 3>")
    writers.bci(tmp_path / "r.dat", states=[("Stim", 8, 0, 0, 0)])
    from ephyspark.bci2000 import read_bci2000

    r = read_bci2000(spark, str(tmp_path / "r.dat"))
    assert "2 channels, 50 samples; states: Stim" in describe(r) and "BCI2000 header" in describe(r.header)
    with pytest.raises(TypeError):
        describe(3)
