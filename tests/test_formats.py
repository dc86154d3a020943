"""The binary formats against files written here."""

import io
import math
import pickle
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import types as T

from ephyspark import catalog, codecs, get_file_type, read_bci2000, specs
from ephyspark.functions.text import decode_percent, expand_svec, trim_value
from ephyspark.operators.signal import compare, long_view
from ephyspark.sources import encode, nsx, register
from ephyspark.sources.bci import numbers, parse_parameter

from . import writers


@pytest.fixture(autouse=True)
def formats(spark):
    register(spark)


def load(spark, fmt, table, path, **options):
    r = spark.read.format(fmt).option("table", table)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(path))


def signal(spark, path, electrode, **options):
    rows = load(spark, "nsx", "samples", path, **options).where(f"electrode_id = {electrode}").collect()
    return {p: np.concatenate([r.data for r in sorted((x for x in rows if x.partition == p), key=lambda x: x.start_sample)]) for p in {r.partition for r in rows}}


def test_codec_limits():
    f = specs.layout("a uint8; b int32; c int64; d uint16*2; e string(4); f bit; g uint64; h float; i uint32")
    stride = f[-1].offset + 4
    rows = b"".join(struct.pack("<BiqHH4sBQfI", k, v, w, k, 65535, b"a\0xx", k, 2**62, 0.5, 2**32 - 1) for k, v, w in zip(range(256), [2**31 - 1, -(2**31), 0, 1, -1] * 52, [2**63 - 1, -(2**63), 0, -1] * 64, strict=False))
    got = pa.table(dict(zip(*codecs.decode(rows, f, stride), strict=True))).to_pylist()
    assert [r["a"] for r in got] == list(range(256))
    assert [r["b"] for r in got[:5]] == [2**31 - 1, -(2**31), 0, 1, -1]
    assert [r["c"] for r in got[:4]] == [2**63 - 1, -(2**63), 0, -1]
    assert got[3]["d"] == [3, 65535] and got[3]["e"] == "a" and got[5]["f"] == "01 00 01 00 00 00 00 00"
    assert got[0]["g"] == 2**62 and got[0]["h"] == 0.5 and got[0]["i"] == 2**32 - 1


def test_specifications():
    sizes = {(k, v): sum(f.bytes for f in specs.get_specification(v, k).header) for k in ("nsx", "nev") for v in specs.VERSIONS}
    assert set(s for (k, _), s in sizes.items() if k == "nsx") == {314} and set(s for (k, _), s in sizes.items() if k == "nev") == {336}
    assert sum(f.bytes for f in specs.get_specification((3, 0), "nsx").packet) == 13
    assert sum(f.bytes for f in specs.get_specification("2.2", "nsx").packet) == 9
    for bad in ("2.4", "1.0"):
        with pytest.raises(ValueError):
            specs.get_specification(bad, "nev")
    with pytest.raises(ValueError):
        specs.validate_field("x", "uint16", 4)
    with pytest.raises(ValueError):
        specs.validate_field("x", "text", 4)
    with pytest.raises(ValueError):
        specs.file_type(b"NOTAFILE\x02\x03")


def test_one_packet(spark, tmp_path):
    data = np.random.default_rng(0).integers(-30000, 30000, (1000, 3))
    writers.nsx(tmp_path / "a.ns3", packets=[(0, data)])
    h = load(spark, "nsx", "header", tmp_path / "a.ns3").first()
    assert (h.file_type, h.file_spec, h.period, h.channel_count, h.time_origin.Day) == ("NEURALCD", [2, 3], 15, 3, 18)
    c = load(spark, "nsx", "channels", tmp_path / "a.ns3").collect()
    assert [x.electrode_id for x in c] == [1, 2, 3] and c[0].sample_rate_signal == 2000.0
    got = signal(spark, tmp_path / "a.ns3", 2)
    assert np.array_equal(got[1], data[:, 1] * 0.25)


@pytest.mark.parametrize("split", [1, 200_000])
def test_blocks_and_splits(spark, tmp_path, split):
    data = np.random.default_rng(1).integers(-30000, 30000, (40_000, 3))
    writers.nsx(tmp_path / "a.ns5", packets=[(0, data)], period=1)
    df = load(spark, "nsx", "samples", tmp_path / "a.ns5", split_bytes=split)
    rows = df.where("electrode_id = 3").orderBy("start_sample").collect()
    assert [len(r.data) for r in rows] == [16384, 16384, 40_000 - 2 * 16384]
    assert np.array_equal(np.concatenate([r.data for r in rows]), data[:, 2] * 0.25)
    assert df.where("electrode_id IN (1, 2)").select("electrode_id").distinct().count() == 2
    assert load(spark, "nsx", "samples", tmp_path / "a.ns5", channels="1,3").select("electrode_id").distinct().count() == 2


def test_gap(spark, tmp_path):
    n, ns = 100, 1_000_000_000
    data = [np.full((n, 3), k) for k in range(3)]
    writers.nsx(tmp_path / "a.ns3", "3.0", packets=[(0, data[0]), (n * ns // 2000, data[1]), (5 * ns, data[2])], resolution=ns)
    p = load(spark, "nsx", "packets", tmp_path / "a.ns3").orderBy("packet_seq").collect()
    assert [r.partition for r in p] == [1, 1, 2] and [r.n_data_points for r in p] == [n] * 3
    got = signal(spark, tmp_path / "a.ns3", 1)
    assert len(got[1]) == 2 * n and len(got[2]) == n and set(got[2]) == {0.5}


def test_one_sample_packets(spark, tmp_path):
    data = np.arange(500 * 3).reshape(500, 1, 3)
    ns = 1_000_000_000
    writers.nsx(tmp_path / "a.ns3", "3.0", packets=[(k * ns // 2000, d) for k, d in enumerate(data)], resolution=ns)
    assert load(spark, "nsx", "packets", tmp_path / "a.ns3").count() == 500
    got = signal(spark, tmp_path / "a.ns3", 2)
    assert list(got) == [1] and np.array_equal(got[1], data[:, 0, 1] * 0.25)


def pauses(path, n):
    """A file of 1, 2 or 3 samples a packet, each packet a partition; the samples."""
    points = 1 + np.arange(n) % 3
    data = np.random.default_rng(2).integers(-30000, 30000, (int(points.sum()), 2))
    channel = {"min_digital_value": -4, "max_digital_value": 4, "min_analog_value": -1, "max_analog_value": 1, "units": "uV"}
    path.write_bytes(encode.nsx({"period": 15, "time_resolution_timestamp": 1000}, [channel | {"electrode_id": k} for k in (1, 2)], np.arange(n) * 50, points, data))
    return points, data


@pytest.mark.parametrize("n", [2000, 40_000])
def test_plan_does_not_grow_with_packets(tmp_path, n):
    points, data = pauses(tmp_path / "a.ns3", n)
    reader = nsx.NsxReader({"path": str(tmp_path / "a.ns3"), "split_bytes": "1", "true_time": "true"})
    plan = reader.partitions()
    assert len(plan) == -(-2 * n // nsx.BLOCK) and len(pickle.dumps(plan)) < 400 * len(plan)
    got = [pa.Table.from_batches([b]).filter(pc.field("electrode_id") == 2) for s in plan for b in reader.read(s)]
    got = pa.concat_tables(got).sort_by("partition")
    assert got["partition"].to_pylist() == list(range(1, n + 1)) and set(got["start_sample"].to_pylist()) == {0}
    assert pc.list_value_length(got["data"]).to_pylist() == points.tolist()
    assert np.array_equal(pc.list_flatten(got["data"]).to_numpy(), data[:, 1] * 0.25)
    assert np.allclose(got["relative_time"], np.arange(n) * 0.05)


def test_importers_agree_on_many_partitions(spark, tmp_path):
    for k in range(3):
        pauses(tmp_path / f"a{k}.ns3", 500 + k)
    plan = nsx.NsxReader({"path": str(tmp_path), "true_time": "true"}).partitions()
    assert sum(len(pickle.dumps(s)) for s in plan) < 2000
    a = long_view(load(spark, "nsx", "samples", tmp_path, true_time="true"))
    got = compare(a, catalog.samples_by_bytes(spark, str(tmp_path)), ["file_id", "electrode_id", "partition", "sample"]).first()
    assert (got.n_missing, got.max_diff, got.equal) == (0, 0.0, True)


def test_packet_headers_are_read_once(tmp_path, monkeypatch):
    points, _ = pauses(tmp_path / "a.ns3", 3000)
    read = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            read.append(len(data := super().read(n)))
            return data

    file = nsx.read_file(str(tmp_path / "a.ns3"))
    monkeypatch.setattr(nsx, "open_input", Counted)
    assert np.array_equal(nsx.scan_packets(file).points, points)
    assert sum(read) < 2 * file.bytes


def test_clock_of_older_versions(spark, tmp_path):
    data = np.ones((100, 3))
    writers.nsx(tmp_path / "a.ns3", "2.3", packets=[(0, data), (1500, data)])
    p = load(spark, "nsx", "packets", tmp_path / "a.ns3").orderBy("packet_seq").collect()
    assert [r.partition for r in p] == [1, 2] and [r.partition_true for r in p] == [1, 1]
    assert [round(r.t_sec, 9) for r in p] == [0.0, 0.05]
    assert list(signal(spark, tmp_path / "a.ns3", 1)) == [1, 2]
    assert {k: len(v) for k, v in signal(spark, tmp_path / "a.ns3", 1, true_time="true").items()} == {1: 200}


def test_units(spark, tmp_path):
    c = [{"electrode_id": k + 1, "units": u, "min_analog_value": -5, "max_analog_value": 5, "min_digital_value": -1000, "max_digital_value": 1000} for k, u in enumerate(("mV", "V", "uV"))]
    writers.nsx(tmp_path / "a.ns2", "2.2", c, [(0, np.full((10, 3), 100))])
    assert load(spark, "nsx", "header", tmp_path / "a.ns2").first().comment == "test"
    for k, scale in ((1, 1e3), (2, 1e6), (3, 1)):
        assert signal(spark, tmp_path / "a.ns2", k)[1][0] == pytest.approx(0.5 * scale)


def test_damaged_files(spark, tmp_path):
    data = np.ones((50, 3))
    writers.nsx(tmp_path / "cut.ns3", packets=[(0, data), (750, data)], cut=60)
    with pytest.raises(Exception, match="cut"):
        load(spark, "nsx", "samples", tmp_path / "cut.ns3").count()
    assert sum(len(v) for v in signal(spark, tmp_path / "cut.ns3", 1, tolerate_truncation="true").values()) == 90
    writers.nsx(tmp_path / "bad.ns3", packets=[(0, data)], tail=b"\x07" + b"\1" * 40)
    assert load(spark, "nsx", "packets", tmp_path / "bad.ns3").count() == 1
    writers.nsx(tmp_path / "zero.ns3", packets=[(0, np.zeros((0, 3)))])
    assert load(spark, "nsx", "samples", tmp_path / "zero.ns3").count() == 0
    with pytest.raises(Exception, match="no signal file"):
        load(spark, "nsx", "packets", tmp_path / "none*.ns3").count()


EXTENDED = [("NEUEVWAV", {"electrode_id": 1, "digitization_factor": 250, "bytes_per_waveform": 2}), ("NEUEVWAV", {"electrode_id": 1, "digitization_factor": 999, "bytes_per_waveform": 1}), ("NEUEVWAV", {"electrode_id": 2, "digitization_factor": 1000, "bytes_per_waveform": 1}), ("NEUEVWAV", {"electrode_id": 3, "digitization_factor": 1000, "bytes_per_waveform": 4}), ("NEUEVWAV", {"electrode_id": 4, "digitization_factor": 1000, "bytes_per_waveform": 3}), ("NEUEVWAV", {"electrode_id": 5, "digitization_factor": 1000}), ("NEUEVLBL", {"electrode_id": 1, "label": "ch1"}), ("NEUEVLBL", {"electrode_id": 9, "label": "x"})]


@pytest.mark.parametrize("version", specs.VERSIONS)
def test_events(spark, tmp_path, version):
    spec = specs.get_specification(version, "nev")
    packets = [(e.event, e.low, {"timestamp": 683033}) for e in spec.events] + [b"\xff" * 4 + struct.pack("<H", 40000) * 10]
    packets.append(("comment", 65535, {"timestamp": 753242, "data": 255, "tail": b"a comment that goes on to the end of its packet"}))
    writers.nev(tmp_path / "a.nev", version, EXTENDED, packets, resolution=30000)
    for e in spec.events:
        rows = load(spark, "nev", f"event:{e.event}", tmp_path / "a.nev").orderBy("packet_seq").collect()
        assert len(rows) == (2 if e.event == "comment" else 1), e.event
        if e.event == "spike":
            continue
        assert rows[0].time_in_seconds == pytest.approx(22.767766666) and rows[0].event == e.event and rows[0].packet_id == e.low
        assert "reserved" not in rows[0].asDict()
    comment = load(spark, "nev", "event:comment", tmp_path / "a.nev").orderBy("packet_seq").collect()[1]
    assert comment.comment.startswith("a comment that goes on") and comment.comment.endswith("packet") and comment.data == 255
    assert comment.time_in_seconds == pytest.approx(25.108066666)
    assert load(spark, "nev", "event:comment", tmp_path / "a.nev", exclude_events="Comment").count() == 0
    tracking = load(spark, "nev", "event:tracking", tmp_path / "a.nev").first()
    assert len(tracking.tracking_point) == (9 if version == "3.0" else 7)
    assert load(spark, "nev", "ext:NEUEVLBL", tmp_path / "a.nev").count() == 2
    assert load(spark, "nev", "header", tmp_path / "a.nev").first().number_of_extended_headers == len(EXTENDED)


def test_low_resolution(spark, tmp_path):
    writers.nev(tmp_path / "a.nev", "3.0", packets=[("recording", 65529, {"timestamp": 60000})], resolution=1000)
    assert load(spark, "nev", "event:recording", tmp_path / "a.nev").first().time_in_seconds == 2.0


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_spikes(spark, tmp_path, split):
    wave = np.array([100, -200, 300, -400], dtype="<i2").tobytes()
    bytes_ = np.array([1, -2, 3, -4, 5, -6, 7, -8], dtype="i1").tobytes()
    floats = np.array([1.5, -2.5], dtype="<f4").tobytes()
    packets = [("spike", 1, {"timestamp": 30000, "unit_classification_number": 2, "waveform": wave}), ("spike", 2, {"waveform": bytes_}), ("spike", 3, {"waveform": floats}), ("spike", 4, {"waveform": wave}), ("spike", 7, {"waveform": wave}), ("spike", 5, {"waveform": bytes_})]
    writers.nev(tmp_path / "a.nev", "2.3", EXTENDED, packets)
    got = {r.channel_id: r for r in load(spark, "nev", "spike", tmp_path / "a.nev", split_bytes=split).collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert got[1].waveform == [25.0, -50.0, 75.0, -100.0] and got[1].time_in_seconds == 1.0 and got[1].classification == 2
    assert got[2].waveform == [1.0, -2.0, 3.0, -4.0, 5.0, -6.0, 7.0, -8.0] == got[5].waveform
    assert got[3].waveform == [1.5, -2.5]
    assert len(load(spark, "nev", "spike", tmp_path / "a.nev", full_waveform="true").where("channel_id = 1").first().waveform) == 48
    writers.nev(tmp_path / "b.nev", "2.3", EXTENDED, packets, flags=1)
    assert {r.channel_id: len(r.waveform) for r in load(spark, "nev", "spike", tmp_path / "b.nev").collect()} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 4}
    writers.nev(tmp_path / "c.nev", "2.3")
    assert load(spark, "nev", "spike", tmp_path / "c.nev").count() == 0


STATES = [("Running", 1, 0, 0, 3), ("Code", 8, 0, 0, 4), ("Time", 16, 0, 2, 0), ("Long", 32, 0, 4, 0), ("Five", 5, 0, 1, 6)]
PARAMETERS = ["Source:Signal%20Properties int SamplingRate= 256 250 1 % // rate", "Source intlist List= 3 1 2 0 0 9 // padded", "Source floatlist Gains= 2 0.5 1.5 1 % % // gains", "App string Name= a%20b%%c // text", "App matrix M= 2 { a b } 1 2 // stays text", "App float One= 5 // short", "no parameter here"]


@pytest.mark.parametrize(("fmt", "version"), [("int16", "1.1"), ("int32", "1.1"), ("float32", "1.1"), ("int16", "1.0")])
def test_bci(spark, tmp_path, fmt, version):
    x, s = writers.bci(tmp_path / "a.dat", fmt, version, states=STATES, parameters=PARAMETERS)
    got = load(spark, "bci2000", "signals", tmp_path / "a.dat", split_bytes=64).orderBy("channel", "sample").collect()
    assert np.allclose(np.array([r.value for r in got]).reshape(2, 50), x.T)
    wide = s.astype(np.int64)
    want = {"Running": wide[:, 0] >> 3, "Code": (wide[:, 0] >> 4) + (wide[:, 1] << 4) & 255, "Time": wide[:, 2] + (wide[:, 3] << 8), "Long": sum(wide[:, 4 + k] << 8 * k for k in range(4)), "Five": (wide[:, 1] >> 6) + (wide[:, 2] << 2) & 255}
    rows = load(spark, "bci2000", "states", tmp_path / "a.dat", split_bytes=64).orderBy("sample").collect()
    for name, values in want.items():
        assert [r.value for r in rows if r.state == name] == values.tolist()
    masked = load(spark, "bci2000", "states", tmp_path / "a.dat", mask_states="true").where("state = 'Running'").orderBy("sample").collect()
    assert [r.value for r in masked] == (wide[:, 0] >> 3 & 1).tolist()
    assert load(spark, "bci2000", "state_defs", tmp_path / "a.dat").count() == len(STATES)
    p = {r.name: r for r in load(spark, "bci2000", "parameters", tmp_path / "a.dat").collect()}
    assert len(p) == 6
    assert p["SamplingRate"].section == ["Source", "Signal Properties"] and (p["SamplingRate"].value, p["SamplingRate"].default, p["SamplingRate"].lower_bound) == (256, 250, 1)
    assert p["List"]["values"] == [1, 2, 0] and p["Gains"]["values"] == [0.5, 1.5]
    assert p["Name"].value_text == "a b%c" and p["M"].value_text.startswith("2 {") and p["One"].value == 5


def test_text_of_parameters():
    assert decode_percent("a%20b") == "a b" and decode_percent("100%%") == "100%" and decode_percent("a%00b", "NA") == "aNAb"
    assert decode_percent("a%20") == "a" and decode_percent("a%20", compat=False) == "a " and decode_percent("a%2zb", "?") == "a?zb"
    assert decode_percent("%", "?") == "?" and decode_percent("%2%41x", "?") == "?Ax" and decode_percent(None) is None
    assert trim_value(" 5 ") == "5" and trim_value("5", True) == "" and trim_value("1 ", True) == "" and trim_value("12 ", True) == "12" and trim_value("") == ""
    assert numbers("1 -2.5 NA .5") == [1.0, -2.5, None, 0.5] and numbers("-") == []
    assert parse_parameter("broken") is None
    assert expand_svec("1-3,5,x,9:7,2") == [1, 2, 3, 5, 9, 8, 7]
    assert math.isclose(sum(numbers("1e3 2")), 1002)


def test_bci_tables(spark, tmp_path):
    own = ["Source floatlist SourceChGain= 2 0.5 2 1 % %", "Source floatlist SourceChOffset= 2 10 0 0 % %", *PARAMETERS]
    x, _ = writers.bci(tmp_path / "a.dat", states=STATES, parameters=own)
    r = read_bci2000(spark, str(tmp_path / "a.dat"))
    assert r.header.tree()["Source"]["Signal Properties"]["SamplingRate"]["value"] == 256
    assert "int16" in r.header.describe() and "8 parameters" in r.header.describe()
    got = r.calibrated().orderBy("channel", "sample").collect()
    want = (x.astype(float).T - np.array([[10], [0]])) * np.array([[0.5], [2]])
    assert np.allclose(np.array([v.value for v in got]).reshape(2, 50), want)
    with pytest.raises(ValueError):
        read_bci2000(spark, str(tmp_path / "a.dat"), speed=1)


def test_file_types(tmp_path):
    writers.nsx(tmp_path / "a.ns3", "3.0")
    writers.nev(tmp_path / "a.nev", "2.2")
    assert get_file_type(str(tmp_path / "a.ns3")) == ("nsx", "3.0") and get_file_type(str(tmp_path / "a.nev")) == ("nev", "2.2")


def test_added_codec():
    codecs.register_codec("uint16be", lambda raw: pa.array([int.from_bytes(bytes(v), "big") for v in raw]), T.LongType())
    f = (specs.FieldSpec("x", "uint16be", 2),)
    assert codecs.decode(b"\x01\x02\x00\x03", f, 2)[1][0].to_pylist() == [258, 3]
    del codecs.CODECS["uint16be"]
