"""Queries over the driver's tables that exercise the engine's operators, each with its DuckDB equivalent.

`events` stands for a recording: user_id is the channel, ts the sample time, value the digital value and event_type the kind
of event. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import signal as S
from ..operators import tables as U

#: Channel settings by event type: name, units, digital and analog bounds.
_CHANNELS = "('click','uV',-32764,32764,-8191,8191),('error','mV',-1000,1000,-5,5),('purchase','V',-32768,32767,-1,1),('signup','uV',0,255,0,100),('view','mV',-100,300,-2,8)"
_CHANNEL_COLUMNS = "event_type, units, min_digital_value, max_digital_value, min_analog_value, max_analog_value"
_RANGES = [(1, 10, "spike"), (11, 20, "stimulation"), (30, 30, "comment"), (41, 50, "log")]
#: Packets of `events` end when they start; a pause is more than an hour.
PAUSE = 3600.0


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _channels(spark: SparkSession) -> DataFrame:
    return S.slope_intercept(spark.sql(f"SELECT * FROM VALUES {_CHANNELS} AS t({_CHANNEL_COLUMNS})"))


_SLOPES = f"""
  SELECT event_type, (hi - lo) / (dh - dl) AS slope, ((hi + lo) - (hi - lo) / (dh - dl) * (dh + dl)) / 2 AS intercept
  FROM (
    SELECT event_type, min_analog_value * s AS lo, max_analog_value * s AS hi, CAST(min_digital_value AS DOUBLE) AS dl, CAST(max_digital_value AS DOUBLE) AS dh
    FROM (
      SELECT *, CASE units WHEN 'V' THEN 1e6::DOUBLE WHEN 'mV' THEN 1e3::DOUBLE ELSE 1.0::DOUBLE END AS s
      FROM (VALUES {_CHANNELS}) AS t({_CHANNEL_COLUMNS})
    ) AS scaled
  ) AS bounds
"""


def _micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def calibrate_affine(spark, sf_dir):
    e = S.calibrate(_read(spark, sf_dir, "events"), _channels(spark), "event_type")
    return e.select("event_id", "event_type", F.round("calibrated", 6).alias("calibrated"))


def unit_normalization(spark, sf_dir):
    """Range in microvolts that each event type can show, and its label after normalization."""
    c = _channels(spark).select("event_type", "units", "slope", "intercept")
    e = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.join(c, "event_type").select("event_type", "n", "units", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


def _partitioned(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("t", _micros("ts"))
    return S.partition_at_pauses(e, ["user_id"], ["t", "event_id"], F.col("t"), F.col("t"), F.lit(PAUSE * 1e6))


_PARTITIONED = """
  SELECT *, CAST(1 + sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS "partition"
  FROM (
    SELECT *, CASE WHEN abs(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) > 3600000000 THEN 1 ELSE 0 END AS brk
    FROM (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events) AS e
  ) AS b
"""


def gap_partition(spark, sf_dir):
    return _partitioned(spark, sf_dir).select("event_id", "user_id", "partition")


def sample_islands(spark, sf_dir):
    """Runs of events whose minutes, counted from a user's first event and rounded, step by two hundred at most."""
    e = _read(spark, sf_dir, "events").withColumn("t", _micros("ts") / F.lit(6e7))
    return S.sample_islands(e, ["user_id"], "t", 1.0, 200).select("event_id", "user_id", "island")


def partition_summary(spark, sf_dir):
    p = S.summarise_partitions(_partitioned(spark, sf_dir), ["user_id", "partition"], F.col("t"), F.col("t"), F.lit(1))
    return p.withColumn("duration", (F.col("end_time") - F.col("start_time")) / F.lit(1e6))


def packet_offsets(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 2 + 9).alias("length"))
    return S.packet_offsets(d, "doc_id", F.col("length"))


def write_offsets(spark, sf_dir):
    """Where each line's samples begin inside its order."""
    l = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("n"))
    return S.packet_offsets(l.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n")), "l_linenumber", F.col("n"), ["l_orderkey"], "write_offset")


def chunk_plan(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.chunk_plan(d, "n_chars", 1000).select("doc_id", "chunk_start", "chunk_size")


def islands_to_ranges(spark, sf_dir):
    """Maximal runs of consecutive part keys that each supplier has sold, as first and last key."""
    k = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = S.partition_at_pauses(k, ["l_suppkey"], ["l_partkey"], F.col("l_partkey"), F.col("l_partkey"), F.lit(1), "island")
    return p.groupBy("l_suppkey", "island").agg(F.min("l_partkey").alias("first_key"), F.max("l_partkey").alias("last_key"))


def deparse_svec(spark, sf_dir):
    """Line numbers of each order as index text."""
    l = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("n"))
    return l.select("l_orderkey", T.deparse_svec(F.col("n")).alias("index_text"))


def svec_expand(spark, sf_dir):
    text = F.concat_ws(",", F.format_string("%d-%d", F.col("p_size"), F.col("p_size") + 3), F.lit("x"), F.lit(" 7 "), F.format_string("%d:%d", F.col("p_size") + 1, F.col("p_size") - 1))
    p = _read(spark, sf_dir, "part").select("p_partkey", T.parse_svec(text).alias("idx"))
    return p.select("p_partkey", F.explode("idx").alias("idx"))


def upsert_replace(spark, sf_dir):
    """Units of all orders, replaced by what their lines add up to; orders without lines keep their row."""
    old = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).cast("bigint").alias("n_units"), "o_orderstatus")
    new = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n_units"))
    return U.append_table(old, new, "o_orderkey", new)


def union_by_name_fill(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return U.union_by_name(c, s)


def pad_array(spark, sf_dir):
    """Whole vectors, padded with zeros to four components more than the longest of 64."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.posexplode(S.pad(F.col("x"), F.lit(68), F.lit(0.0))).alias("pos", "x"))


def pad_to_longest(spark, sf_dir):
    """Character codes of part types, padded with zeros to the longest type."""
    p = _read(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_type", ""), lambda c: F.ascii(c).cast("double")).alias("x"))
    return S.pad_to_longest(p, "x").select("p_partkey", F.size("x").cast("bigint").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


def time_origin_text(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.time_origin_text(F.col("o_orderdate")).alias("acq_time"))


def bit_flags(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.bit_flags(F.col("p_size")).alias("flags"))


def channel_filename(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", T.channel_filename(F.col("s_suppkey"), F.col("s_name")).alias("own"), T.channel_filename(F.col("s_nationkey"), F.col("s_name")).alias("other"))


def event_exclude(spark, sf_dir):
    return U.exclude(_read(spark, sf_dir, "events"), "event_type", ["ERROR", "view"]).select("event_id", "event_type")


def id_dispatch(spark, sf_dir):
    return U.dispatch(_read(spark, sf_dir, "part"), "p_size", _RANGES).select("p_partkey", "p_size", "event")


def preferred_source(spark, sf_dir):
    """For each part the supplier with the highest number, as a channel is taken from the highest file."""
    l = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return U.first_match(l, ["l_partkey"], "l_suppkey", last=True)


def first_match_lookup(spark, sf_dir):
    """Customers with the first order of each; customers without one are dropped."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return U.lookup(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey", "o_custkey", "o_orderkey").drop("o_custkey")


def label_semi(spark, sf_dir):
    return _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def key_difference(spark, sf_dir):
    """Customers none of whose orders is pending."""
    pending = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return _read(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def index_subset_na(spark, sf_dir):
    want = spark.sql("SELECT * FROM VALUES (0, 3), (1, 99), (2, 3), (3, 0), (4, -1), (5, 24) AS t(`order`, sample)")
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_name").alias("value"))
    return S.subset(n, want).select("order", "sample", "value")


def max_length_agg(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.max(F.length("text")).cast("bigint").alias("max_length"), F.count("*").alias("n"))


def vector_explode(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))


def json_meta(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def meta_round_trip(spark, sf_dir):
    """A row of the nation table as JSON metadata, read back."""
    n = U.meta_json(_read(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])
    return n.select("n_nationkey", F.get_json_object("meta", "$.n_name").alias("name"), F.get_json_object("meta", "$.n_nationkey").cast("int").alias("key"))


def percent_decode(spark, sf_dir):
    """Addresses as they are, and with every reserved character and some odd escapes written as percent codes."""
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", T.percent_decode(u, compat=False).alias("url"), T.percent_decode(F.concat(F.url_encode(u), F.lit("%25%%x%zz%c3%A9")), compat=False).alias("decoded"))


def tolerance_diff(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    a = S.calibrate(e, _channels(spark), "event_type").select("event_id", F.col("calibrated").alias("value"))
    b = U.exclude(S.calibrate(e, _channels(spark), "event_type"), "event_type", ["signup"]).select("event_id", (F.col("calibrated") + F.lit(0.0)).alias("value"))
    return S.compare(a, b, ["event_id"])


def rate_time(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    version = F.when(F.col("event_type") == "view", "3.0").otherwise("2.3")
    r = F.when(F.col("event_type").isin("view", "click"), 1000).otherwise(30000)
    return e.select("event_id", F.round(S.event_seconds(_micros("ts"), r, version), 3).alias("time_in_seconds"), S.sample_rate(F.col("user_id") + 1).alias("sample_rate"))


def little_endian(spark, sf_dir):
    """Numbers of two and four bytes that the first five bytes of a name hold."""
    name = F.col("p_name").cast("binary")
    return _read(spark, sf_dir, "part").select("p_partkey", T.unsigned(name, 1, 2).alias("u16"), T.unsigned(name, 2, 4).alias("u32"))


def pattern_matches(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.str_match(F.col("p_type"), "[A-Z][A-Z]"), "|").alias("found"))


def file_suffix(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", T.file_extension(F.col("url")).alias("extension"), T.strip_recording_suffix(F.concat(F.lit("r"), F.col("page_id").cast("string"), F.lit(".NS3"))).alias("prefix"))


def name_list(spark, sf_dir):
    """Distinct nation names of each region as one text."""
    n = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("names"))
    return _read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "names")


_ALL = [calibrate_affine, unit_normalization, gap_partition, sample_islands, partition_summary, packet_offsets, write_offsets, chunk_plan, islands_to_ranges, deparse_svec, svec_expand, upsert_replace, union_by_name_fill, pad_array, pad_to_longest, time_origin_text, bit_flags, channel_filename, event_exclude, id_dispatch, preferred_source, first_match_lookup, label_semi, key_difference, index_subset_na, max_length_agg, vector_explode, json_meta, meta_round_trip, percent_decode, tolerance_diff, rate_time, little_endian, pattern_matches, file_suffix, name_list]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_SQL = {
    "calibrate_affine": f"SELECT event_id, event_type, round(value * slope + intercept, 6) AS calibrated FROM events JOIN ({_SLOPES}) AS c USING (event_type)",
    "unit_normalization": f"SELECT event_type, n, 'uV' AS units, round(slope, 9) AS slope, round(intercept, 9) AS intercept FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) AS e JOIN ({_SLOPES}) AS c USING (event_type)",
    "gap_partition": f'SELECT event_id, user_id, "partition" FROM ({_PARTITIONED}) AS p',
    "sample_islands": "SELECT event_id, user_id, CAST(1 + sum(brk) OVER (PARTITION BY user_id ORDER BY k RANGE UNBOUNDED PRECEDING) AS INTEGER) AS island FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY user_id ORDER BY k) > 200 THEN 1 ELSE 0 END AS brk FROM (SELECT event_id, user_id, round_even(epoch_us(ts) / 6e7::DOUBLE - min(epoch_us(ts) / 6e7::DOUBLE) OVER (PARTITION BY user_id), 0) AS k FROM events) AS r) AS b",
    "partition_summary": f'SELECT user_id, "partition", count(*) AS n_packets, count(*) AS n_samples, min(t) AS start_time, max(t) AS end_time, (max(t) - min(t)) / 1e6::DOUBLE AS duration FROM ({_PARTITIONED}) AS p GROUP BY user_id, "partition"',
    "packet_offsets": "SELECT doc_id, n_chars * 2 + 9 AS length, CAST(sum(n_chars * 2 + 9) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (n_chars * 2 + 9) AS BIGINT) AS byte_offset FROM documents",
    "write_offsets": "SELECT l_orderkey, l_linenumber, n, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS write_offset FROM (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l",
    "chunk_plan": "SELECT doc_id, chunk_start, least(1000, n_chars - chunk_start) AS chunk_size FROM (SELECT doc_id, n_chars, unnest(generate_series(0::BIGINT, n_chars - 1, 1000::BIGINT)) AS chunk_start FROM documents WHERE n_chars > 0) AS c",
    "islands_to_ranges": "SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_partkey)) AS INTEGER) AS island, min(l_partkey) AS first_key, max(l_partkey) AS last_key FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) AS d) AS r GROUP BY l_suppkey, k",
    "deparse_svec": "SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS index_text FROM (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) AS d) AS r GROUP BY l_orderkey, k) AS i GROUP BY l_orderkey",
    "svec_expand": "SELECT p_partkey, unnest(generate_series(p_size::BIGINT, p_size::BIGINT + 3)) AS idx FROM part UNION SELECT p_partkey, 7::BIGINT FROM part UNION SELECT p_partkey, unnest(generate_series(p_size::BIGINT - 1, p_size::BIGINT + 1)) FROM part WHERE p_size > 0 UNION SELECT p_partkey, 1::BIGINT FROM part WHERE p_size = 0",
    "upsert_replace": "SELECT l_orderkey AS o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS n_units FROM lineitem GROUP BY l_orderkey UNION ALL SELECT o_orderkey, 0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "union_by_name_fill": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier",
    "pad_array": "SELECT vec_id, CAST(unnest(range(68)) AS INTEGER) AS pos, unnest(list_resize(CAST(embedding AS DOUBLE[]), 68, 0::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL",
    "pad_to_longest": "SELECT p_partkey, (SELECT max(length(p_type)) FROM part) AS n, CAST(list_sum(list_transform(string_split(p_type, ''), lambda c: ascii(c))) AS DOUBLE) AS total FROM part",
    "time_origin_text": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m%dT%H:%M:%S.%g') AS acq_time FROM orders",
    "bit_flags": "SELECT p_partkey, '0' || (p_size & 1) || ' 0' || ((p_size >> 1) & 1) || ' 0' || ((p_size >> 2) & 1) || ' 0' || ((p_size >> 3) & 1) || ' 0' || ((p_size >> 4) & 1) || ' 0' || ((p_size >> 5) & 1) || ' 0' || ((p_size >> 6) & 1) || ' 0' || ((p_size >> 7) & 1) AS flags FROM part",
    "channel_filename": "SELECT s_suppkey, CASE WHEN suffix(s_name, CAST(s_suppkey AS VARCHAR)) THEN s_name ELSE printf('%s-%03d', s_name, s_suppkey) END || '.h5' AS own, CASE WHEN suffix(s_name, CAST(s_nationkey AS VARCHAR)) THEN s_name ELSE printf('%s-%03d', s_name, s_nationkey) END || '.h5' AS other FROM supplier",
    "event_exclude": "SELECT event_id, event_type FROM events WHERE lower(event_type) NOT IN ('error', 'view')",
    "id_dispatch": "SELECT p_partkey, p_size, event FROM part JOIN (VALUES (1, 10, 'spike'), (11, 20, 'stimulation'), (30, 30, 'comment'), (41, 50, 'log')) AS r(lo, hi, event) ON p_size BETWEEN lo AND hi",
    "preferred_source": "SELECT l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey",
    "first_match_lookup": "SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) AS o ON c_custkey = o_custkey AND r = 1",
    "label_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "key_difference": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "index_subset_na": 'SELECT "order", sample, n_name AS value FROM (VALUES (0, 3), (1, 99), (2, 3), (3, 0), (4, -1), (5, 24)) AS t("order", sample) LEFT JOIN nation ON n_nationkey = sample',
    "max_length_agg": "SELECT lang, CAST(max(length(text)) AS BIGINT) AS max_length, count(*) AS n FROM documents GROUP BY lang",
    "vector_explode": "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings",
    "json_meta": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "meta_round_trip": "SELECT n_nationkey, n_name AS name, n_nationkey AS key FROM nation",
    "percent_decode": "SELECT page_id, url, url || '%%xzzé' AS decoded FROM pages",
    "tolerance_diff": f"SELECT CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, max(abs(x - y)) AS max_diff, sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) = 0 AND max(abs(x - y)) <= 1e-10 AS equal FROM (SELECT event_id, value * slope + intercept AS x, CASE WHEN event_type <> 'signup' THEN value * slope + intercept END AS y FROM events JOIN ({_SLOPES}) AS c USING (event_type)) AS d",
    "rate_time": "SELECT event_id, round(CAST(epoch_us(ts) AS DOUBLE) / CASE WHEN event_type = 'click' THEN 1000 ELSE 30000 END, 3) AS time_in_seconds, 30000::DOUBLE / (user_id + 1) AS sample_rate FROM events",
    "little_endian": "SELECT p_partkey, CAST(ascii(p_name) + 256 * ascii(substr(p_name, 2, 1)) AS BIGINT) AS u16, CAST(ascii(substr(p_name, 2, 1)) + 256 * ascii(substr(p_name, 3, 1)) + 65536 * ascii(substr(p_name, 4, 1)) + 16777216::BIGINT * ascii(substr(p_name, 5, 1)) AS BIGINT) AS u32 FROM part",
    "pattern_matches": "SELECT p_partkey, array_to_string(regexp_extract_all(p_type, '[A-Z][A-Z]'), '|') AS found FROM part",
    "file_suffix": r"SELECT page_id, regexp_extract(string_split(url, '/')[-1], '\.([^.]+)$', 1) AS extension, 'r' || page_id AS prefix FROM pages",
    "name_list": "SELECT r_name, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
