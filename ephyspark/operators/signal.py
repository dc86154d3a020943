"""Calibration, partitioning at pauses, offsets and slices of signals, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microvolts of each unit name. Fixed values.
MICROVOLTS = {"V": 1e6, "mV": 1e3}
CLOCK, LEAST_RESOLUTION = 30000, 30000


def unit_scale(units: Column) -> Column:
    """The factor to microvolts; other units than V and mV count as microvolts."""
    return F.when(units == "V", F.lit(1e6)).when(units == "mV", F.lit(1e3)).otherwise(F.lit(1.0))


def slope_intercept(channels: DataFrame) -> DataFrame:
    """Adds slope and intercept from a channel table's digital and analog bounds, and rewrites the units to uV."""
    s = unit_scale(F.col("units"))
    low, high = F.col("min_analog_value") * s, F.col("max_analog_value") * s
    d_low, d_high = (F.col(f"{k}_digital_value").cast("double") for k in ("min", "max"))  # a range may exceed 16 bits
    out = channels.withColumn("slope", (high - low) / (d_high - d_low))
    out = out.withColumn("intercept", ((high + low) - F.col("slope") * (d_high + d_low)) / 2)
    return out.withColumn("units", F.when(F.col("units").isin(*MICROVOLTS), "uV").otherwise(F.col("units")))


def calibrate(df: DataFrame, channels: DataFrame, on: str, value: str = "value", out: str = "calibrated") -> DataFrame:
    """Adds value * slope + intercept by channel; the join is left to the optimiser, which knows the tables' sizes."""
    return df.join(channels.select(on, "slope", "intercept"), on).withColumn(out, F.col(value) * F.col("slope") + F.col("intercept")).drop("slope", "intercept")


def sample_rate(period: Column) -> Column:
    return F.lit(CLOCK) / period


def event_seconds(ticks: Column, resolution: Column, version: Column) -> Column:
    """Seconds of an event's ticks; version 3.0 files with a lower resolution are read at 30000."""
    r = F.when((version == "3.0") & (resolution < LEAST_RESOLUTION), F.lit(LEAST_RESOLUTION)).otherwise(resolution)
    return ticks.cast("double") / r


#: A channel is split into blocks from so many rows on, if it also holds more than one in BLOCKS of all rows.
HOT_ROWS, LEVELS = 1 << 20, 10
#: Estimated bytes of a table that one task takes whole, however its rows are spread over channels.
WHOLE_BYTES = 64 << 20
BLOCKS = 1 << LEVELS
#: Types that have approximate quantiles.
_ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")


def _bounds(order: str, blocks: int) -> Column:
    """Approximate quantiles of a column between blocks of about equally many rows."""
    return F.percentile_approx(order, [k / blocks for k in range(1, blocks)], 10 * blocks).alias("bounds_")


def _block(order: str, levels: int) -> Column:
    """The block of a row by a binary search in bounds_; rows without an order are in the first."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    return F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.element_at("bounds_", low + step) <= F.col(order), low + step).otherwise(low))


def partition_at_pauses(df: DataFrame, channel: Sequence[str], order: Sequence[str], start: Column, end: Column, slack: Column, out: str = "partition", hot_rows: int = HOT_ROWS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Numbers maximal runs without a pause: a row breaks where its start is off the end before it by more than the slack.

    One window per channel. A channel of more than `hot_rows` rows and more than one in BLOCKS of all rows, of which there
    are BLOCKS at most, is split at approximate quantiles of the first order column: breaks are numbered inside each block,
    and a row per block carries them, and the end before it, on to the next. Rows with the same first order value stay in
    one block. Tables that the planner estimates at `whole_bytes` or less, and order columns without quantiles (texts), leave
    the channels whole; the numbers are the same. Null channels are a channel; nulls in the order come first, ties in any
    order; a null start, end or slack never breaks.
    """
    marked = df.withColumn("key_", F.struct(*channel)).withColumn("s_", start).withColumn("e_", end).withColumn("l_", slack)
    split = dict(df.dtypes)[order[0]].startswith(_ORDERED) and _estimated_bytes(df) > whole_bytes
    if split:
        item = F.xxhash64(*channel)
        top = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in channel)}), {BLOCKS}, {16 * BLOCKS})")
        stats = df.agg(top.alias("top_"), F.count("*").alias("n_"), _bounds(order[0], BLOCKS))
        least = F.greatest(F.lit(hot_rows), F.floor(F.col("n_") / BLOCKS))
        hot = F.transform(F.filter("top_", lambda x: x["count"] > least), lambda x: x["item"])
        stats = stats.select(hot.alias("hot_"), "bounds_")  # one row
        block = F.when(F.array_contains("hot_", item), _block(order[0], LEVELS)).otherwise(-1)
        marked = marked.crossJoin(F.broadcast(stats)).withColumn("block_", block).drop("hot_", "bounds_")
    else:
        marked = marked.withColumn("block_", F.lit(-1))
    w = Window.partitionBy("key_", "block_").orderBy(*order)
    off = lambda before: F.when(F.abs(F.col("s_") - before) > F.col("l_"), 1).otherwise(0)
    marked = marked.withColumn("break_", off(F.lag("e_").over(w)))
    number = F.sum("break_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    if not split:
        return marked.withColumn(out, number.cast("int")).select(*_others(df, out), out)
    place = marked.where("block_ >= 0").withColumn("r_", F.row_number().over(w))
    ends = place.groupBy("key_", "block_").agg(F.sum("break_").alias("n_"), F.min_by(F.struct("s_", "l_"), "r_").alias("first_"), F.max_by("e_", "r_").alias("last_"))
    blocks = Window.partitionBy("key_").orderBy("block_")  # BLOCKS rows at most
    ends = ends.select("key_", "block_", "n_", "first_.*", F.lag("last_").over(blocks).alias("before_")).withColumn("enter_", off(F.col("before_")))
    skip = F.sum(F.col("n_") + F.col("enter_")).over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_")
    numbered = marked.withColumn("number_", number).join(ends.select("key_", "block_", skip.alias("skip_")), ["key_", "block_"], "left")
    return numbered.withColumn(out, (F.col("number_") + F.coalesce("skip_", F.lit(0))).cast("int")).select(*_others(df, out), out)


def _estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _others(df: DataFrame, out: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != out]


def summarise_partitions(df: DataFrame, keys: Sequence[str], start: Column, end: Column, points: Column) -> DataFrame:
    """Packets, samples, first start and last end of each partition."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_packets"), F.sum(points).cast("bigint").alias("n_samples"), F.min(start).alias("start_time"), F.max(end).alias("end_time"))


def packet_offsets(df: DataFrame, order: str, length: Column, within: Sequence[str] = (), out: str = "byte_offset", levels: int = 10) -> DataFrame:
    """Adds the exclusive running sum of lengths in the given order; rows without an order come first, ties in any order.

    Without `within` the order, a number or a time, spans the whole table. It is computed in two steps, so that no task gets
    all rows: sums per block of the order column, and running sums inside each block. The 2 ** levels blocks lie between
    approximate quantiles, so they hold about equally many rows however the values are spread.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("bigint"))
    bounds = df.agg(_bounds(order, 1 << levels))
    df = df.crossJoin(F.broadcast(bounds)).withColumn("block_", _block(order, levels)).drop("bounds_")  # one row
    sums = df.groupBy("block_").agg(F.sum(length).alias("sum_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sums = sums.select("block_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("skip_"))
    inside = Window.partitionBy("block_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out_col = (F.coalesce(F.sum(length).over(inside), F.lit(0)) + F.col("skip_")).cast("bigint")
    return df.join(F.broadcast(sums), "block_").withColumn(out, out_col).drop("block_", "skip_")


def chunk_plan(df: DataFrame, points: str, chunk: int = 1_000_000) -> DataFrame:
    """One row per chunk of at most `chunk` samples: chunk_start and chunk_size."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(points).cast("bigint") - 1, F.lit(chunk).cast("bigint")))
    return df.where(F.col(points) > 0).withColumn("chunk_start", starts).withColumn("chunk_size", F.least(F.lit(chunk).cast("bigint"), F.col(points) - F.col("chunk_start")))


def sample_times(start: Column, index: Column, rate: Column) -> Column:
    return start + index / rate


def pad(values: Column, length: Column, value: Column) -> Column:
    """Right-pads an array to a length."""
    return F.concat(values, F.array_repeat(value, F.greatest(length - F.size(values), F.lit(0))))


def pad_to_longest(df: DataFrame, values: str) -> DataFrame:
    """Right-pads all arrays with zeros to the longest of the table (one row is broadcast)."""
    longest = df.agg(F.max(F.size(values)).alias("longest_"))
    return df.crossJoin(F.broadcast(longest)).withColumn(values, pad(F.col(values), F.col("longest_"), F.lit(0.0))).drop("longest_")


def long_view(blocks: DataFrame) -> DataFrame:
    """Samples of block rows, one a row, with their times."""
    out = blocks.select("*", F.posexplode("data").alias("pos_", "value")).withColumn("sample", F.col("start_sample") + F.col("pos_"))
    return out.withColumn("time", sample_times(F.col("relative_time"), F.col("sample"), F.col("sample_rate"))).drop("data", "pos_", "start_sample")


def subset(samples: DataFrame, index: DataFrame, by: str = "sample", order: str = "order") -> DataFrame:
    """Samples at requested indices, in request order, repeats included; an index that isn't there gives null."""
    return index.join(samples, by, "left").orderBy(order)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 1e-10) -> DataFrame:
    """One row: how many keys only one side has, the largest difference, and whether both agree within the tolerance."""
    both = a.select(*keys, F.col(value).alias("x_"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col(value).alias("y_"), F.lit(1).alias("in_b")), list(keys), "full_outer")
    missing = F.sum(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1).otherwise(0)).cast("bigint")
    out = both.agg(F.coalesce(missing, F.lit(0)).alias("n_missing"), F.max(F.abs(F.col("x_") - F.col("y_"))).alias("max_diff"))
    return out.withColumn("equal", (F.col("n_missing") == 0) & (F.coalesce(F.col("max_diff"), F.lit(0.0)) <= tolerance))


def sample_islands(df: DataFrame, channel: Sequence[str], time: str, rate: float, max_step: int = 2, out: str = "island") -> DataFrame:
    """Numbers runs of samples whose rounded sample numbers step by `max_step` at most, counted from the channel's first."""
    first = F.min(time).over(Window.partitionBy(*channel))
    k = F.bround((F.col(time) - first) * F.lit(rate)).cast("bigint")
    df = df.withColumn("k_", k)
    return partition_at_pauses(df, channel, ["k_"], F.col("k_"), F.col("k_"), F.lit(max_step), out).drop("k_")
