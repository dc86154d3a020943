"""Arrays written slice by slice in any order, and their errors."""

import numpy as np
import pytest

from ephyspark.operators import signal as S
from ephyspark.operators.arrays import ArrayStore


def test_slices_in_any_order(spark, tmp_path):
    r = np.random.default_rng(0)
    x = r.standard_normal(1000)
    a = ArrayStore(spark, str(tmp_path / "a")).allocate([1000])
    for k in r.permutation(10):
        a.write(x[100 * k : 100 * k + 100], [100 * k + 1])
    assert np.array_equal(a.collect(), x) and a.dims() == (1000,) and len(a) == 1000
    y = r.standard_normal((50, 20))
    b = ArrayStore(spark, str(tmp_path / "b")).allocate([50, 20])
    for k in r.permutation(4):
        b.write(y[:, 5 * k : 5 * k + 5], [1, 5 * k + 1])
    assert np.array_equal(b.collect(), y)
    assert np.array_equal(ArrayStore(spark, str(tmp_path / "c")).save(y).collect(), y)


def test_subset(spark, tmp_path):
    y = np.arange(12.0).reshape(3, 4)
    a = ArrayStore(spark, str(tmp_path / "a")).save(y)
    got = a.collect([3, 1, 3, 9], None)
    assert np.array_equal(got[:3], y[[2, 0, 2]]) and np.isnan(got[3]).all()
    assert np.array_equal(a.collect(None, [True, False, False, True]), y[:, [0, 3]])
    assert a.collect([], None).shape == (0, 4)
    a.write(np.full((1, 2), -1.0), [2, 2])
    assert a.collect([2], None).tolist() == [[4.0, -1.0, -1.0, 7.0]]


def test_fill_and_errors(spark, tmp_path):
    a = ArrayStore(spark, str(tmp_path / "a"))
    with pytest.raises(FileNotFoundError):
        a.write(np.ones(2), [1])
    with pytest.raises(ValueError):
        a.allocate([0, 3])
    a.allocate([2, 2])
    assert a.collect().tolist() == [[0, 0], [0, 0]]
    a.allocate([2, 2], None)
    assert np.isnan(a.collect()).all()
    for values, start, error in ((np.ones((1, 3)), [1, 1], IndexError), (np.ones((1, 1)), [0, 1], IndexError), (np.ones(2), [1], ValueError), (np.ones((1, 1)), [1], ValueError)):
        with pytest.raises(error):
            a.write(values, start)
    with pytest.raises(ValueError):
        a.subset([1])


def test_sample_islands(spark):
    t = [0.0, 0.5, 1.0, 2.0, 5.0, 5.5, 9.0]
    df = spark.createDataFrame([(1, x) for x in t] + [(2, 3.0)], "c int, t double")
    got = S.sample_islands(df, ["c"], "t", 2.0).groupBy("c", "island").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 4), (1, 2, 2), (1, 3, 1), (2, 1, 1)]
