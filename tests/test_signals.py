"""The filter with feedback over chunks of signals, against one loop over each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dsp


def _loop(xs, ahead, back):
    out = []
    for k in range(len(xs)):
        at = lambda s, i: s[i] if i >= 0 else 0.0
        out.append(sum(ahead[j] * at(xs, k - j) for j in range(3)) - sum(back[j] * at(out, k - j) for j in (1, 2)))
    return out


def test_signals_in_chunks(spark):
    rng = np.random.default_rng(2)
    signals = {"long": 3000, "one": 1, "two": 2, None: 5}
    rows = [(key, i, None if key == "two" and i == 0 else float(x)) for key, n in signals.items() for i, x in enumerate(rng.normal(size=n))]
    ahead, back = dsp.notch(0.1, 1.0, 5.0)
    df = spark.createDataFrame(rows, "who string, at int, x double").repartition(5)
    found = dsp.recursive_filtered(df, ["who"], ["at"], "x", ahead, back)
    assert found.columns == ["who", "at", "x", "filtered"]
    rows_found = found.collect()
    assert len(rows_found) == len(rows)
    for key in signals:
        own = sorted((r for r in rows_found if r.who == key), key=lambda r: r.at)
        assert [r.filtered for r in own] == pytest.approx(_loop([r.x or 0.0 for r in own], ahead, back), abs=1e-9)
    assert dsp.recursive_filtered(df.limit(0), ["who"], ["at"], "x", ahead, back).collect() == []


def test_one_signal_lies_in_many_chunks(spark):
    """A signal of 200,000 samples without keys: chunks meet at their ends, and the time is that of one pass."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("at"), F.sin(F.col("id") * 0.2 * np.pi / 2).alias("x"))
    ahead, back = dsp.notch(0.1, 1.0, 5.0)
    found = dsp.recursive_filtered(df, [], ["at"], "x", ahead, back)
    y = np.array(_loop(np.sin(np.arange(n) * 0.2 * np.pi / 2).tolist(), ahead, back))
    got = np.array([r.filtered for r in found.orderBy("at").select("filtered").collect()])
    assert np.abs(got - y).max() < 1e-7
