"""Filters of evenly sampled signals: linear-phase ones, and one with feedback."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.storage import ended


def normalized(hz: float, sampling_hz: float) -> float:
    """A frequency as a share of half the sampling rate."""
    return hz / (sampling_hz / 2)


def taps(n: int, low: float, high: float) -> list[float]:
    """Coefficients of a filter that passes low..high (shares of half the sampling rate), by a Hamming-windowed sinc.

    Gain is one at zero frequency, else at the top one, else in the middle of the band.
    """
    k = np.arange(n) - (n - 1) / 2
    h = (high * np.sinc(high * k) - low * np.sinc(low * k)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))
    at = 0.0 if low == 0 else 1.0 if high == 1 else (low + high) / 2
    return (h / np.sum(h * np.cos(np.pi * at * k))).tolist()


def lowpass(n: int, cutoff_hz: float, sampling_hz: float) -> list[float]:
    return taps(n, 0.0, normalized(cutoff_hz, sampling_hz))


def highpass(n: int, cutoff_hz: float, sampling_hz: float) -> list[float]:
    if n % 2 == 0:
        raise ValueError("a high-pass filter needs an odd number of taps")
    return taps(n, normalized(cutoff_hz, sampling_hz), 1.0)


def bandpass(n: int, low_hz: float, high_hz: float, sampling_hz: float) -> list[float]:
    return taps(n, normalized(low_hz, sampling_hz), normalized(high_hz, sampling_hz))


def notch(hz: float, sampling_hz: float, quality: float) -> tuple[list[float], list[float]]:
    """Feed-forward and feedback coefficients of a second-order filter that stops one frequency; -3 dB at a band of hz / quality."""
    angle = np.pi * normalized(hz, sampling_hz)
    gain = 1 / (1 + np.tan(angle / quality / 2))
    ahead = [gain, -2 * gain * np.cos(angle), gain]
    return [float(x) for x in ahead], [1.0, float(ahead[1]), float(2 * gain - 1)]


def recursive_filtered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ahead: Sequence[float], back: Sequence[float]) -> DataFrame:
    """Each key's signal through a filter with feedback, both of three coefficients: rows (keys, order, value, filtered).

    Rows are cut into ranges by key and order, so a long signal lies in many chunks. What a chunk does to the filter's state (the
    last two samples and outputs) is an affine map: a matrix to the power of its length, and the state it ends in when begun at
    zero. Maps are composed along each signal, a row for each chunk, and then every chunk is filtered from the state it begins
    in. Work is linear in the rows. Null samples are zero; rows with a null key are a signal of their own.
    """
    own = df.select(*keys, *order, F.col(value).cast("double").alias(value))
    chunks = ended(own.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "signal")
    key_kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    state = ("_x1", "_x2", "_y1", "_y2")
    ends = chunks.groupBy(*keys, "_part").applyInArrow(
        _chunk_end(keys, order, value, ahead, back), ", ".join(filter(None, [key_kinds, "_part int, _n long", *(f"{c} double" for c in state)]))
    )
    begins = ends.groupBy(*keys).applyInArrow(_chunk_begins(keys, ahead, back), ", ".join(filter(None, [key_kinds, "_part int", *(f"{c} double" for c in state)])))
    # both are keyed by chunk; a null key is a key
    at = [F.struct(*(F.col(k) for k in (*keys, "_part"))).alias("_at")]
    left, right = chunks.select(*at, *own.columns), begins.select(*at, *state)
    out = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in own.columns), "filtered double"])
    return left.groupBy("_at").cogroup(right.groupBy("_at")).applyInArrow(_chunk_filtered(own.columns, order, value, ahead, back), out)


def _run(x: np.ndarray, begin: Sequence[float], ahead: Sequence[float], back: Sequence[float]) -> list[float]:
    """A chunk's outputs from the state (x1, x2, y1, y2) it begins in."""
    x1, x2, y1, y2 = begin
    (a0, a1, a2), (_, b1, b2) = ahead, back
    out = []
    for now in x.tolist():
        y = a0 * now + a1 * x1 + a2 * x2 - b1 * y1 - b2 * y2
        out.append(y)
        x1, x2, y1, y2 = now, x1, y, y1
    return out


def _ordered(table: pa.Table, order: Sequence[str], value: str) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by([(c, "ascending") for c in order])
    return table, pc.fill_null(table.column(value), 0.0).to_numpy()


def _chunk_end(keys, order, value, ahead, back):
    def work(table: pa.Table) -> pa.Table:
        x = _ordered(table, order, value)[1]
        y = _run(x, (0.0,) * 4, ahead, back)
        last = [float(x[-1]), float(x[-2]) if len(x) > 1 else 0.0, y[-1], y[-2] if len(y) > 1 else 0.0]
        row = table.select([*keys, "_part"]).slice(0, 1).append_column("_n", pa.array([len(x)], pa.int64()))
        for name, v in zip(("_x1", "_x2", "_y1", "_y2"), last):
            row = row.append_column(name, pa.array([v], pa.float64()))
        return row

    return work


def _chunk_begins(keys, ahead, back):
    (_, a1, a2), (_, b1, b2) = ahead, back
    step = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [a1, a2, -b1, -b2], [0, 0, 1, 0]], float)  # of the state, for a sample of zero

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        ends = np.array([table.column(c).to_numpy() for c in ("_x1", "_x2", "_y1", "_y2")]).T
        at, begins = np.zeros(4), []
        for n, end in zip(table.column("_n").to_pylist(), ends):
            begins.append(at)
            at = np.linalg.matrix_power(step, n) @ at + end
        out = table.select([*keys, "_part"])
        for k, name in enumerate(("_x1", "_x2", "_y1", "_y2")):
            out = out.append_column(name, pa.array([b[k] for b in begins], pa.float64()))
        return out

    return work


def _chunk_filtered(columns, order, value, ahead, back):
    def work(chunk: pa.Table, begin: pa.Table) -> pa.Table:
        rows, x = _ordered(chunk.select(columns), order, value)
        state = [begin.column(c)[0].as_py() for c in ("_x1", "_x2", "_y1", "_y2")]
        return rows.append_column("filtered", pa.array(_run(x, state, ahead, back), pa.float64()))

    return work


def filtered(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, coefficients: Sequence[float]) -> DataFrame:
    """Each key's signal, in order, through a filter; what lies before the first sample is zero."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.lit(0.0)
    for k, c in enumerate(coefficients):
        out = out + F.lit(float(c)) * F.coalesce(F.lag(value, k).over(w), F.lit(0.0))
    return df.withColumn("filtered", out)
