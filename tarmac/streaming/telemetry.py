"""Structured Streaming forms of the incremental operators.

Each is a plain transformation of a streaming (or batch) DataFrame, so a test
can run the same code on both and compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, ts: str, session: str, aggregates: dict[str, Column], width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """session, start, aggregates over tumbling windows; later data than the watermark are dropped."""
    rows = stream.withWatermark(ts, late).groupBy(F.col(session), F.window(ts, width)).agg(*(c.alias(n) for n, c in aggregates.items()))
    return rows.select(session, F.col("window.start").alias("start"), *aggregates)


def sliding(stream: DataFrame, ts: str, session: str, aggregates: dict[str, Column], width: str = "10 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    rows = stream.withWatermark(ts, late).groupBy(F.col(session), F.window(ts, width, slide)).agg(*(c.alias(n) for n, c in aggregates.items()))
    return rows.select(session, F.col("window.start").alias("start"), *aggregates)


def segments(stream: DataFrame, ts: str, session: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """session, start, end, n of drives parted by gaps."""
    rows = stream.withWatermark(ts, late).groupBy(F.col(session), F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return rows.select(session, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fuse(v: float, p: float, mu: float, sigma: float | None, a: float | None, q: float, low: float, high: float) -> tuple[float, float]:
    """One step of the speed filter; a negative variance means that nothing was seen yet."""
    s = high if sigma is None or sigma != sigma else min(max(sigma, low), high)
    if p < 0:
        return mu, s * s
    if a is not None and a == a:
        v, p = v + a, p + q
    gain = p / (p + s * s)
    return v + gain * (mu - v), (1 - gain) * p


def speed_fusion(stream: DataFrame, session: str, order: str, q: float = 0.5, low: float = 0.3, high: float = 20.0) -> DataFrame:
    """session, order, fused: the scalar speed filter with its state kept per session.

    Rows of a trigger are taken in order; rows older than the state's last one are passed over.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, p, last = state.get if state.exists else (0.0, -1.0, None)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for r in rows.itertuples():
            at = getattr(r, order)
            if last is not None and at <= last:
                continue
            v, p = fuse(v, p, r.mu, r.sigma, r.a_fwd, q, low, high)
            last = int(at)
            out.append((key[0], int(at), max(v, 0.0)))
        state.update((float(v), float(p), int(last) if last is not None else -1))
        yield pd.DataFrame(out, columns=[session, order, "fused"])

    own = stream.select(session, order, "mu", "sigma", "a_fwd")
    kind = dict(own.dtypes)[session]
    return own.groupBy(session).applyInPandasWithState(run, f"`{session}` {kind}, `{order}` long, fused double", "v double, p double, last long", "append", GroupStateTimeout.NoTimeout)
