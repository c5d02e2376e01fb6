"""Structured Streaming: counts by channel, sessions and online interpolation.

All take a streaming (or batch) DataFrame with an event-time column and set a watermark, so state
is dropped once it can no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, channel: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, channel, n): counts in tumbling or sliding windows."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width, slide), channel).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), channel, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of a key's events less than a gap apart."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def interpolate_online(rows: DataFrame, key: str, late: str = "10 minutes", max_gap_s: float = 2.0, time: str = "ts") -> DataFrame:
    """(key, id, ts, value): probes of a stream between its fixes.

    rows have key, ts, id, kind (fix or probe) and value. A key's state is its fixes and the probes
    that still wait for a fix after them; both are dropped once they are older than the gap allows.
    Rows of a key are expected in order within the watermark's delay: a probe that comes later than
    the fixes kept for it has no value and is left out, like a probe outside the fixes.
    """
    schema = f"{key} string, id long, {time} timestamp, value double"

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fixes, waiting = ([[tuple(r) for r in x] for x in state.get]) if state.exists else ([], [])
        new = [r for p in parts for r in p.itertuples(index=False)]
        for r in sorted(new, key=lambda r: (getattr(r, time), r.kind == "fix")):
            t = getattr(r, time).timestamp()
            if r.kind == "fix":
                fixes.append((t, float(r.value)))
            else:
                waiting.append((float(r.id), t))
        fixes.sort()
        out, left = [], []
        newest = max([t for t, _ in fixes] + [t for _, t in waiting], default=0.0)
        for i, t in waiting:
            after = next((k for k, f in enumerate(fixes) if f[0] >= t), None)
            if after is None:
                if newest - t <= max_gap_s:
                    left.append((i, t))
                continue
            k = max(1, after)
            if k < len(fixes) and fixes[k - 1][0] <= t and 0 < fixes[k][0] - fixes[k - 1][0] <= max_gap_s:
                a, b = fixes[k - 1], fixes[k]
                out.append((name[0], int(i), pd.Timestamp(t, unit="s"), a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0])))
        oldest = min([t for _, t in left], default=newest)
        fixes = [f for k, f in enumerate(fixes) if f[0] >= oldest - max_gap_s or k == len(fixes) - 1]
        state.update(([list(f) for f in fixes], [list(w) for w in left]))
        if out:
            yield pd.DataFrame(out, columns=[key, "id", time, "value"])

    marked = rows.withWatermark(time, late)
    return marked.groupBy(key).applyInPandasWithState(run, schema, "fixes array<array<double>>, waiting array<array<double>>", "append", GroupStateTimeout.NoTimeout)
