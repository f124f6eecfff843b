"""Structured Streaming forms of the running statistics, the shape average and the label-row sync."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_running_stats(stream: DataFrame, key: str, value: str, time: str | None = None, window: str | None = None, watermark: str | None = None) -> DataFrame:
    """min / max / mean / count per metric, optionally per event-time window with late data dropped after the watermark."""
    if watermark:
        stream = stream.withWatermark(time, watermark)
    groups: list[str | Column] = [key]
    if window:
        groups.append(F.window(time, window).alias("window"))
    v = F.col(value).cast("double")
    return stream.groupBy(*groups).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("count"))


def stream_shape_similarity(stream: DataFrame, track: str, id_col: str, order: list[str], vector: str, decay: float = 0.5) -> DataFrame:
    """(track, id, score) with one averaged vector of state per track; rows of a micro-batch are taken in ``order``."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{track} {kinds[track]}, {id_col} {kinds[id_col]}, score double"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        average = np.array(state.get[0]) if state.exists else None
        scores = []
        for v in rows[vector]:
            v = np.asarray(v, dtype=float)
            if average is None:
                scores.append(1.0)
                average = v
            else:
                scores.append(float(average @ v / (np.linalg.norm(average) * np.linalg.norm(v))))
                average = decay * average + (1 - decay) * v
        state.update((average.tolist(),))
        yield pd.DataFrame({track: key[0], id_col: rows[id_col].to_numpy(), "score": scores})

    cols = dict.fromkeys([track, id_col, *order, vector])
    return stream.select(*cols).groupBy(track).applyInPandasWithState(update, out, "average array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_sync(stream: DataFrame, log: str):
    """Writer that appends every micro-batch of changed rows to its own folder of a change log.

    A retried batch overwrites its own folder, so rows are applied exactly once; nothing stored is rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


def synced(log: DataFrame, key: str, edited: str) -> DataFrame:
    """Current rows of a change log: per key the last edit, later batches first on a tie. One combined aggregate, no sort."""
    cols = [c for c in log.columns if c != "batch"]
    latest = F.max_by(F.struct(*cols), F.struct(edited, "batch"))
    return log.groupBy(F.col(key).alias("_k")).agg(latest.alias("r")).select("r.*")
