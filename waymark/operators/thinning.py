"""Thinning of series for display: the one rule that depends on what was kept before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_SERIES = ["track_id", "channel", "seg_no"]


def thinned(graph: DataFrame, x_scale: float, y_scale: float) -> DataFrame:
    """Points of a graph that differ by a unit or more, scaled, from the last point kept; the first and last of a segment stay.

    Series stream by in order, so none is ever held whole: from batch to batch go
    the point kept last and the one row whose successor isn't known yet.
    """
    names = graph.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, x_kept, y_kept = None, 0.0, 0.0
        open_row, open_stays = None, False  # the last row so far, and whether it stays in any case

        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in (*_SERIES, "s", "y")]
            stays = []
            for *key, s, y in zip(*columns, strict=True):
                x, y = (float("nan") if v is None else v for v in (s, y))
                x, y = x * x_scale, y * y_scale
                if key != series:
                    if stays:
                        stays[-1] = True  # the last of the series before
                    else:
                        open_stays = True
                    stay, series = True, key
                else:
                    stay = abs(x - x_kept) >= 1 or abs(y - y_kept) >= 1
                if stay:
                    x_kept, y_kept = x, y
                stays.append(stay)
            if not stays:
                continue
            if open_row is not None and open_stays:
                yield open_row
            open_row, open_stays = batch.slice(batch.num_rows - 1), stays[-1]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(stays[:-1], pa.bool_()))
        if open_row is not None:
            yield open_row

    ordered = graph.repartition(*_SERIES).sortWithinPartitions(*_SERIES, "g_no")
    return ordered.mapInArrow(run, graph.schema)
