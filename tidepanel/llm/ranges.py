"""Ranges of document ids of about equal size, found without moving any text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def range_starts(ids: DataFrame, ranges: int) -> np.ndarray:
    """The least id of each of at most `ranges` nonempty ranges of about equal size, sorted."""
    edges = np.unique(np.array(ids.approxQuantile("doc", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)), np.float64)).astype(np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids[np.argsort(ids, kind="stable")]
            own, first = np.unique(np.searchsorted(edges, ids, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids[first], pa.int64())], ["at", "doc"])

    found = ids.mapInArrow(least, "at long, doc long").groupBy("at").agg(F.min("doc").alias("doc")).collect()
    return np.array(sorted(r["doc"] for r in found), np.int64)
