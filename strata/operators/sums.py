"""Sums that every task of a pass sends: added up on the driver while they are few, else by a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of all tasks together that the driver takes at once.
SENT = 4_000_000


def tasks_of(rows: DataFrame) -> int:
    return rows.rdd.getNumPartitions()


def added(partial: DataFrame, tasks: int, n: int, size: int) -> np.ndarray:
    """The tasks' (place int, sums array<double>) added up: ``n`` x ``size`` numbers.

    A shuffle of a few thousand numbers takes longer than the pass over the rows that gave them.
    """
    place, out = partial.columns[0], np.zeros((n, size))
    if tasks * n * size <= SENT:
        sent = partial.toArrow()
        for chunk in sent.to_batches():
            values = chunk.column(1).flatten().to_numpy(zero_copy_only=False)
            if chunk.num_rows:
                np.add.at(out, chunk.column(0).to_numpy(), values.reshape(chunk.num_rows, -1))
        return out
    rows = (partial.select(place, F.posexplode("sums").alias("at", "v")).groupBy(place, "at").agg(F.sum("v").alias("v"))
            .toArrow())
    out[rows[place].to_numpy(), rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out
