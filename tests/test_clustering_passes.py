"""Clustering passes: sums of all runs against a loop over points, rows in parts for every core."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strata.operators import clustering as CL
from strata.session import spread


def test_sums_of_all_runs_match_a_loop():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (300, 3)), 1)
    starts = np.array([0, 2, 5])
    centers = np.round(rng.normal(0, 1, (5, 3)), 1)
    centers[1], centers[3] = centers[0], centers[2]  # ties go to the first centroid
    for points, sums in ((x, CL._slab_sums), (x, CL._slab_sums_of_any)):
        got = sums(points, starts, centers)
        for a, b in zip(starts, starts[1:]):
            far = ((points[:, None] - centers[a:b]) ** 2).sum(2)
            near = far.argmin(1)
            assert np.isclose(got[a:b, 1].sum(), far.min(1).sum())
            for j in range(b - a):
                assert got[a + j, 0] == (near == j).sum() and np.allclose(got[a + j, 2:], points[near == j].sum(0))


def test_runs_of_one_k_are_compared_together(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (1300, 4)), 2)
    sizes = [2, 2, 2, 3, 3, 5]
    starts = np.cumsum([0, *sizes])
    centers = np.round(rng.normal(0, 1, (starts[-1], 4)), 2)
    centers[7] = centers[6]  # a tie in one run of a group
    calls, least = [], np.minimum
    monkeypatch.setattr(CL.np, "minimum", type("Counted", (), {"reduce": staticmethod(lambda *a, **k: (calls.append(1), least.reduce(*a, **k))[1])}))
    lists = pa.array(list(x), pa.list_(pa.float64()))
    batches = [pa.RecordBatch.from_arrays([lists.slice(at, n)], ["x"]) for at, n in ((0, 1000), (1000, 300))]
    found, = CL._lloyd_rows(iter(batches), starts, centers)
    assert len(calls) == 3 * 6  # three different k, six slabs: 3 x 256, 232, 256 and 44 points
    sums = np.array(found.column("sums").to_pylist())
    want = CL._slab_sums_of_any(x, starts, centers)
    assert np.allclose(sums[:, [0, 2, 3, 4, 5]], want[:, [0, 2, 3, 4, 5]])
    for a, b in zip(starts, starts[1:]):
        assert np.isclose(sums[a:b, 1].sum(), want[a:b, 1].sum())


def test_few_sums_are_added_without_a_shuffle(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from strata.operators import sums as SU

    def partial(batches):
        import pyarrow as pa

        for b in batches:
            v = [float(sum(b.column(0).to_pylist())), float(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([0, 2], pa.int32()), pa.array([v, [-x for x in v]])], ["model", "sums"])

    rows = spark.range(0, 1000, 1, 4)
    sent = rows.mapInArrow(partial, "model int, sums array<double>")
    want = [[499500.0, 1000.0], [0.0, 0.0], [-499500.0, -1000.0]]
    monkeypatch.setattr(SU, "SENT", 0)
    assert SU.added(sent, SU.tasks_of(rows), 3, 2).tolist() == want
    monkeypatch.setattr(SU, "SENT", 24)
    monkeypatch.setattr(DataFrame, "groupBy", lambda *a: 1 / 0)
    assert SU.tasks_of(rows) == 4 and SU.added(sent, 4, 3, 2).tolist() == want
    assert SU.added(sent.where("false"), 4, 3, 2).tolist() == [[0.0, 0.0]] * 3


def test_rows_of_many_passes_are_dealt_to_all_cores(spark):
    one = spark.range(1000).coalesce(1).select("id", F.lit(None).alias("nothing"))
    table = spread(one, "test")
    sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)
    assert table.count() == 1000 and table.where("nothing is not null").count() == 0
