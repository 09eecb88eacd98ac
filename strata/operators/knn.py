"""Exact k-nearest-neighbour join (Euclidean) over an index of cells.

Reference points are dealt into cells by a tree of cuts (each along the main direction of the points it divides, at their
median), learned from at most ``SAMPLE_ROWS`` points.  What is known of every cell is exact: its box in the leading
principal directions, and the largest distance from its pivot.  Both bound the distance of a query from below (an orthogonal
projection shortens no less, and the triangle inequality), so a cell can be left out when its bound exceeds the query's k-th
distance.

1. Queries are dealt into the same cells and cut into blocks of about ``BLOCK`` queries.  Every block is compared with the
   points of its own cell, and of the next ones if that has fewer than k: the k-th distance of each query is bounded now.
2. Every block is compared with the remaining cells that some query's bound lets through.

Reference points travel to the blocks that ask for their cell and are compared as they stream by, one matrix product per
slice; a query holds its k best (distance, reference id), nothing else.  So memory is bounded, repeated vectors are rows
like others, and the result is exact.  ``group`` runs many joins, such as one per fold, at once.

``knn_out_of_folds`` is the join of cross-validation: every row against the rows of all other folds.  A row is stored and
cut into cells once, not once per fold that may refer to it; folds that prepare the features in their own way (``FoldView``)
are served from the raw row, under bounds that hold in every fold's space.  Its blocks are whole regions of neighbouring
cells, so a cell travels once to a region, whatever the number of queries and folds there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from .prefix import running_totals

SAMPLE_ROWS = 20_000
#: Points per cell (about), fewest sampled points that a cell is learned from, queries per block, points per slice.
CELL_ROWS, CELL_SAMPLE, BLOCK, SLICE = 512, 16, 1024, 4096
DIRECTIONS = 16
#: Regions of ``knn_out_of_folds``: fewest and most rows, memory of one; bytes of the sample that its cells are learned from.
REGION_ROWS, REGION_CAP, REGION_BYTES, SAMPLE_BYTES = 8_192, 131_072, 128 << 20, 12 << 20
#: Queries of a region that are compared together.
NEAR = 256
#: Stand for a null id and a null kept value.
NO_KEY, NO_VALUE = int(np.iinfo(np.int64).min), int(np.iinfo(np.int32).min)


@dataclass
class CellTree:
    """Cuts as arrays: ``x . way[node] < cut[node]`` goes to ``low[node]``, else to ``high[node]``; leaves have ``cell`` >= 0."""

    way: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cell: np.ndarray
    pivots: np.ndarray
    axes: np.ndarray  # leading principal directions, one per column

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.cell[node] < 0)
            if not len(inner):
                return self.cell[node]
            at = node[inner]
            below = np.einsum("ij,ij->i", x[inner], self.way[at]) < self.cut[at]
            node[inner] = np.where(below, self.low[at], self.high[at])


def cell_tree(sample: np.ndarray, cells: int) -> CellTree:
    """About ``cells`` cells of equally many sampled points; fewer where points repeat."""
    d = sample.shape[1]
    way, cut, low, high, cell, pivots = [], [], [], [], [], []
    least = max(CELL_SAMPLE, len(sample) // max(1, cells))

    def grow(rows: np.ndarray) -> int:
        node = len(cell)
        for column in (way, cut, low, high, cell):
            column.append(0)
        points = sample[rows]
        middle = points.mean(0) if len(rows) else np.zeros(d)
        if len(rows) >= 2 * least:
            gaps = points - middle
            main = np.linalg.eigh(gaps.T @ gaps)[1][:, -1]
            along = points @ main
            at = np.median(along)
            below = along < at
            if 0 < below.sum() < len(rows):
                way[node], cut[node], cell[node] = main, at, -1
                low[node] = grow(rows[below])
                high[node] = grow(rows[~below])
                return node
        way[node], cell[node] = np.zeros(d), len(pivots)
        pivots.append(middle)
        return node

    grow(np.arange(len(sample)))
    gaps = sample - sample.mean(0) if len(sample) else np.zeros((1, d))
    axes = np.linalg.eigh(gaps.T @ gaps)[1][:, ::-1][:, :DIRECTIONS]
    return CellTree(np.array(way, float).reshape(-1, d), np.array(cut, float), np.array(low), np.array(high), np.array(cell),
                    np.array(pivots), axes)


@dataclass
class CellBounds:
    """Cells of one group: numbers, points, radius around the pivot, box in the leading directions."""

    cell: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def below(self, x: np.ndarray, tree: CellTree) -> np.ndarray:
        """Lower bounds of the distances from the rows of ``x`` to the points of each cell."""
        along = x @ tree.axes
        out = np.empty((len(x), len(self.cell)))
        for k in range(len(self.cell)):
            outside = np.maximum(0.0, np.maximum(self.low[k] - along, along - self.high[k]))
            far = np.sqrt(((x - tree.pivots[self.cell[k]]) ** 2).sum(1)) - self.radius[k]
            out[:, k] = np.maximum(np.sqrt((outside * outside).sum(1)), far)
        return out


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(column) else np.empty((0, width))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of a table as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _celled(batches: Iterator[pa.RecordBatch], tree: CellTree, at: int, space: _Space | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _vectors(batch.column(at), tree.way.shape[1])
        x = space.common(x) if space else x
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cells_of(x).astype(np.int32))], [*batch.schema.names, "cell"])


def _bound_rows(batches: Iterator[pa.RecordBatch], tree: CellTree, space: _Space | None = None) -> Iterator[pa.RecordBatch]:
    """Per (grp, cell) of a batch: points, radius, box."""
    for batch in batches:
        if not batch.num_rows:
            continue
        grp, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = _vectors(batch.column(2), tree.way.shape[1])
        x = space.common(x) if space else x
        order = np.lexsort((cell, grp))
        grp, cell, x = grp[order], cell[order], x[order]
        starts = np.concatenate([[0], np.flatnonzero((grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1])) + 1])
        along, far = x @ tree.axes, np.sqrt(((x - tree.pivots[cell]) ** 2).sum(1))
        low, high = np.minimum.reduceat(along, starts), np.maximum.reduceat(along, starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grp[starts]), pa.array(cell[starts]), pa.array(np.diff([*starts, len(grp)])), pa.array(np.maximum.reduceat(far, starts)),
             pa.array(list(low), pa.list_(pa.float64())), pa.array(list(high), pa.list_(pa.float64()))],
            ["grp", "cell", "n", "radius", "low", "high"])


class _Nearest:
    """The ``size`` best (distance, key) of each query of a block."""

    def __init__(self, queries: int, size: int):
        self.size = size
        self.query = self.key = np.empty(0, np.int64)
        self.dist = self.load = np.empty(0)
        self.worst = np.full(queries, np.inf)

    def push(self, query: np.ndarray, dist: np.ndarray, key: np.ndarray, load: np.ndarray) -> None:
        if not len(query):
            return
        query, dist, key, load = (np.concatenate(x) for x in ((self.query, query), (self.dist, dist), (self.key, key), (self.load, load)))
        order = np.lexsort((key, dist, query))
        query, dist, key, load = query[order], dist[order], key[order], load[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.size
        self.query, self.dist, self.key, self.load = query[kept], dist[kept], key[kept], load[kept]
        last = place == self.size - 1
        self.worst[query[last]] = dist[last]


class _Best:
    """As ``_Nearest``, for blocks of which few queries meet new rows at a time: only their lists are merged."""

    def __init__(self, queries: int, size: int):
        self.size = size
        self.dists, self.loads = np.full((queries, size), np.inf), np.zeros((queries, size))
        self.keys, self.held = np.zeros((queries, size), np.int64), np.zeros((queries, size), bool)
        self.worst = np.full(queries, np.inf)

    def push(self, query: np.ndarray, dist: np.ndarray, key: np.ndarray, load: np.ndarray) -> None:
        if not len(query):
            return
        who, at = np.unique(query, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(who)), self.size)])
        dist, key, load = (np.concatenate([new, old[who].ravel()]) for new, old in (
            (dist, self.dists), (key, self.keys), (load, self.loads)))
        held = np.concatenate([np.ones(len(query), bool), self.held[who].ravel()])
        order = np.lexsort((key, ~held, dist, at))
        at = at[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < self.size]  # as many as before, of each
        for old, new in ((self.dists, dist), (self.keys, key), (self.loads, load), (self.held, held)):
            old[who] = new[order].reshape(len(who), self.size)
        self.worst[who] = self.dists[who, -1]


def _compare(nearest: _Nearest | _Best, q: np.ndarray, own: np.ndarray, x: np.ndarray, key: np.ndarray, load: np.ndarray,
             mark: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
    """Rows that may be nearer are chosen by a matrix product, with room for its rounding; their distances are plain sums.

    A query never meets rows whose ``mark`` (their key, if not given) is its ``own``; ``at``: places of the queries in the block.
    """
    q2, x2 = (q * q).sum(1), (x * x).sum(1)
    rough = q2[:, None] + x2 - 2.0 * (q @ x.T)
    room = 1e-9 * (q2[:, None] + x2) + 1e-12
    near = rough - room <= ((nearest.worst if at is None else nearest.worst[at]) ** 2)[:, None]
    near &= own[:, None] != (key if mark is None else mark)
    query, row = np.nonzero(near)
    if len(query) > 4 * nearest.size * len(q):  # many: only the best by the rough distance, ties and rounding included
        rough[~near] = np.inf
        last = min(nearest.size, rough.shape[1]) - 1
        near &= rough - 2 * room <= np.partition(rough, last, 1)[:, [last]]
        query, row = np.nonzero(near)
    total = np.zeros(len(query))
    for j in range(q.shape[1]):
        gap = q[query, j] - x[row, j]
        total += gap * gap
    nearest.push(query if at is None else at[query], np.sqrt(total), key[row], load[row])


def _block_rows(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries (kind 0, sorted first) and the points they asked for (kind 1): the queries with their nearest."""
    block, parts, state = None, [], None

    def finished() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        nearest = state[0] if state else opened(rows)[0]
        ends = np.searchsorted(nearest.query, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, kind)) for v, kind in (
            (nearest.key, pa.int64()), (nearest.dist, pa.float64()), (nearest.load, pa.float64()))]
        seen = rows["seen"].to_numpy()
        columns = [_whole(rows[c]) for c in ("block", "grp", "qid", "own", "cell", "vec")]
        yield pa.RecordBatch.from_arrays([*columns, *lists, pa.array(seen + (state[3] if state else 0))],
                                         ["block", "grp", "qid", "own", "cell", "vec", "keys", "dists", "loads", "seen"])

    def opened(rows: pa.Table) -> list:
        """Nearest so far, query vectors, query keys, points seen."""
        nearest = _Nearest(rows.num_rows, size)
        held = rows["keys"].combine_chunks()
        counts = np.array([len(v) if v.is_valid else 0 for v in held], np.int64)
        if counts.sum():
            flat = [np.concatenate([np.asarray(v) for v in rows[c].to_pylist() if v]) for c in ("dists", "keys", "loads")]
            nearest.push(np.repeat(np.arange(rows.num_rows), counts), flat[0].astype(float), flat[1].astype(np.int64), flat[2].astype(float))
        return [nearest, _vectors(_whole(rows["vec"]), width), rows["own"].to_numpy(), 0]

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        borders = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *borders], [*borders, len(blocks)]):
            if a == b:
                continue
            if blocks[a] != block:
                yield from finished()
                block, parts, state = blocks[a], [], None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                parts.append(part)
                continue
            if not parts:
                continue  # points for a block without queries
            if state is None:
                state = opened(pa.Table.from_batches(parts).combine_chunks())
            for at in range(0, part.num_rows, SLICE):
                some = part.slice(at, SLICE)
                x = _vectors(some.column(some.schema.get_field_index("vec")), width)
                key = some.column(some.schema.get_field_index("own")).to_numpy(zero_copy_only=False)
                load = some.column(some.schema.get_field_index("load")).to_numpy(zero_copy_only=False)
                _compare(state[0], state[1], state[2], x, key, load)
                state[3] += some.num_rows
    yield from finished()


def _asked_rows(batches: Iterator[pa.RecordBatch], tree: CellTree, bounds: dict, visited: dict, size: int) -> Iterator[pa.RecordBatch]:
    """(block, grp, visit): cells that some query of a block still needs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, grp, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x, dists = _vectors(batch.column(3), tree.way.shape[1]), batch.column(4)
        counts = np.diff(dists.offsets.to_numpy())
        worst = np.full(len(block), np.inf)
        full = counts >= size
        worst[full] = dists.flatten().to_numpy(zero_copy_only=False)[np.cumsum(counts)[full] - 1]
        out = set()
        for g in np.unique(grp).tolist():
            rows, known = np.flatnonzero(grp == g), bounds[g]
            for at in range(0, len(rows), BLOCK):
                some = rows[at:at + BLOCK]
                # a little room, so that rounding of the bounds never leaves out a tie
                needed = known.below(x[some], tree) <= (worst[some] * (1 + 1e-9) + 1e-9)[:, None]
                for k in np.unique(block[some]).tolist():
                    mine = block[some] == k
                    own = int(cell[some][mine][0])
                    out |= {(k, g, int(c)) for c in known.cell[needed[mine].any(0)] if int(c) not in visited[g, own]}
        cells = sorted(out)
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))],
                                         ["block", "grp", "visit"])


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, key): a BIGINT per different id, in id order."""
    one = ids.select("id").distinct().withColumn("one", F.lit(1).cast("bigint"))
    return running_totals(one, [], ["id"], ["one"]).select("id", F.col("one_before").alias("key"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def knn_join(queries: DataFrame, ref: DataFrame, k: int, exclude_self: bool = False, vec_col: str = "vec",
             group: str | None = None, load: Column | None = None, with_candidates: bool = False) -> DataFrame:
    """(qid, rank, rid, dist) for the k nearest reference rows of every query.

    ``queries`` has (id, vec); ``ref`` has (id, vec, ...).  With
    ``exclude_self`` a reference row never matches the query with the same ID.
    Ties are broken by the reference ID.

    ``group`` names an int column of both sides: a join of its own per value, which comes back in ``grp``.  ``load`` is a
    number per reference row that comes back beside it; ``with_candidates`` adds how many rows a query was compared with.
    """
    spark = queries.sparkSession
    ship_package(spark)
    grp = F.lit(0) if group is None else F.col(group)
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    integral = isinstance(ref.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    carried = F.lit(0.0) if load is None else load.cast("double")
    points = ref.select(grp.cast("int").alias("grp"), F.col("id"), vec.alias("vec"), carried.alias("load"))
    asked = queries.select(grp.cast("int").alias("grp"), F.col("id").alias("qid"), vec.alias("vec"))
    none = F.lit(None).cast("bigint")
    if integral:
        points = points.withColumn("key", F.col("id").cast("bigint"))
        asked = asked.withColumn("own", F.col("qid").cast("bigint") if exclude_self else none)
    else:
        numbers = _written(_numbered(ref), "numbers")
        points = points.join(numbers, "id")
        mine = numbers.select(F.col("id").alias("_id"), F.col("key").alias("own"))
        asked = (asked.join(mine, F.col("qid") == F.col("_id"), "left").drop("_id") if exclude_self
                 else asked.withColumn("own", none))
    asked = asked.withColumn("own", F.coalesce("own", F.lit(np.iinfo(np.int64).min + 1)))
    points = _written(points.select("grp", "key", "load", "vec"), "points")

    # the index: cuts from a bounded sample, exact bounds from all points
    some = points.orderBy(F.xxhash64("key", "grp"), "key").limit(SAMPLE_ROWS).select("vec").toArrow()
    if not some.num_rows:
        kind = ref.schema["id"].dataType.simpleString()
        empty = asked.where("false").select("grp", "qid", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("rid"),
                                            F.lit(0.0).alias("dist"), F.lit(0.0).alias("load"), F.lit(0).cast("bigint").alias("candidates"))
        return _shaped(empty, group, load, with_candidates)
    width = len(some["vec"][0])
    sample = _vectors(_whole(some["vec"]), width)
    sizes = {r["grp"]: r["count"] for r in points.groupBy("grp").count().collect()}  # a row per group
    tree = cell_tree(sample, max(1, max(sizes.values()) // CELL_ROWS))
    held = spark.sparkContext.broadcast(tree)
    celled = points.mapInArrow(lambda b: _celled(b, held.value, 3), "grp int, key bigint, load double, vec array<double>, cell int")
    p = tree.axes.shape[1]
    parts = celled.select("grp", "cell", "vec").mapInArrow(
        lambda b: _bound_rows(b, held.value), "grp int, cell int, n bigint, radius double, low array<double>, high array<double>")
    known = parts.groupBy("grp", "cell").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.array(*[F.min(F.col("low")[i]) for i in range(p)]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(p)]).alias("high")).orderBy("grp", "cell").collect()  # groups x cells
    bounds = {g: CellBounds(*[np.array([r[c] for r in known if r["grp"] == g]) for c in ("cell", "n", "radius", "low", "high")])
              for g in sizes}

    # blocks of queries, by cell; groups without points have no neighbours
    counted = asked.mapInArrow(lambda b: _celled(b, held.value, 2),
                               T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())]))
    counted = _written(counted.where(F.col("grp").isin(list(sizes))), "queries")
    subs = {(r["grp"], r["cell"]): -(-r["count"] // BLOCK) for r in counted.groupBy("grp", "cell").count().collect()}
    kk = k + 1 if exclude_self else k
    visited: dict[tuple[int, int], set[int]] = {}
    visits = []
    for g, c in subs:
        b = bounds[g]
        nearby = np.argsort(((tree.pivots[b.cell] - tree.pivots[c]) ** 2).sum(1), kind="stable")
        enough = int(np.searchsorted(np.cumsum(b.n[nearby]), kk)) + 1
        visited[g, c] = {int(x) for x in b.cell[nearby[:enough]]}
        visits += [(g, c, s, x) for x in visited[g, c] for s in range(subs[g, c])]
    plan = spark.createDataFrame(visits, "grp int, cell int, sub int, visit int") if visits else spark.createDataFrame(
        [], "grp int, cell int, sub int, visit int")
    many = spark.createDataFrame([(g, c, n) for (g, c), n in subs.items()], "grp int, cell int, subs int")
    block = F.xxhash64("grp", "cell", "sub")
    # both small tables have a row or a few per group and cell (queries / BLOCK at most for the first)
    placed = counted.join(many, ["grp", "cell"]).withColumn(
        "sub", F.pmod(F.xxhash64("qid"), F.col("subs")).cast("int")).withColumn("block", block)
    longs, doubles = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<double>")
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("grp", T.IntegerType()),
                          T.StructField("qid", counted.schema["qid"].dataType), T.StructField("own", T.LongType()),
                          T.StructField("cell", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType())),
                          T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("dists", T.ArrayType(T.DoubleType())),
                          T.StructField("loads", T.ArrayType(T.DoubleType())), T.StructField("seen", T.LongType())])

    def compared(queries: DataFrame, visiting: DataFrame) -> DataFrame:
        """``visiting``: (block, grp, visit)."""
        q = queries.select("block", F.lit(0).alias("kind"), "grp", "qid", "own", "cell", "vec", "keys", "dists", "loads", "seen",
                           F.lit(0.0).alias("load"))
        kind = counted.schema["qid"].dataType
        to = visiting.select("block", F.col("grp").alias("_g"), F.col("visit").alias("_c"))
        x = celled.join(to, (F.col("grp") == F.col("_g")) & (F.col("cell") == F.col("_c"))).select(
            "block", F.lit(1).alias("kind"), "grp", F.lit(None).cast(kind).alias("qid"), F.col("key").alias("own"), "cell", "vec",
            longs.alias("keys"), doubles.alias("dists"), doubles.alias("loads"), F.lit(0).cast("bigint").alias("seen"), "load")
        rows = q.unionByName(x).repartition("block").sortWithinPartitions("block", "kind")
        return rows.mapInArrow(lambda b: _block_rows(b, k, width), shape)

    first = _written(compared(placed.select("*", longs.alias("keys"), doubles.alias("dists"), doubles.alias("loads"),
                                            F.lit(0).cast("bigint").alias("seen")),
                              plan.withColumn("block", block).select("block", "grp", "visit")), "nearest")
    table = spark.sparkContext.broadcast((bounds, visited))
    more = first.select("block", "grp", "cell", "vec", "dists").mapInArrow(
        lambda b: _asked_rows(b, held.value, *table.value, k), "block bigint, grp int, visit int").distinct()
    best = compared(first, more)
    rows = best.select("grp", "qid", "seen", F.posexplode(F.arrays_zip("keys", "dists", "loads")).alias("_at", "_n"))
    out = rows.select("grp", "qid", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_n.keys").alias("_key"),
                      F.col("_n.dists").alias("dist"), F.col("_n.loads").alias("load"), F.col("seen").alias("candidates"))
    if integral:
        out = out.withColumn("rid", F.col("_key").cast(ref.schema["id"].dataType))
    else:
        out = out.join(numbers.select(F.col("id").alias("rid"), F.col("key").alias("_key")), "_key")
    return _shaped(out, group, load, with_candidates)


def _shaped(rows: DataFrame, group: str | None, load: Column | None, with_candidates: bool) -> DataFrame:
    extra = ["grp"] * (group is not None) + ["qid", "rank", "rid", "dist"] + ["load"] * (load is not None)
    return rows.select(*extra, *["candidates"] * with_candidates)


# ---------------------------------------------------------------- every row against the rows of all other folds
@dataclass(frozen=True)
class FoldView:
    """How a fold prepares raw features: missing ones become ``fill`` (NaN: stay missing), then ``(x - mean) / scale``."""

    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale


@dataclass
class _Space:
    """The cells, in the space of the first fold, and what a distance there says about distances in other folds' spaces.

    Fold f scales feature j by s(j) / s_f(j) against the first fold and may fill a missing one elsewhere, which moves a row by
    at most |fill_f - fill|: a distance d here is at least ``shrink[f] * (d - 2 * shift[f])`` there.
    """

    tree: CellTree
    bounds: CellBounds | None
    views: dict[int, FoldView] | None
    shrink: dict[int, float]
    shift: dict[int, float]

    @classmethod
    def of(cls, views: Mapping[int, FoldView] | None) -> _Space:
        shrink, shift = {}, {}
        for f, v in (views or {}).items():
            first = views[min(views)]
            with np.errstate(invalid="ignore"):
                shrink[f] = float(np.nanmin(first.scale / v.scale, initial=1e300))
                moved = np.nan_to_num((np.nan_to_num(v.fill) - np.nan_to_num(first.fill)) / first.scale)
            shift[f] = float(np.sqrt((np.where(np.isnan(v.fill), 0.0, moved) ** 2).sum()))
        return cls(None, None, dict(views) if views else None, shrink, shift)

    def common(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(self.views[min(self.views)].of(x)) if self.views else x

    def reach(self, worst: np.ndarray, fold: int | None) -> np.ndarray:
        """How far off, in the space of the cells, a row nearer than ``worst`` may be; a little room for rounding."""
        out = worst * (1 + 1e-9) + 1e-9
        return out if fold is None else out / self.shrink[fold] + 2 * self.shift[fold]


class _Region:
    """The rows of a region as queries, in blocks of neighbours (of one fold, if folds have views), with their nearest."""

    def __init__(self, rows: dict[str, np.ndarray], space: _Space, size: int):
        view = rows["grp"] if space.views else np.zeros(len(rows["grp"]), np.int64)
        order = np.lexsort((rows["cell"], view))
        self.rows = {c: v[order] for c, v in rows.items()}
        self.space, self.size = space, size
        view, n = view[order], len(order)
        common = space.common(self.rows["vec"])
        self.common, self.along = common, common @ space.tree.axes
        borders = np.concatenate([[0], np.flatnonzero(view[1:] != view[:-1]) + 1, [n]])
        self.blocks = [(lo, min(lo + NEAR, b)) for a, b in zip(borders, borders[1:]) for lo in range(a, b, NEAR)]
        starts = [lo for lo, _ in self.blocks]
        self.low, self.high = np.minimum.reduceat(self.along, starts), np.maximum.reduceat(self.along, starts)
        self.folds = [int(view[lo]) if space.views else None for lo in starts]
        self.asked = [self.rows["vec"][lo:hi] if f is None else space.views[f].of(self.rows["vec"][lo:hi])
                      for (lo, hi), f in zip(self.blocks, self.folds)]
        self.nearest = [_Best(hi - lo, size) for lo, hi in self.blocks]
        self.reach = np.full(n, np.inf)
        self.farthest = np.full(len(self.blocks), np.inf)
        self._meet_own()

    def _meet_own(self) -> None:
        """The region's rows as points: each block first meets its own cells, so that bounds hold off most of the others."""
        cell = self.rows["cell"]
        order = np.argsort(cell, kind="stable")
        cells, starts = np.unique(cell[order], return_index=True)
        held = dict(zip(cells.tolist(), np.split(order, starts[1:])))
        own = [set(np.unique(cell[lo:hi]).tolist()) for lo, hi in self.blocks]
        for mine in (True, False):
            for c, at in held.items():
                some = np.array([b for b in range(len(self.blocks)) if (c in own[b]) == mine], np.int64)
                self.meet(c, {name: v[at] for name, v in self.rows.items()}, some)

    def needed(self, cell: int, b: int, at: int) -> np.ndarray:
        """Queries of block ``b`` that may have near rows in the cell (``at``: its place in the bounds)."""
        (lo, hi), known = self.blocks[b], self.space.bounds
        gaps = np.maximum(0.0, np.maximum(known.low[at] - self.along[lo:hi], self.along[lo:hi] - known.high[at]))
        far = np.sqrt(((self.common[lo:hi] - self.space.tree.pivots[cell]) ** 2).sum(1)) - known.radius[at]
        return np.flatnonzero(np.maximum(np.sqrt((gaps * gaps).sum(1)), far) <= self.reach[lo:hi])

    def blocks_near(self, at: np.ndarray) -> np.ndarray:
        """(blocks, cells): whether the boxes of a block and of a cell are within the block's reach."""
        known, out = self.space.bounds, np.empty((len(self.blocks), len(at)), bool)
        for b in range(len(self.blocks)):
            gaps = np.maximum(0.0, np.maximum(known.low[at] - self.high[b], self.low[b] - known.high[at]))
            out[b] = np.sqrt((gaps * gaps).sum(1)) <= self.farthest[b]
        return out

    def meet(self, cell: int, points: dict[str, np.ndarray], some: np.ndarray | None = None) -> None:
        """Points of one cell come by, for all blocks or some of them."""
        at = int(np.searchsorted(self.space.bounds.cell, cell))
        close = np.flatnonzero(self.blocks_near(np.array([at]))[:, 0])
        for start in range(0, len(points["key"]), SLICE):
            part = {c: points[c][start:start + SLICE] for c in ("grp", "key", "load", "vec")}
            seen: dict[int, tuple] = {}
            for b in (close if some is None else np.intersect1d(close, some)).tolist():
                asking = self.needed(cell, b, at)
                if not len(asking):
                    continue
                (lo, hi), f = self.blocks[b], self.folds[b]
                if f is None:
                    x, key, load, mark = part["vec"], part["key"], part["load"], part["grp"]
                else:
                    if f not in seen:
                        other = part["grp"] != f
                        seen[f] = self.space.views[f].of(part["vec"][other]), part["key"][other], part["load"][other], part["grp"][other]
                    x, key, load, mark = seen[f]
                _compare(self.nearest[b], self.asked[b][asking], self.rows["grp"][lo:hi][asking], x, key, load, mark, asking)
                self.reach[lo:hi] = self.space.reach(self.nearest[b].worst, f)
                self.farthest[b] = self.reach[lo:hi].max()

    def wanted(self) -> list[int]:
        """Cells that some query may need, those of the region included."""
        known = self.space.bounds
        close = self.blocks_near(np.arange(len(known.cell)))
        return [int(known.cell[at]) for at in np.flatnonzero(close.any(0)).tolist()
                if any(len(self.needed(int(known.cell[at]), b, at)) for b in np.flatnonzero(close[:, at]).tolist())]

    def results(self) -> Iterator[pa.RecordBatch]:
        for (lo, hi), nearest in zip(self.blocks, self.nearest):
            ends = pa.array(np.concatenate([[0], np.cumsum(nearest.held.sum(1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[nearest.held], kind)) for v, kind in (
                (nearest.keys, pa.int64()), (nearest.dists, pa.float64()), (nearest.loads, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[pa.array(self.rows[c][lo:hi]) for c in ("grp", "key", "kept")], *lists],
                                             ["grp", "own", "kept", "keys", "dists", "loads"])


def _numbers(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    at = {name: batch.column(batch.schema.get_field_index(name)) for name in ("grp", "key", "load", "kept", "cell", "vec")}
    return {name: _vectors(v, width) if name == "vec" else v.to_numpy(zero_copy_only=False) for name, v in at.items()}


def _regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(region, kind, cell, rows) from rows sorted by (region, kind, cell)."""
    for batch in batches:
        marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if not batch.num_rows:
            continue
        changed = (marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1])
        changed |= (marks[1][1:] == 1) & (marks[2][1:] != marks[2][:-1])
        borders = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(borders, borders[1:]):
            yield int(marks[0][a]), int(marks[1][a]), int(marks[2][a]), batch.slice(a, b - a)


def _opened(parts: list[pa.RecordBatch], space: _Space, size: int, width: int) -> _Region:
    some = [_numbers(p, width) for p in parts]
    return _Region({c: np.concatenate([p[c] for p in some]) for c in some[0]}, space, size)


def _wanted_rows(batches: Iterator[pa.RecordBatch], space: _Space, homes: dict[int, list[int]], size: int,
                 width: int) -> Iterator[pa.RecordBatch]:
    """(to, cell, home): the cells, and their parts in other regions, that each region asks for."""
    def asked(region: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = [(region, c, h) for c in _opened(parts, space, size, width).wanted() for h in homes[c] if h != region]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32()) for i in range(3)], ["to", "cell", "home"])

    region, parts = None, []
    for r, _, _, rows in _regions_of(batches):
        if r != region and parts:
            yield asked(region, parts)
            parts = []
        region = r
        parts.append(rows)
    if parts:
        yield asked(region, parts)


def _nearest_rows(batches: Iterator[pa.RecordBatch], space: _Space, size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a region (kind 0, sorted first), then points of the cells it asked for (kind 1): the rows with their nearest."""
    region, parts, held = None, [], None
    for r, kind, cell, rows in _regions_of(batches):
        if r != region:
            if parts:
                yield from (held or _opened(parts, space, size, width)).results()
            region, parts, held = r, [], None
        if kind == 0:
            parts.append(rows)
        elif parts:
            held = held or _opened(parts, space, size, width)
            held.meet(cell, _numbers(rows, width))
    if parts:
        yield from (held or _opened(parts, space, size, width)).results()


def knn_out_of_folds(rows: DataFrame, k: int, fold_col: str = "fold", load: Column | None = None,
                     views: Mapping[int, FoldView] | None = None, keep: str | None = None) -> DataFrame:
    """(grp, qid, rank, rid, dist, load?, <keep>?) for the k nearest rows, among those of all other folds, of every row.

    ``rows`` has (id, vec, <fold_col>, ...).  Ties are broken by the id.  With ``views``, ``vec`` holds raw features, null if
    missing, and the distances of a fold's rows are those after the fold's own preparation.  Rows without a fold or a vector
    have no neighbours and are none.
    """
    spark = rows.sparkSession
    ship_package(spark)
    integral = isinstance(rows.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if integral:
        keyed = rows.withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(NO_KEY)))
    else:
        numbers = _written(_numbered(rows), "numbers")
        keyed = rows.join(numbers, "id")
    held = keyed.where(F.col(fold_col).isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).select(
        F.col(fold_col).cast("int").alias("grp"), "key", (F.lit(0.0) if load is None else load.cast("double")).alias("load"),
        (F.lit(0) if keep is None else F.coalesce(F.col(keep).cast("int"), F.lit(NO_VALUE))).alias("kept"), "vec")
    if views is None:  # a vector with a missing component is at no distance from any other
        held = held.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    sizes = {r["grp"]: r["count"] for r in held.groupBy("grp").count().collect()}  # a row per fold
    total = sum(sizes.values())
    if not total:
        out = held.select("grp", F.col("key").alias("own"), "kept", F.lit(0).alias("rank"), F.col("key").alias("_key"),
                          F.lit(0.0).alias("dist"), "load")
    else:
        width = held.select(F.size("vec")).first()[0]
        space = _Space.of(views)
        every = max(1, total * 8 * width // SAMPLE_BYTES)
        some = held.where(F.pmod(F.xxhash64("key", "grp"), F.lit(every)) == 0).select("vec").toArrow()
        sample = space.common(_vectors(_whole(some["vec"]), width))
        space.tree = cell_tree(sample, max(1, total // CELL_ROWS))
        p = space.tree.axes.shape[1]
        cuts = spark.sparkContext.broadcast(space)
        shape = T.StructType([*held.schema.fields, T.StructField("cell", T.IntegerType())])
        celled = _written(held.mapInArrow(lambda b: _celled(b, cuts.value.tree, 4, cuts.value), shape), "points")
        parts = celled.select(F.lit(0).alias("grp"), "cell", "vec").mapInArrow(
            lambda b: _bound_rows(b, cuts.value.tree, cuts.value),
            "grp int, cell int, n bigint, radius double, low array<double>, high array<double>")
        known = parts.groupBy("cell").agg(
            F.sum("n").alias("n"), F.max("radius").alias("radius"), F.array(*[F.min(F.col("low")[i]) for i in range(p)]).alias("low"),
            F.array(*[F.max(F.col("high")[i]) for i in range(p)]).alias("high")).orderBy("cell").collect()  # a row per cell
        space.bounds = CellBounds(*[np.array([r[c] for r in known]) for c in ("cell", "n", "radius", "low", "high")])
        # regions: runs of neighbouring cells; a cell larger than that (one vector in many rows) is dealt to several
        cap = min(REGION_CAP, REGION_BYTES // (8 * (2 * width + p + 3 * k)))
        most = min(cap, max(REGION_ROWS, 2 * total // (3 * max(1, spark.sparkContext.defaultParallelism))))
        plan, homes, region, filled = [], {}, 0, 0
        for c, n in zip(space.bounds.cell.tolist(), space.bounds.n.tolist()):
            subs = -(-n // most)
            if filled and filled + n > most:
                region, filled = region + 1, 0
            plan.append((c, region, subs))
            homes[c] = list(range(region, region + subs))
            region, filled = (region, filled + n) if subs == 1 else (region + subs, 0)
        regions = region + bool(filled)
        places = F.broadcast(spark.createDataFrame(plan, "cell int, first int, subs int"))  # a row per cell
        placed = celled.join(places, "cell").select(
            (F.col("first") + F.pmod(F.xxhash64("key"), F.col("subs"))).cast("int").alias("region"), F.lit(0).alias("kind"), "cell",
            "grp", "key", "load", "kept", "vec")
        table = spark.sparkContext.broadcast((space, homes))
        visits = _written(
            placed.repartitionByRange(regions, "region").sortWithinPartitions("region", "kind", "cell").mapInArrow(
                lambda b: _wanted_rows(b, *table.value, k, width), "to int, cell int, home int"), "visits")
        going = visits.select("to", F.col("cell").alias("_c"), F.col("home").alias("_h"))
        points = placed.join(going, (F.col("cell") == F.col("_c")) & (F.col("region") == F.col("_h"))).select(
            F.col("to").alias("region"), F.lit(1).alias("kind"), "cell", "grp", "key", "load", "kept", "vec")
        met = placed.unionByName(points).repartitionByRange(regions, "region").sortWithinPartitions("region", "kind", "cell")
        best = met.mapInArrow(lambda b: _nearest_rows(b, table.value[0], k, width),
                              "grp int, own bigint, kept int, keys array<bigint>, dists array<double>, loads array<double>")
        out = best.select("grp", "own", "kept", F.posexplode(F.arrays_zip("keys", "dists", "loads")).alias("_at", "_n")).select(
            "grp", "own", "kept", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_n.keys").alias("_key"),
            F.col("_n.dists").alias("dist"), F.col("_n.loads").alias("load"))
    if integral:
        kind = rows.schema["id"].dataType
        out = out.withColumns({"qid": F.nullif(F.col("own"), F.lit(NO_KEY)).cast(kind), "rid": F.nullif(F.col("_key"), F.lit(NO_KEY)).cast(kind)})
    else:
        name = lambda a, b: numbers.select(F.col("id").alias(a), F.col("key").alias(b))
        out = out.join(name("qid", "own"), "own").join(name("rid", "_key"), "_key")
    return out.select("grp", "qid", "rank", "rid", "dist", *["load"] * (load is not None),
                      *[F.nullif(F.col("kept"), F.lit(NO_VALUE)).alias(keep or "kept")] * (keep is not None))


def knn_votes(queries: DataFrame, ref: DataFrame, candidates: Sequence[tuple[int, str]], label_col: str = "target",
              group: str | None = None) -> DataFrame:
    """(grp?, id, candidate, score, prediction) for every (k, weights) of ``candidates``, from one join at the largest k.

    The score is the share of positive labels among the k nearest, or the share weighted by 1/distance (rows at distance 0,
    if there are any, alone).  The ids of ``ref`` have to be unique within a group.
    """
    nn = knn_join(queries, ref, max(k for k, _ in candidates), group=group, load=F.col(label_col))
    voted = _voted(nn, candidates, ["grp", "qid"] if group else ["qid"])
    return voted.select(*["grp"] * (group is not None), F.col("qid").alias("id"), "candidate", "score",
                        (F.col("score") > 0.5).cast("int").alias("prediction"))


def votes_out_of_folds(rows: DataFrame, candidates: Sequence[tuple[int, str]], label_col: str = "target", fold_col: str = "fold",
                       views: Mapping[int, FoldView] | None = None, keep: str | None = None) -> DataFrame:
    """(grp, id, <keep>, candidate, score, prediction): ``knn_votes`` of every row among the rows of all other folds.

    ``keep``: an INT column of the rows that comes back beside their scores, a row for each of them.
    """
    nn = knn_out_of_folds(rows, max(k for k, _ in candidates), fold_col, F.col(label_col), views, keep)
    kept = [] if keep is None else [F.collect_list(F.when(F.col("rank") == 1, F.struct(keep))).alias("_kept")]
    voted = _voted(nn, candidates, ["grp", "qid"], kept)
    if keep is not None:  # rows of one id share their votes and are rows of their own
        voted = voted.select("grp", "qid", "candidate", "score", F.inline("_kept"))
    return voted.select("grp", F.col("qid").alias("id"), *[keep] * (keep is not None), "candidate", "score",
                        (F.col("score") > 0.5).cast("int").alias("prediction"))


def _voted(nn: DataFrame, candidates: Sequence[tuple[int, str]], keys: list[str], kept: Sequence[Column] = ()) -> DataFrame:
    """(keys, candidate, score) from a join's (keys, rank, dist, load), and aggregates to ``kept`` beside."""
    zero, y = F.col("dist") == 0, F.col("load")
    sums, scores = [], []
    for i, (k, weights) in enumerate(candidates):
        inside = F.col("rank") <= k
        if weights == "distance":
            far = F.when(inside & ~zero, 1.0 / F.col("dist"))
            sums += [F.count_if(inside & zero).alias(f"z{i}"), F.sum(F.when(inside & zero, y)).alias(f"zy{i}"),
                     F.sum(far).alias(f"f{i}"), F.sum(far * y).alias(f"fy{i}")]
            share = F.when(F.col(f"z{i}") > 0, F.col(f"zy{i}") / F.nullif(F.col(f"z{i}"), F.lit(0))).otherwise(
                F.col(f"fy{i}") / F.col(f"f{i}"))
        else:
            sums += [F.count_if(inside).alias(f"n{i}"), F.sum(F.when(inside, y)).alias(f"y{i}")]
            share = F.col(f"y{i}") / F.col(f"n{i}")
        scores.append(F.struct(F.lit(i).alias("candidate"), share.alias("score")))
    return nn.groupBy(*keys).agg(*sums, *kept).select(*keys, *["_kept"] * bool(kept), F.inline(F.array(*scores)))


def knn_scores(queries: DataFrame, ref: DataFrame, k: int, weights: str = "uniform",
               label_col: str = "target") -> DataFrame:
    """(id, score, prediction) of one k and one weighting."""
    return knn_votes(queries, ref, [(k, weights)], label_col).drop("candidate")
