"""Exact top-k search by inner product over blocks of vectors, each with a cover tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widemetrics.llm import covertree
from widemetrics.llm.common import partitions, saved

#: Components are floor(SCALE * x).
SCALE = 256

#: Vectors in a block, queries in a group, and groups compared with a block in one task.
BLOCK = 4096
GROUP = 256
GROUPS = 64

#: Pivots that a cell is split by, and the vectors, smallest hashes first, that they are chosen from.
PIVOTS = 256
SAMPLE = 4096

#: Levels of cells below one another; numbers of cells of so many levels fit 64 bits.
LEVELS = 7


def quantised(vectors: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """(vec_id, dim, v, query): the vectors that take part, as little-endian 64-bit integers."""
    read = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.col(vector).cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, out = [], [], []
            for i, values in enumerate(batch.column(2)):
                x = values.values
                if x.null_count or not len(x):
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                if np.abs(x).max() >= 2.0**63 / SCALE:
                    raise OverflowError(f"vector {batch.column(0)[i]}: {SCALE} x does not fit 64 bits")
                rows.append(i)
                dims.append(len(x))
                out.append(np.floor(SCALE * x).astype("<i8").tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at),
                    pa.array(dims, pa.int32()), pa.array(out, pa.binary()),
                ],
                names=["vec_id", "query", "dim", "v"],
            )

    return read.mapInArrow(run, "vec_id bigint, query boolean, dim int, v binary")


def _matrix(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = values.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1).astype(np.float64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in floats where no sum can pass 2**53, else in 64-bit integers, and in Python's
    for the rows where a sum could pass those."""
    large, other = np.abs(a).max(axis=1, initial=0) * a.shape[1], np.abs(b).max(axis=1, initial=0)
    most = large.max(initial=0) * other.max(initial=0)
    if most < 2.0**53:
        return a @ b.T
    x, y = a.astype(np.int64), b.astype(np.int64)
    if most < 2.0**62:
        return x @ y.T
    out = np.empty((len(a), len(b)), object)
    fine = other * large.max(initial=0) < 2.0**62
    out[:, fine] = x @ y[fine].T
    few = large * other.max(initial=0) < 2.0**62
    rest = np.flatnonzero(~fine)
    out[np.ix_(few, rest)] = x[few] @ y[rest].T
    out[np.ix_(~few, rest)] = x[~few].astype(object) @ y[rest].astype(object).T
    return out


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Points of a bounded sample, each the farthest from those before."""
    chosen = [0]
    distance = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)) and distance.max() > 0:
        chosen.append(int(np.argmax(distance)))
        distance = np.minimum(distance, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, dim, v, query, candidate): the queries, and apart from them the candidates.

    Of equal vectors only those of the k + 1 smallest ids can be among the k
    best of any query, and of equal rows only k, so a vector that a third of all
    rows hold is no more work than others. A query is one, however often its row
    is there.
    """
    once = rows.groupBy("dim", "v", "vec_id").agg(F.max("query").alias("query"), F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    first = once.withColumn("place", place).filter(F.col("place") <= k + 1)
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))).alias("n")
    candidates = first.select("vec_id", "dim", "v", F.lit(False).alias("query"), F.lit(True).alias("candidate"), copies)
    asking = once.filter("query").select("vec_id", "dim", "v", "query", F.lit(False).alias("candidate"))
    return candidates.drop("n").unionByName(asking)


def _split(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of cells larger than a block, each in the cell of its nearest pivot; and those
    cells with their pivot and reach. Cells of one point only are not split."""
    large = sizes.filter(F.col("rows") > BLOCK)
    first = Window.partitionBy("dim", "cell").orderBy(F.xxhash64("vec_id"), "v")
    drawn = (
        rows.select("dim", "cell", "vec_id", "v").withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= SAMPLE).join(large, ["dim", "cell"])
    )

    def choose(group: pa.Table) -> pa.Table:
        n = min(PIVOTS, 1 + group.column("rows")[0].as_py() // BLOCK)
        group = group.sort_by([("vec_id", "ascending"), ("v", "ascending")])
        chosen = _pivots(_matrix(group.column("v")), n)
        several = len(chosen) > 1
        return pa.table(
            {
                **{c: group.column(c).slice(0, int(several)) for c in ("dim", "cell", "rows")},
                "pivots": pa.array([chosen.tobytes()] * several, pa.binary()),
            }
        )

    pivots = saved(
        drawn.groupBy("dim", "cell").applyInArrow(choose, "dim int, cell bigint, rows bigint, pivots binary"),
        "topk-pivots",
    )
    # A cell may hold most vectors: it is worked on in chunks, each with the pivots.
    chunks = F.ceil(F.col("rows") / (4 * BLOCK)).cast("bigint")
    told = pivots.select(
        "dim", "cell", "pivots", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk")
    )
    chunk = F.pmod(F.xxhash64("v", "vec_id"), chunks).alias("chunk")
    going = rows.join(pivots.select("dim", "cell", "rows"), ["dim", "cell"]).select(*rows.columns, chunk)
    on, names = ["dim", "cell", "chunk"], rows.columns

    def nearest(own: pa.Table, known: pa.Table) -> pa.Table:
        own = own.select(names)
        if not own.num_rows:
            return own
        x = _matrix(own.column("v"))
        p = np.frombuffer(known.column("pivots")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        near = np.argmin((p**2).sum(axis=1) - 2 * (x @ p.T), axis=1)
        cell = own.column("cell")[0].as_py() * (PIVOTS + 1) + 1 + near
        gap = np.linalg.norm(x - p[near], axis=1)
        own = own.set_column(own.schema.get_field_index("cell"), "cell", pa.array(cell, pa.int64()))
        return own.set_column(own.schema.get_field_index("gap"), "gap", pa.array(gap))

    moved = saved(going.groupBy(*on).cogroup(told.groupBy(*on)).applyInArrow(nearest, rows.schema), "topk-cells")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pivot."""
        for batch in batches:
            out = []
            for dim, cell, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "pivots"))):
                for i, p in enumerate(np.frombuffer(data, np.float64).reshape(-1, dim)):
                    out.append((dim, cell, cell * (PIVOTS + 1) + 1 + i, p.tobytes()))
            columns = list(zip(*out)) or [()] * 4
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["dim", "parent", "cell", "middle"]
            )

    centres = pivots.select("dim", "cell", "pivots").mapInArrow(
        each, "dim int, parent bigint, cell bigint, middle binary"
    )
    reach = moved.groupBy("dim", "cell").agg(F.max("gap").alias("reach"), F.count("*").alias("rows"))
    return moved, centres.join(reach, ["dim", "cell"])


def _blocks(all_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with cell and part, cells): vectors in cells of near ones, level by level until a cell
    fits a block or holds one point only; larger ones in parts of about BLOCK rows.

    cells is the tree of them: parent, middle, reach, parts (0 of one that was split).
    """
    rows = all_rows.select("*", F.lit(0).cast("bigint").alias("cell"), F.lit(0.0).alias("gap"))
    done: DataFrame | None = None
    tree: DataFrame | None = None
    for _ in range(LEVELS):
        sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("rows"))
        moved, cells = _split(rows, sizes)
        cells = saved(cells, "topk-tree")
        split = cells.select("dim", F.col("parent").alias("cell")).distinct()
        stay = rows.join(split, ["dim", "cell"], "left_anti")
        done = stay if done is None else done.unionByName(stay)
        tree = cells if tree is None else tree.unionByName(cells)
        rows = moved
        if cells.isEmpty():
            break
    done = done.unionByName(rows)
    parts = done.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    # A row for each cell; equal cells of very many parts stay in one hash range of theirs.
    parted = done.drop("gap").join(parts, ["dim", "cell"])
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("part")
    cells = tree.join(parts, ["dim", "cell"], "left").fillna({"parts": 0})
    return parted.select("vec_id", "query", "dim", "v", "candidate", "cell", part), cells


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Components are floor(256 x). Vectors that are null, empty, hold a null or
    a number that is not finite, or have no id take no part; only vectors of
    one length are compared. Scores are exact; a component or a score that does
    not fit 64 bits stops the query, as it does in SQL. Ties go to the smaller vec_id. Rows that repeat an
    id are candidates each, but not for a query of that id; queries that repeat
    id and vector are one.

    Vectors are put near pivots, level by level, and cut into blocks, queries
    into groups. Each group searches the blocks of its own cell first. That
    gives every query a kth score to beat. Groups then walk down the tree of
    cells and meet a cell only if the two covering radii leave room for a
    product that reaches the worst of the group's. In a task a block's cover
    tree is walked together with those of the groups that meet it; a block is
    copied for every GROUPS of them and for none that it does not meet.
    """
    spark = vectors.sparkSession
    numbers = saved(_candidates(quantised(vectors, key, vector, is_query), k), "topk-vectors")
    placed, cells = _blocks(numbers)
    placed, cells = saved(placed, "topk-blocks"), saved(cells, "topk-cells")
    data = placed.filter("candidate").select("dim", "cell", "part", "vec_id", "v")
    queries = placed.filter("query").select("dim", "cell", "vec_id", "v").distinct()

    def pack(rows: pa.Table) -> pa.Table:
        """Queries of one cell, in groups of near ones."""
        rows = rows.sort_by([("vec_id", "ascending"), ("v", "ascending")])
        x = _matrix(rows.column("v"))
        _, order = covertree.grown(x)
        out = []
        for i in range(0, len(order), GROUP):
            own = order[i : i + GROUP]
            centre = x[own].mean(axis=0)
            out.append(
                {
                    "dim": rows.column("dim")[0].as_py(),
                    "cell": rows.column("cell")[0].as_py(),
                    "share": rows.column("share")[0].as_py(),
                    "number": i // GROUP,
                    "ids": [rows.column("vec_id")[int(j)].as_py() for j in own],
                    "v": b"".join(rows.column("v")[int(j)].as_py() for j in own),
                    "centre": centre.tobytes(),
                    "radius": float(np.linalg.norm(x[own] - centre, axis=1).max()),
                }
            )
        return pa.Table.from_pylist(out, group_type)

    group_type = pa.schema(
        [
            ("dim", pa.int32()), ("cell", pa.int64()), ("share", pa.int64()), ("number", pa.int64()),
            ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("centre", pa.binary()),
            ("radius", pa.float64()),
        ]
    )
    # A cell's queries may be a third of all: shares of a bounded mean size are grouped apart.
    many = queries.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (16 * GROUP)).alias("shares"))
    shared = queries.join(many, ["dim", "cell"])
    shared = shared.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares"))).drop("shares")
    grouped = shared.groupBy("dim", "cell", "share").applyInArrow(
        pack,
        "dim int, cell bigint, share bigint, number bigint, ids array<bigint>, v binary, "
        "centre binary, radius double",
    )
    groups = saved(grouped.withColumn("group", F.monotonically_increasing_id()), "topk-groups")

    blocks = saved(data.select("dim", "cell", "part").distinct(), "topk-balls")

    def search(rows: pa.Table, met: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and met.num_rows:
            x = _matrix(rows.column("v"))
            tree, order = covertree.grown(x)
            x, ids = x[order], rows.column("vec_id").to_numpy()[order]
            for g, own, v, floor in zip(
                *(met.column(c).to_pylist() for c in ("group", "ids", "v", "floor"))
            ):
                q = np.frombuffer(v, "<i8").reshape(len(own), -1).astype(np.float64)
                least = np.array([-np.inf if f is None else f for f in floor or [None] * len(own)])
                best = covertree.searched(q, np.array(own), tree, x, ids, k, least, _product)
                for i, held in enumerate(best.scores):
                    found += [(g, i, own[i], vec, -score) for score, vec in held]
        columns = list(zip(*found)) or [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["group", "place", "query_id", "vec_id", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def met_by(pairs: DataFrame) -> DataFrame:
        """The best of each query in each block that its group is paired with."""
        block, on = ["dim", "cell", "part"], ["dim", "cell", "part", "slice"]
        many = pairs.groupBy(*block).agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("slices"))
        slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        sliced = data.join(many.select(*block, slices), block)
        own = F.pmod(F.xxhash64("group"), F.col("slices")).cast("int").alias("slice")
        paired = pairs.join(many, block).select(*pairs.columns, own)
        return (
            sliced.groupBy(*on)
            .cogroup(paired.groupBy(*on))
            .applyInArrow(search, "group bigint, place int, query_id bigint, vec_id bigint, score bigint")
        )

    def ranked(found: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.lit(None).cast("array<bigint>")
    own_cell = groups.select("dim", "cell", "group", "ids", "v").join(
        blocks, ["dim", "cell"]
    )
    first = saved(
        met_by(own_cell.select("dim", "cell", "part", "group", "ids", "v", none.alias("floor"))),
        "topk-first",
    )
    kth = (
        ranked(first, ["group", "place"])
        .groupBy("group", "place")
        .agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    )
    floors = kth.groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors")
    )
    known = groups.join(floors, "group", "left").withColumn(
        "floor", F.expr("transform(sequence(0, size(ids) - 1), i -> element_at(floors, cast(i as int)))")
    )
    worst = F.when(
        F.forall("floor", lambda f: f.isNotNull()), F.array_min("floor").cast("double")
    ).otherwise(F.lit(float("-inf")))
    known = saved(known.select("dim", "cell", "group", "ids", "v", "centre", "radius", "floor",
                               worst.alias("worst")), "topk-known")

    pairs = _in_reach(known.select("dim", F.col("cell").alias("home"), "group", "centre", "radius", "worst"), cells)
    pairs = pairs.join(blocks, ["dim", "cell"])
    rest = met_by(
        pairs.join(known.select("group", "ids", "v", "floor"), "group").select(
            "dim", "cell", "part", "group", "ids", "v", "floor"
        )
    )
    return ranked(first.unionByName(rest), ["group", "place"]).select(
        "query_id", "rank", "vec_id", "score"
    )


def _in_reach(balls: DataFrame, cells: DataFrame) -> DataFrame:
    """(dim, cell, group): the cells other than its own that may hold a product worth having for a
    group. Groups go down the tree from the root, level by level, with what is left of it."""
    spark = balls.sparkSession
    below = saved(
        cells.groupBy("dim", "parent").agg(
            F.collect_list(F.struct("cell", "middle", "reach", (F.col("parts") > 0).alias("leaf"))).alias("cells")
        ),
        "topk-below",
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, met, leaf = [], [], []
            for row, (home, centre, s, worst, own) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("home", "centre", "radius", "worst", "cells")))
            ):
                q = np.frombuffer(centre, np.float64)
                p = np.array([np.frombuffer(c["middle"], np.float64) for c in own])
                r = np.array([c["reach"] for c in own])
                a, b = np.linalg.norm(q), np.linalg.norm(p, axis=1)
                bound = p @ q + a * r + b * s + r * s
                slack = 1e-6 * (1 + np.abs(bound)) + 1e-12 * (a + s) * (b + r)
                for i in np.flatnonzero(bound + slack >= worst):
                    if own[i]["cell"] != home:
                        at.append(row)
                        met.append(own[i]["cell"])
                        leaf.append(own[i]["leaf"])
            kept = batch.select(ball).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(met, pa.int64()), pa.array(leaf, pa.bool_())], names=[*ball, "cell", "leaf"]
            )

    ball = ["dim", "home", "group", "centre", "radius", "worst"]
    schema = balls.select(*ball).withColumns({"cell": F.lit(0).cast("bigint"), "leaf": F.lit(True)}).schema
    found: DataFrame | None = None
    going = balls.select(*ball, F.lit(0).cast("bigint").alias("cell"))
    salts = partitions(spark)
    for _ in range(LEVELS):
        # All groups meet the root and many the cells near it: those few go to several tasks.
        salted = below.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1))))
        asked = going.withColumn("salt", F.pmod("group", F.lit(salts))).withColumnRenamed("cell", "parent")
        met = saved(asked.join(salted, ["dim", "parent", "salt"]).mapInArrow(meet, schema), "topk-met")
        leaves = met.filter("leaf").select("dim", "cell", "group")
        found = leaves if found is None else found.unionByName(leaves)
        going = met.filter("not leaf").drop("leaf")
        if going.isEmpty():
            break
        salts = max(1, salts // PIVOTS)
    return found
