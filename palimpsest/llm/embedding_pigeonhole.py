"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors x, y with cosine >= c have |x - y|**2 <= 2 - 2c. After a fixed random rotation the coordinates are
split into blocks; by the pigeonhole principle at least one block holds no more than its proportional share of
that squared distance. So each block is range-joined under its share (grid cells as wide as the radius, each
vector also visiting the neighbour cells before its own), and every candidate is verified by the full cosine in
double precision. A pair counts in the first block that proposes it, so no list of pairs is ever exchanged:
tasks return counts of links and a spanning forest.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, first_id, named_by
from .session import cut
from .streams import by_group

BLOCK = 16
#: Vectors of a cell that meet in one task at most; larger cells are joined chunk by chunk.
CHUNK = 16384
#: Vectors on a side of a tile of distances, small enough to stay in a core's cache.
TILE = 512
_SLACK = 1e-6


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix: spreads any direction's energy evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK, d)) for i in range(0, d, BLOCK)]


def radii(d: int, cosine: float) -> list[float]:
    """Squared distance that each block may hold."""
    return [(2 - 2 * cosine + _SLACK) * (b - a) / d for a, b in blocks(d)]


def _prepare(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, key (null where the vector links with nothing), vec, rot: one row for each row."""

    def run(batches):
        for b in batches:
            keys, vecs, rots = [], [], []
            for v in b.column("v").to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, dtype=np.float64) + 0.0
                    top = np.abs(x).max()
                    x = None if not np.isfinite(x).all() or top == 0 else x / 2.0 ** np.floor(np.log2(top)) if not 1e-100 < top < 1e100 else x
                if x is None:
                    keys.append(None), vecs.append(None), rots.append(None)
                    continue
                short = x.astype(np.float32)
                raw = short.tobytes() if (short == x).all() else x.tobytes()
                keys.append(hashlib.blake2b(raw + len(x).to_bytes(8, "big"), digest_size=16).digest())
                vecs.append(raw)
                rots.append(rotated(x).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(rots, pa.binary())], names=["vec_id", "key", "vec", "rot"])

    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return own.mapInArrow(run, "vec_id bigint, key binary, vec binary, rot binary")


_rotations: dict[int, np.ndarray] = {}


def rotation_of(d: int) -> np.ndarray:
    if d not in _rotations:
        _rotations[d] = rotation(d)
    return _rotations[d]


def rotated(x: np.ndarray) -> np.ndarray:
    """The rotated unit vector. One vector at a time, so that every task gets the same bits for it."""
    return ((x / np.linalg.norm(x)) @ rotation_of(len(x))).astype(np.float32)


def _cells(rot: np.ndarray, cosine: float, grid: int):
    """(block, own cell, neighbour cells that come before it) for each block; cells are tuples of integers."""
    d = len(rot)
    for k, ((a, b), budget) in enumerate(zip(blocks(d), radii(d, cosine))):
        own = tuple(int(x) for x in np.floor(rot[a : min(b, a + grid)] / np.float32(budget**0.5 * 1.0001)))
        before = [c for c in (tuple(x + y for x, y in zip(own, s)) for s in itertools.product((-1, 0, 1), repeat=len(own))) if c < own]
        yield k, own, before


def _name(d: int, block: int, cell: tuple[int, ...]) -> str:
    return f"{d}.{block}." + ".".join(map(str, cell))


def _counts(classes: DataFrame, cosine: float, grid: int) -> dict[str, list[int]]:
    """Residents and visitors of each cell. Coordinates of unit vectors bound the number of cells."""

    def run(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for r in b.column("rot").to_pylist():
                rot = np.frombuffer(r, dtype=np.float32)
                for k, own, before in _cells(rot, cosine, grid):
                    seen.setdefault(_name(len(rot), k, own), [0, 0])[0] += 1
                    for c in before:
                        seen.setdefault(_name(len(rot), k, c), [0, 0])[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["cell", "home", "visit"])

    found = classes.select("rot").mapInArrow(run, "cell string, home bigint, visit bigint").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("visit").alias("visit"))
    return {r["cell"]: [r["home"], r["visit"]] for r in found.collect()}


def _deal(classes: DataFrame, counts: dict[str, list[int]], cosine: float, grid: int) -> DataFrame:
    """Rows (task, side, node, m, vec): left rows of a task meet its right rows; side 2 meets itself."""
    parts = {c: (-(-h // CHUNK), -(-v // CHUNK)) for c, (h, v) in counts.items() if h}

    def run(batches):
        for b in batches:
            task, side, row = [], [], []
            for i, (node, r) in enumerate(zip(b.column("node").to_pylist(), b.column("rot").to_pylist())):
                rot = np.frombuffer(r, dtype=np.float32)
                spot = int.from_bytes(node[-8:], "big")
                for k, own, before in _cells(rot, cosine, grid):
                    name = _name(len(rot), k, own)
                    homes, visits = parts[name]
                    c = spot % homes
                    todo = [(f"{name}/{c}-{c}", 2)] + [(f"{name}/{min(c, o)}-{max(c, o)}", int(c > o)) for o in range(homes) if o != c] + [(f"{name}/{c}+{v}", 0) for v in range(visits)]
                    for near in before:
                        name = _name(len(rot), k, near)
                        if name in parts:
                            homes, visits = parts[name]
                            todo += [(f"{name}/{h}+{spot % visits}", 1) for h in range(homes)]
                    for t, s in todo:
                        task.append(t), side.append(s), row.append(i)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.string()), pa.array(side, pa.int32()), *[b.column(c).take(rows) for c in ("node", "m", "vec")]], names=["task", "side", "node", "m", "vec"])

    return classes.select("node", "m", "vec", "rot").mapInArrow(run, "task string, side int, node binary, m bigint, vec binary")


def _join_cell(cosine: float):
    def work(table):
        n, d = table.num_rows, int(table.column("task")[0].as_py().split(".", 1)[0])
        vec = np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * d else np.float64).astype(np.float64) for v in table.column("vec").to_pylist()])
        rot = np.stack([rotated(v) for v in vec])
        norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
        m, side, node = table.column("m").to_numpy(), table.column("side").to_numpy(), table.column("node").to_pylist()
        block = int(table.column("task")[0].as_py().split(".")[1])
        budgets = radii(d, cosine)
        a, b = blocks(d)[block]
        part = rot[:, a:b]
        square = np.einsum("ij,ij->i", part, part)[:, None]
        one = np.ones_like(square)
        # one product gives the squared distances of a tile: (-2x, |x|**2, 1) . (y, 1, |y|**2)
        near_left, near_right = np.hstack([-2 * part, square, one]), np.hstack([part, one, square])
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        count = np.zeros(n, dtype=np.int64)
        root = np.arange(n)
        forest: list[tuple[int, int]] = []

        def settle(i: np.ndarray, j: np.ndarray) -> None:
            """Verify candidate pairs, count links, keep those that connect what wasn't connected."""
            ok = np.ones(len(i), dtype=bool)
            for k, (p, q) in enumerate(blocks(d)[: block + 1]):
                gap = rot[i, p:q] - rot[j, p:q]
                near = (gap * gap).sum(axis=1) <= budgets[k]
                ok &= near if k == block else ~near  # the first block that proposes a pair settles it
            i, j = i[ok], j[ok]
            i, j = (x[np.einsum("ij,ij->i", vec[i], vec[j]) >= cosine * norm[i] * norm[j]] for x in (i, j))
            np.add.at(count, i, m[j])
            np.add.at(count, j, m[i])
            while len(i):
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                if len(i):
                    forest.append((i[0], j[0]))
                    root[root == root[j[0]]] = root[i[0]]

        least = np.float32(budgets[block] + 1e-4)
        for x in range(0, len(left), TILE):
            rows = left[x : x + TILE]
            for y in range(0, len(right), 2 * TILE):
                cols = right[y : y + 2 * TILE]
                close = near_left[rows] @ near_right[cols].T <= least
                if not close.any():
                    continue
                i, j = np.nonzero(close)
                i, j = rows[i], cols[j]
                once = (side[i] != side[j]) | (i < j)
                i, j = i[once], j[once]
                for z in range(0, len(i), 32768):
                    settle(i[z : z + 32768], j[z : z + 32768])
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in some], pa.binary()), pa.array(count[some], pa.int64()), pa.nulls(len(some), pa.binary())], names=["a", "n", "b"])
        if forest:
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in forest], pa.binary()), pa.array([0] * len(forest), pa.int64()), pa.array([node[j] for _, j in forest], pa.binary())], names=["a", "n", "b"])

    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Rows are linked where the cosine is at least ``cosine`` (> 0), whatever their other columns. Null, empty and
    zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors are one node with a multiplicity: they count as each other's links and are never
    expanded into pairs. A row without vec_id takes part, but names no component. An empty table stays empty.
    """
    rows = cut(_prepare(vectors, column))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("vec").alias("vec"), F.first("rot").alias("rot"))
    classes = cut(classes.withColumn("node", named_by("least", "key")))
    n = classes.count()
    grid = 1
    while grid < 4 and n > CHUNK * 4 ** (grid + 1):  # finer cells before more chunks
        grid += 1
    dealt = _deal(classes, _counts(classes, cosine, grid), cosine, grid)
    found = cut(by_group(dealt, "task", _join_cell(cosine), "a binary, n bigint, b binary"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    # a component is called by its least node, and that node by the least id: no join by component is needed
    named = classes.select("key", "node", "m").join(joined, "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    of = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), first_id("component").alias("by_link"), first_id("node").alias("own"), F.col("component").isNull().alias("alone"))
    of = of.select("key", "n_links", F.when(F.col("alone"), F.col("own")).otherwise(F.col("by_link")).alias("component_id"))
    out = rows.select("vec_id", "key").join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
