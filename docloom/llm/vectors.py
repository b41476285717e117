"""The most similar vectors of every vector, by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts; a small
classifier learns which part a vector belongs to. Parts that would hold too many
vectors are cut again, each by a graph and a classifier of its own, so parts keep
their size as the collection grows. Every vector is filed under its most probable
part and searches its several most probable ones; what it finds there is ranked by
exact cosine. Large parts are worked through in blocks, so no task holds a whole part.

Vectors that are equal are searched for once: only the smallest ids among them can
be among anyone's nearest, and the others' nearest are those.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._plan import arrow_once, broadcast_if_small, cut


MOST = 256  # parts of a level


@dataclass(frozen=True)
class NeighbourConfig:
    """k nearest by cosine, of least_cosine at least.

    sample: vectors of a dimension that a partition is learned on, at most;
    per_part: vectors that a part should hold, which sets the number of parts; fan:
    of parts up to which one classifier tells them all apart. With more there are
    two levels, the first of the root of their number, MOST parts each at most (so
    parts grow beyond their size only from MOST * MOST * per_part vectors of a
    dimension on, and are worked through in blocks then). probes: parts searched for
    each vector, at most (twice as many with two levels), of those that have the
    share ``ratio`` at least of the best one's probability. block: vectors of one
    side that a task compares at once.
    """

    k: int = 5
    least_cosine: float = 0.85
    sample: int = 8192
    per_part: int = 2000
    fan: int = 64
    probes: int = 8
    ratio: float = 0.15
    graph: int = 10
    rounds: int = 12
    hidden: int = 96
    epochs: int = 30
    block: int = 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows by cosine of each row of unit vectors."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    for b in range(0, n, 1024):
        s = x[b : b + 1024] @ x.T
        s[np.arange(len(s)), np.arange(b, b + len(s))] = -2
        out[b : b + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """A part for each row: parts of nearly equal size that cut few edges of the graph.

    Starts from balanced halvings along the widest direction, then moves rows to
    the part where most of their neighbours are while it has room.
    """
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [np.arange(n)]
    rng = np.random.default_rng(11)
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        centred = x[rows] - x[rows].mean(axis=0)
        axis = rng.standard_normal(x.shape[1])
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = rows[np.argsort(centred @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for p, rows in enumerate(groups):
        part[rows] = p
    room = int(np.ceil(1.1 * n / parts)) + 1
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.bincount(edges[0] * parts + part[edges[1]], minlength=n * parts).reshape(n, parts)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < room and rng.random() < 0.7:
                size[part[i]] -= 1
                size[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier of one hidden layer: how probable each part is for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, config: NeighbourConfig):
        rng = np.random.default_rng(5)
        n, d, p = len(x), x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, config.hidden)).astype(np.float32) * np.sqrt(2 / d).astype(np.float32), rng.standard_normal((config.hidden, p)).astype(np.float32) * 0.05, np.zeros(config.hidden, np.float32), np.zeros(p, np.float32)]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step = 0
        for _ in range(config.epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
                step += 1
                a, t = x[rows] * np.float32(np.sqrt(d)), target[rows]
                h = np.maximum(a @ self.w[0] + self.w[2], 0)
                z = h @ self.w[1] + self.w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - t) / np.float32(len(rows))
                gh = (g @ self.w[1].T) * (h > 0)
                for i, grad in enumerate((a.T @ gh, h.T @ g, gh.sum(axis=0), g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.99 * v[i] + 0.01 * grad * grad
                    self.w[i] -= (0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def probable(self, x: np.ndarray) -> np.ndarray:
        """How probable each part is for each vector."""
        z = np.maximum(x * np.float32(np.sqrt(x.shape[1])) @ self.w[0] + self.w[2], 0) @ self.w[1] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


class Partition:
    """Routers of one dimension: the first level's, and those of its parts that are cut again."""

    def __init__(self, first: Router | None, second: dict[int, Router] | None = None):
        self.first, self.second = first, second or {}

    def top(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector on the first level."""
        return self.first.probable(x).argmax(axis=1) if self.first else np.zeros(len(x), dtype=np.int64)

    def parts(self, x: np.ndarray, config: NeighbourConfig) -> list[list[int]]:
        """The parts to search for each vector, first the one it is filed under."""
        if self.first is None:
            return [[0]] * len(x)
        p = self.first.probable(x)
        if not self.second:
            return _several(p, np.argsort(-p, axis=1, kind="stable")[:, : config.probes], config.ratio)
        n = len(x)
        near = np.argsort(-p, axis=1, kind="stable")[:, : config.probes]
        # of each of the near parts the most probable parts within
        inner = np.zeros((n, near.shape[1], 2 * config.probes), dtype=np.float32)
        names = np.full(inner.shape, -1, dtype=np.int64)
        for part in np.unique(near):
            row, col = np.nonzero(near == part)
            router = self.second.get(int(part))
            if router is None:
                inner[row, col, 0], names[row, col, 0] = p[row, part], part * MOST
                continue
            q = router.probable(x[row])
            best = np.argsort(-q, axis=1, kind="stable")[:, : 2 * config.probes]
            wide = best.shape[1]
            inner[row, col, :wide] = np.take_along_axis(q, best, axis=1) * p[row, part][:, None]
            names[row, col, :wide] = part * MOST + best
        filed = names[:, 0, 0]
        flat, leaf = inner.reshape(n, -1), names.reshape(n, -1)
        order = np.argsort(-flat, axis=1, kind="stable")[:, : 2 * config.probes]
        found = _several(flat, order, config.ratio)
        return [[f, *(int(leaf[i, j]) for j in js if leaf[i, j] >= 0 and leaf[i, j] != f)] for i, (f, js) in enumerate(zip(filed.tolist(), found))]


def _several(p: np.ndarray, order: np.ndarray, ratio: float) -> list[list[int]]:
    """Of each row's columns in order of their probability, those that have so much of the best one's."""
    sorted_ = np.take_along_axis(p, order, axis=1)
    count = (sorted_ >= ratio * sorted_[:, :1]).sum(axis=1)
    return [row[:c] for row, c in zip(order.tolist(), count.tolist())]


def learn(x: np.ndarray, parts: int, config: NeighbourConfig) -> Router | None:
    """A router over so many parts, learned from unit vectors; None for one part."""
    if parts < 2 or len(x) < 8 * parts:
        return None
    graph = neighbour_graph(x, config.graph)
    part = balanced_parts(x, graph, parts, config.rounds)
    near = np.concatenate([part[:, None], part[:, None], part[graph]], axis=1)
    target = np.stack([np.bincount(row, minlength=parts) for row in near]).astype(np.float32)
    return Router(x, target / target.sum(axis=1, keepdims=True), config)


def _unit(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Usable vectors of one dimension as rows of length one."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dimension)
    x /= np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dimension_col: str) -> DataFrame:
    """_id, _dim, _vector of the vectors that have the dimension, finite elements only and a direction."""
    base = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector"), F.col(dimension_col).cast("long").alias("_dim"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return base.filter((F.col("_dim") > 0) & (F.size("_vector") == F.col("_dim")) & F.col("_id").isNotNull()).filter(finite & F.exists("_vector", lambda x: x != 0))


def _compare(base: np.ndarray, ids: np.ndarray, query: np.ndarray, qids: np.ndarray, config: NeighbourConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, neighbours and cosines: the k nearest of each query among base, exactly."""
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    b32 = base.astype(np.float32).T
    for at in range(0, len(query), 512):
        q, qi = query[at : at + 512], qids[at : at + 512]
        r, c = np.nonzero(q.astype(np.float32) @ b32 >= np.float32(config.least_cosine - 1e-4))
        keep = qi[r] != ids[c]
        r, c = r[keep], c[keep]
        cosine = np.round(np.einsum("ij,ij->i", q[r], base[c]), 12)
        near = cosine >= config.least_cosine
        r, c, cosine = r[near], c[near], cosine[near]
        order = np.lexsort((ids[c], -cosine, r))
        r, c, cosine = r[order], c[order], cosine[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < config.k
        got.append((qi[r[top]], ids[c[top]], cosine[top]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*got))  # type: ignore[return-value]


_HELD, _ASKS, _BOTH = 1, 2, 3
_FOUND = pa.schema([("_q", pa.int64()), ("_n", pa.int64()), ("_cos", pa.float64())])


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension_col: str = "embedding_dimension", config: NeighbourConfig = NeighbourConfig()) -> DataFrame:
    """id_col, neighbour, cosine: up to k nearest of each usable vector, of least_cosine at least.

    Vectors are compared within the same dimension; usable ones have that length,
    finite values only and a direction. Ties go to the smaller id. Ids are integers;
    one that occurs again stands for all its vectors. Recall is that of the
    partition (measured in the tests); what is found is exact.
    """
    units = usable_vectors(df, id_col, vector_col, dimension_col)
    same = units.select("_id", "_dim", F.xxhash64("_vector").alias("_h"), F.hash("_vector").alias("_g"))
    counted = same.groupBy("_dim", "_h", "_g").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > config.k + 1).select("_h", "_g")
    crowds = cut(counted)
    tails = None
    if not crowds.isEmpty():
        # of equal vectors the first are searched for; the others have what the last of those has, and the first
        crowded = same.join(broadcast_if_small(crowds, 100_000), ["_h", "_g"])
        order = Window.partitionBy("_h", "_g").orderBy("_id")
        heads = cut(crowded.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= config.k + 1).select("_id", "_h", "_g", "_at"))
        tails = cut(crowded.join(broadcast_if_small(heads.select("_id"), 500_000), "_id", "left_anti").select("_id", "_h", "_g"))
        units = units.join(broadcast_if_small(tails.select("_id"), 500_000), "_id", "left_anti")
    sizes = {r["_dim"]: r["_c"] for r in units.groupBy("_dim").agg(F.count(F.lit(1)).alias("_c")).collect()}  # one row a dimension
    found = _searched(_filed(units, sizes, config), config)
    if tails is not None:
        found = cut(found)
        last = heads.filter(F.col("_at") == config.k + 1).select("_h", "_g", F.col("_id").alias("_q")).join(found, "_q").select("_h", "_g", "_n", "_cos")
        given = heads.select("_h", "_g", F.col("_id").alias("_n"), F.lit(1.0).alias("_cos")).unionByName(last)
        copies = tails.select("_h", "_g", F.col("_id").alias("_q")).join(broadcast_if_small(cut(given), 500_000), ["_h", "_g"]).select("_q", "_n", "_cos")
        found = found.unionByName(_first(copies, config))
    return found.select(F.col("_q").alias(id_col), F.col("_n").alias("neighbour"), F.col("_cos").alias("cosine"))


def _filed(units: DataFrame, sizes: dict[int, int], config: NeighbourConfig) -> DataFrame:
    """units with _parts, the parts that each is searched in, first the one it is filed under."""
    first = {d: Partition(_router(units.filter(F.col("_dim") == d), n, config)) for d, n in sizes.items()}
    deep = [d for d, n in sizes.items() if round(n / config.per_part) > config.fan]
    if deep:
        second = _second_level(units.filter(F.col("_dim").isin(deep)), first, config)
        first = {d: Partition(p.first, second.get(d)) for d, p in first.items()}
    held = units.sparkSession.sparkContext.broadcast(first)

    @arrow_once("array<int>")
    def route(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        out: list = [[0]] * len(vectors)
        wanted = dims.to_numpy(zero_copy_only=False)
        for d in np.unique(wanted):
            rows = np.flatnonzero(wanted == d)
            x = _unit(vectors.take(pa.array(rows)), int(d)).astype(np.float32)
            for i, p in zip(rows, held.value[int(d)].parts(x, config)):
                out[i] = p
        return pa.array(out, pa.list_(pa.int32()))

    return cut(units.withColumn("_parts", route("_vector", "_dim")))


def first_parts(n: int, config: NeighbourConfig) -> int:
    """Parts of the first level for so many vectors."""
    parts = max(1, round(n / config.per_part))
    return min(parts if parts <= config.fan else math.ceil(math.sqrt(parts)), MOST, config.sample // 32)


def _router(vectors: DataFrame, n: int, config: NeighbourConfig) -> Router | None:
    """The router of one dimension, learned on its sample: the vectors with the smallest hashes of their ids."""
    parts = first_parts(n, config)
    if parts < 2:
        return None
    share = min(1.0, 1.5 * config.sample / n)
    some = vectors.filter(F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(F.xxhash64("_id"), "_id").limit(config.sample)
    rows = some.select("_dim", "_vector").toArrow()
    vectors = rows.column("_vector").combine_chunks()
    return learn(_unit(vectors, rows.column("_dim")[0].as_py()).astype(np.float32), parts, config)


def _second_level(units: DataFrame, first: dict[int, Partition], config: NeighbourConfig) -> dict[int, dict[int, Router]]:
    """Routers of the parts that hold more than two parts' worth, each learned by a task on the part's sample.

    MOST of them a dimension at most come to the driver.
    """
    held = units.sparkSession.sparkContext.broadcast(first)

    @arrow_once("int")
    def top(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        out, wanted = np.zeros(len(vectors), dtype=np.int32), dims.to_numpy(zero_copy_only=False)
        for d in np.unique(wanted):
            rows = np.flatnonzero(wanted == d)
            out[rows] = held.value[int(d)].top(_unit(vectors.take(pa.array(rows)), int(d)).astype(np.float32))
        return pa.array(out)

    placed = units.withColumn("_part", top("_vector", "_dim"))
    sizes = cut(placed.groupBy("_dim", "_part").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > 2 * config.per_part))
    share = F.least(F.lit(1.0), F.lit(float(config.sample)) / F.col("_size"))
    some = placed.join(F.broadcast(sizes), ["_dim", "_part"]).filter(F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1 << 20)) < share * (1 << 20))

    def train(key: tuple, rows: pa.Table) -> pa.Table:
        dim, size = key[0].as_py(), rows.column("_size")[0].as_py()
        x = _unit(rows.sort_by("_id").column("_vector").combine_chunks(), dim).astype(np.float32)
        router = learn(x, min(round(size / config.per_part), MOST, len(x) // 32), config)
        return pa.table({"_dim": pa.array([dim], pa.int64()), "_part": pa.array([key[1].as_py()], pa.int32()), "_router": pa.array([pickle.dumps(router)], pa.binary())})

    out: dict[int, dict[int, Router]] = {}
    for r in some.select("_dim", "_part", "_size", "_id", "_vector").groupBy("_dim", "_part").applyInArrow(train, "_dim bigint, _part int, _router binary").collect():
        router = pickle.loads(r["_router"])
        if router is not None:
            out.setdefault(r["_dim"], {})[r["_part"]] = router
    return out


def _first(pairs: DataFrame, config: NeighbourConfig) -> DataFrame:
    """The k best _n of each _q, ties to the smaller."""
    order = Window.partitionBy("_q").orderBy(F.desc("_cos"), "_n")
    best = pairs.filter("_q <> _n").groupBy("_q", "_n").agg(F.max("_cos").alias("_cos"))
    return best.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= config.k).drop("_at")


def _searched(filed: DataFrame, config: NeighbourConfig) -> DataFrame:
    """_q, _n, _cos: what each vector finds in its parts."""
    asks = filed.select("_dim", F.posexplode("_parts").alias("_at", "_part"), "_id", "_vector")
    # blocks of both sides: a large part becomes a grid of cells, each a task's worth
    blocks = lambda n: F.ceil(n / config.block).cast("int")
    sizes = asks.groupBy("_dim", "_part").agg(blocks(F.count_if(F.col("_at") == 0)).alias("_rows"), blocks(F.count(F.lit(1))).alias("_cols"))
    grid = broadcast_if_small(cut(sizes.filter("_rows > 0")), 1_000_000)  # a row a part
    placed = asks.join(grid, ["_dim", "_part"])
    whole = (F.col("_rows") == 1) & (F.col("_cols") == 1)
    mine, theirs = F.pmod(F.xxhash64("_id"), F.col("_rows")).cast("int"), F.pmod(F.xxhash64("_id"), F.col("_cols")).cast("int")
    # in a part of one cell a vector that is filed there comes once for both sides
    side = F.when((F.col("_at") == 0) & whole, _BOTH).otherwise(_ASKS)
    cells = placed.select("_dim", "_part", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_row"), theirs.alias("_col"), "_id", "_vector", side.alias("_side")).unionByName(
        placed.filter((F.col("_at") == 0) & ~whole).select("_dim", "_part", mine.alias("_row"), F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("_col"), "_id", "_vector", F.lit(_HELD).alias("_side"))
    )

    def search(cell: pa.Table) -> pa.Table:
        ids = cell.column("_id").to_numpy()
        x = _unit(cell.column("_vector").combine_chunks(), cell.column("_dim")[0].as_py())
        side = cell.column("_side").to_numpy()
        held, asks = (side & _HELD) > 0, (side & _ASKS) > 0
        q, n, cosine = _compare(x[held], ids[held], x[asks], ids[asks], config)
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(cosine, pa.float64())], schema=_FOUND)

    found = cells.groupBy("_dim", "_part", "_row", "_col").applyInArrow(search, "_q bigint, _n bigint, _cos double")
    # what a vector finds, its finds may not have found: both ways
    return _first(found.unionByName(found.select(F.col("_n").alias("_q"), F.col("_q").alias("_n"), "_cos")), config)


def mutual_pairs(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """vec_a < vec_b, cosine of the pairs in which either is among the other's nearest."""
    a, b = F.least(id_col, "neighbour"), F.greatest(id_col, "neighbour")
    return found.select(a.alias("vec_a"), b.alias("vec_b"), "cosine").groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
