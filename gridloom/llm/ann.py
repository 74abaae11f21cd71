"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are cut into blocks; every tile (query block, candidate block) is one
product of int8 codes. The codes' known rounding errors bound the true inner
product from both sides; only pairs whose upper bound reaches the k-th best
lower bound are computed again from the original vectors, in double precision.
Heaps merge the tiles' results, so the search is exact.

Vectors that are null, zero, hold a null or non-finite component, or differ in
length from the query's take no part; a table without queries gives no rows.
Equal scores go to the smaller id. An id that occurs twice counts as two rows: either
is a candidate of the other, and, if ids like it are queries, has its own answer. Rows
are told apart by their place in the stored blocks. Rows without an id take no part, and
columns other than vec_id and embedding do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

BLOCK = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .where(F.exists("vector", lambda x: x != 0))
    )


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """Rows (q, dim, c, ids, rows, data): up to ``block`` vectors of one q and one length, as packed doubles; q may be null.

    rows are the numbers that ``vectors`` has in a column of that name, or new ones; c is the first of them.
    """
    numbered = "row" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list, list]] = {}
        new = TaskContext.get().partitionId() << 40

        def out(key: tuple) -> pa.RecordBatch:
            nonlocal new
            ids, rows, data = (np.concatenate(x) for x in held.pop(key))
            if not numbered:
                rows = np.arange(new, new + len(ids))
                new += len(ids)
            packed = [ids.tobytes(), rows.tobytes(), data.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([int(rows[0])], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                names=["q", "dim", "c", "ids", "rows", "data"],
            )

        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector"))
            keys = sorted(set(zip(batch.column("q").to_pylist(), sizes.to_pylist(), strict=True)), key=str)
            for q, dim in keys:
                same = pc.and_(pc.equal(sizes, dim), pc.is_null(batch.column("q")) if q is None else pc.equal(batch.column("q"), q))
                part = batch.filter(same)
                ids = part.column("vec_id").to_numpy()
                rows = part.column("row").to_numpy() if numbered else ids
                data = part.column("vector").flatten().to_numpy().reshape(-1, dim)
                for k in range(0, len(ids), block):
                    have = held.setdefault((q, dim), ([], [], []))
                    for x, y in zip(have, (ids, rows, data), strict=True):
                        x.append(y[k : k + block])
                    if sum(map(len, have[0])) >= block:
                        yield out((q, dim))
            for key in [x for x in held if x[0] is not None and x[0] != keys[-1][0]]:
                yield out(key)
        for key in list(held):
            yield out(key)

    return vectors.mapInArrow(run, "q long, dim int, c long, ids binary, rows binary, data binary")


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """vec_id, row and vector of the stored rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, rows, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "rows", "data")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                vectors = np.frombuffer(data).reshape(-1, dim)[at]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dim), pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.frombuffer(rows, np.int64)[at]), lists], names=["vec_id", "row", "vector"])

    return blocks.mapInArrow(run, "vec_id long, row long, vector array<double>")


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, its norm, norm of what rounding took away)."""
    top = np.abs(data).max(axis=1)
    scale = np.where(top > 0, top, 1) / 127
    code = np.rint(data / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(data, axis=1), np.linalg.norm(data - code * scale[:, None], axis=1)


class Queries:
    """A block of queries and, for each, a heap of its k best candidates so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.rows, self.data, self.k = ids, rows, data, k
        self.code, self.scale, self.norm, self.err = codes(data)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), -np.inf)  # score that a candidate must reach

    def meet(self, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray) -> None:
        """One tile: bounds from int8 products, exact scores for the pairs that may count."""
        c_code, c_scale, c_norm, c_err = codes(c)
        # Products of int8 codes are whole numbers: float32 sums up to 2**24, and doubles beyond, hold them exactly.
        kind = np.float32 if c.shape[1] * 127 * 127 < 1 << 24 else np.float64
        near = (self.code.astype(kind) @ c_code.astype(kind).T).astype(np.float64)
        near *= self.scale[:, None]
        near *= c_scale[None, :]
        # |q.c - near| <= |q| |c error| + |q error| |c rounded|, and a little for the doubles' own rounding
        bound = self.norm[:, None] * c_err[None, :] + self.err[:, None] * (c_norm + c_err)[None, :]
        bound += 1e-12 * self.norm[:, None] * c_norm[None, :]
        own = self.rows[:, None] == c_rows[None, :]
        least = self.worst
        if len(c_ids) > self.k:
            low = near - bound
            low[own] = -np.inf
            least = np.maximum(least, np.partition(low, -self.k, axis=1)[:, -self.k])
        near += bound
        near[own] = -np.inf
        rows, cols = np.nonzero(near >= np.maximum(least, -1e308)[:, None])
        for at in range(0, len(rows), 1 << 16):
            r, j = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            scores = np.einsum("ij,ij->i", self.data[r], c[j])
            for i, s, v in zip(r.tolist(), scores.tolist(), (-c_ids[j]).tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, v))
                elif (s, v) > heap[0]:
                    heapq.heapreplace(heap, (s, v))
        self.worst = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def found(self) -> pa.RecordBatch:
        sizes = [len(h) for h in self.heaps]
        flat = [x for h in self.heaps for x in h]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(x, sizes)) for x in (self.rows, self.ids)] + [pa.array([-v for _, v in flat], pa.int64()), pa.array([s for s, _ in flat], pa.float64())],
            names=["row", "query_id", "vec_id", "score"],
        )


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for each row whose vec_id is divisible by ``every``.

    The stated query set meets all rows in blocks: query block q goes to ``parts`` tasks
    together with each candidate block in turn, so that a task sends on k rows a query.
    """
    spark = vectors.sparkSession
    good = usable(vectors).withColumn("q", F.lit(None).cast("long"))
    stored = written(_blocks(good, block), "blocks").drop("q")
    asked = _queries(stored, every)
    n = asked.count()
    blocks = max(1, -(-n // block))
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    dealt = asked.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).repartition("q").sortWithinPartitions("q")
    numbers = lambda n, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(n - 1).cast(kind)))
    queries = _blocks(dealt, 2 * block).select("q", numbers(parts, "int").alias("part"), F.lit(-1).cast("long").alias("c"), "dim", "ids", "rows", "data")
    rows = stored.select(numbers(blocks, "long").alias("q"), F.pmod(F.xxhash64("c"), F.lit(parts)).cast("int").alias("part"), "c", "dim", "ids", "rows", "data")
    met = queries.union(rows).repartition("q", "part").sortWithinPartitions("q", "part", "c")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                q, part, c, dim, ids, rows, data = (batch.column(j)[i].as_py() for j in range(7))
                ids, rows, data = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(data).reshape(-1, dim)
                if (q, part) != key:
                    yield from (x.found() for _, x in held)
                    key, held = (q, part), []
                if c < 0:
                    held.append((dim, Queries(ids, rows, data, k)))
                else:
                    for d, x in held:
                        if d == dim:
                            x.meet(ids, rows, data)
        yield from (x.found() for _, x in held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        last = None

        def out(ids: list[tuple[int, int]]) -> pa.RecordBatch:
            rows = [(i[1], r, -v, s) for i in ids for r, (s, v) in enumerate(sorted(heaps.pop(i), reverse=True), 1)]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                names=["query_id", "rank", "vec_id", "score"],
            )

        for batch in batches:
            for row, i, v, s in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                last = row, i
                heap = heaps.setdefault(last, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            if len(heaps) > 1:
                yield out([i for i in heaps if i != last])
        if heaps:
            yield out(list(heaps))

    found = met.mapInArrow(tiles, "row long, query_id long, vec_id long, score double")
    found = found.repartition("row").sortWithinPartitions("row")
    return found.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")
