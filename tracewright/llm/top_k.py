"""Exact top-k inner products by dual cover trees.

Vectors are dealt to cells by their nearest pivot, and cells are cut into blocks with a centre and a covering radius; queries
likewise. In a first round each query block searches the one data block whose centre promises the most, which gives every query its worst kth
score so far. A data block is then sent to a query block only if the bound on any inner product of the two,
``<q, p> + |q| rp + |p| rq + rq rp`` for centres q, p and radii rq, rp, reaches the least of these. Inside such a pair
both sides get a cover tree and pairs of nodes are pruned by the same bound. A task returns k rows for each of its queries at most, which are
merged by query.

Copies of one vector tie, and ties go to the smaller ids: of the copies only the k + 1 first ones can be in a result, so no more are indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.storage import written

K = 10
DATA_BLOCK = 8192
QUERY_BLOCK = 2048
#: Pivots of vectors of one length at most (one for each DATA_BLOCK rows), and lengths that get pivots of their own (others have one cell): bounds of what the driver holds.
PIVOTS, LENGTHS = 128, 16
_LEAF = 256
_NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes with a centre, a covering radius and children or a leaf's rows; each level at least halves the radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.norm = np.sqrt((x * x).sum(1))
        if len(x):
            self._node(np.arange(len(x)), 0)

    def _node(self, rows: np.ndarray, centre: int) -> int:
        node = len(self.centre)
        away = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1))
        radius = float(away.max())
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= _LEAF or radius == 0:
            return node
        # A net of half the radius: the farthest row becomes the next centre, and each row joins its nearest centre.
        centres, owner = [centre], np.zeros(len(rows), np.int64)
        while away.max() > radius / 2 and len(centres) < 64:
            centres.append(int(rows[away.argmax()]))
            new = np.sqrt(((self.x[rows] - self.x[centres[-1]]) ** 2).sum(1))
            closer = new < away
            away[closer] = new[closer]
            owner[closer] = len(centres) - 1
        if len(centres) == 1:
            return node
        self.children[node] = [self._node(rows[owner == c], at) for c, at in enumerate(centres) if (owner == c).any()]
        return node


class Search:
    """The k best candidates of each query in one block of data, of those that reach the query's worst kth score so far."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.queries, self.data, self.query_rows, self.ids, self.data_rows, self.k = queries, data, query_rows, ids, rows, k
        self.scores = np.full((len(queries), k), _NONE)
        self.found = np.full((len(queries), k), -1)  # places in data
        self.worst = np.full(len(queries), _NONE) if worst is None else worst.copy()
        self.start = self.worst.copy()
        largest = queries.shape[1] * int(np.abs(queries).astype(object).max(initial=0)) * int(np.abs(data).astype(object).max(initial=0)) if len(queries) and len(data) else 0
        #: What holds every inner product exactly: floats are fastest, and Python's integers never overflow.
        self.kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
        if not len(queries) or not len(data):
            return
        if self.kind is object:
            self._plain()
            return
        self.q, self.d = CoverTree(queries.astype(np.float64)), CoverTree(data.astype(np.float64))
        self.left, self.right = queries.astype(self.kind), data.astype(self.kind)
        self._pair(0, 0)

    def _plain(self) -> None:
        """Every pair, in integers of any size; a score beyond 64 bits counts as their limit."""
        data = self.data.astype(object)
        for q, vector in enumerate(self.queries.astype(object)):
            scores = [min(max(v, -(2**63) + 1), 2**63 - 1) for v in data @ vector]
            best = heapq.nsmallest(self.k, (p for p in range(len(data)) if self.data_rows[p] != self.query_rows[q]), key=lambda p: (-scores[p], self.ids[p], self.data_rows[p]))
            self.found[q, : len(best)] = best
            self.scores[q, : len(best)] = [scores[p] for p in best]
        self.worst = np.maximum(self.worst, self.scores[:, -1])

    def _pair(self, a: int, b: int) -> None:
        bound = lambda a, b: score_bound(self.q.x[self.q.centre[a]] @ self.d.x[self.d.centre[b]], self.q.norm[self.q.centre[a]], self.q.radius[a], self.d.norm[self.d.centre[b]], self.d.radius[b])
        stack = [(a, b, bound(a, b))]
        while stack:
            a, b, top = stack.pop()
            if top < self.worst[self.q.rows[a]].min():
                continue
            left, right = self.q.children[a], self.d.children[b]
            if not left and not right:
                self._leaves(self.q.rows[a], self.d.rows[b])
                continue
            if right and (not left or self.d.radius[b] >= self.q.radius[a]):
                below = [(a, c, bound(a, c)) for c in right]
            else:
                below = [(c, b, bound(c, b)) for c in left]
            stack += sorted(below, key=lambda p: p[2])

    def _leaves(self, qs: np.ndarray, ds: np.ndarray) -> None:
        score = (self.left[qs] @ self.right[ds].T).astype(np.int64)
        score[self.query_rows[qs][:, None] == self.data_rows[ds][None, :]] = _NONE
        better = score.max(1) >= self.worst[qs]
        qs, score = qs[better], score[better]
        if not len(qs):
            return
        # Of each row's new scores only those can enter that reach its own kth one.
        least = self.worst[qs]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((score >= least[:, None]) & (score > _NONE))
        old = np.repeat(np.arange(len(qs)), self.k)
        row, value, place = np.concatenate([old, row]), np.concatenate([self.scores[qs].ravel(), score[row, column]]), np.concatenate([self.found[qs].ravel(), ds[column]])
        order = np.lexsort((self.data_rows[place], np.where(place < 0, np.iinfo(np.int64).max, self.ids[place]), -(value + 1), row))
        row = row[order]
        top = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.scores[qs], self.found[qs] = value[top].reshape(len(qs), self.k), place[top].reshape(len(qs), self.k)
        self.worst[qs] = np.maximum(self.start[qs], self.scores[qs, -1])


def score_bound(inner, query_norm, query_radius, norm, radius):
    """No inner product of a query and a vector of two balls is above this; numbers or columns."""
    reach = (query_norm + query_radius) * (norm + radius)
    return inner + query_norm * radius + norm * query_radius + query_radius * radius + 1e-9 * reach + 1e-6


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _celled(pivots: dict[int, np.ndarray]):
    """Adds `cell`: the place of the nearest pivot of the vector's length, 0 where there are no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(3).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    x, p = _vectors(batch.column(2).take(pa.array(at)), dim).astype(np.float64), pivots[dim]
                    cell[at] = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["row", "id", "vector", "dim", "cell"])

    return run


_BLOCK = "dim int, cell long, part long, rows binary, ids binary, vectors binary, centre array<double>, norm double, radius double"


def _block(table: pa.Table) -> pa.Table:
    """All rows of a block as one, with the ball around them."""
    dim = table["dim"][0].as_py()
    table = table.sort_by("row")
    x = _vectors(table["vector"].combine_chunks(), dim)
    centre = x.astype(np.float64).mean(0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max()) * (1 + 1e-9)
    values = [table[c][0].as_py() for c in ("dim", "cell", "part")]
    values += [table["row"].to_numpy().tobytes(), table["id"].to_numpy().tobytes(), np.ascontiguousarray(x).tobytes(), centre.tolist(), float(np.sqrt(centre @ centre)), radius]
    names = ["dim", "cell", "part", "rows", "ids", "vectors", "centre", "norm", "radius"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, values, kinds, strict=True)})


def blocks(x: DataFrame, size: int) -> DataFrame:
    """A written table of blocks of about `size` rows (row, id, vector, dim, cell) of one cell: block, and the columns of _BLOCK."""
    # One row for each cell: LENGTHS * PIVOTS of them, and one for each further length of vector.
    cells = x.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
    x = x.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    packed = x.select("row", "id", "vector", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(_block, _BLOCK)
    return written(packed.withColumn("block", F.xxhash64("dim", "cell", "part")), "blocks")


def _searched(k: int):
    """One row for each pair of blocks: what was found, and the worst kth score of each query, in the order of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                longs = {c: np.frombuffer(pair[c], np.int64) for c in ("rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors")}
                worst = np.frombuffer(pair["worst"], np.int64) if pair["worst"] else None
                s = Search(longs["q_vectors"].reshape(-1, pair["dim"]), longs["q_rows"], longs["vectors"].reshape(-1, pair["dim"]), longs["ids"], longs["rows"], k, worst)
                some = s.found >= 0
                at = s.found[some]
                per_query = some.sum(1)
                flat = [np.repeat(longs["q_rows"], per_query), np.repeat(longs["q_ids"], per_query), longs["ids"][at], longs["rows"][at], s.scores[some]]
                found = pa.StructArray.from_arrays([pa.array(c) for c in flat], ["query_row", "query_id", "vec_id", "row", "score"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair["q_block"]]), pa.array([s.worst.tobytes()], pa.binary()), pa.array([int(s.worst.min())]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)],
                    ["q_block", "worst", "least", "found"],
                )

    return run


_FOUND = "q_block long, worst binary, least long, found array<struct<query_row: long, query_id: long, vec_id: long, row: long, score: long>>"


def block_pairs(query_blocks: DataFrame, data_blocks: DataFrame) -> DataFrame:
    """(q_block, block, size, inner, bound) of all pairs of blocks of one length: centres and radii only."""
    parts = int(data_blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = data_blocks.select("dim", "block", "centre", "norm", "radius", F.expr("octet_length(rows) div 8").alias("size"), F.pmod("block", F.lit(parts)).cast("int").alias("share"))
    asks = query_blocks.select("dim", F.col("block").alias("q_block"), F.col("centre").alias("q_centre"), F.col("norm").alias("q_norm"), F.col("radius").alias("q_radius"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("share"))
    met = data.join(asks, ["dim", "share"])
    inner = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    met = met.withColumn("inner", inner)
    return met.select("q_block", "block", "size", "inner", score_bound(F.col("inner"), F.col("q_norm"), F.col("q_radius"), F.col("norm"), F.col("radius")).alias("bound"))


def reachable(pairs: DataFrame, home: DataFrame, first: DataFrame) -> DataFrame:
    """(q_block, block, worst) of the pairs beyond those of home that may still hold one of a query's k best."""
    rest = pairs.join(home, ["q_block", "block"], "left_anti").join(first.select("q_block", "worst", "least"), "q_block")
    return rest.where("bound >= least").select("q_block", "block", "worst")


def top_k(embeddings: DataFrame, k: int = K, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k rows of the highest inner product with each row whose vec_id is divisible by `every`.

    embeddings needs vec_id and embedding; other columns are ignored. Components become floor(scale * x). Returns query_id,
    rank (from 1), vec_id and score; ties go to the smaller vec_id. Vectors that are null or empty or hold a null or non-finite
    component take no part, nor rows without an id. Rows that share a vec_id are candidates of their own, of each other too, and
    queries of their own, whose results then stand under one query_id. Vectors meet those of their own length only. Components and
    inner products beyond the limits of a 64-bit integer count as the limit. An
    empty table, or one without queries, gives no row.
    """
    spark = embeddings.sparkSession
    x = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(~bad).select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("vector"))
    x = written(x.withColumn("dim", F.size("vector")), "vectors")
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
    chosen = x.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= PIVOTS).orderBy("place", "dim").limit(PIVOTS * LENGTHS)
    pivots: dict[int, list] = {}
    counts = {r.dim: r["count"] for r in x.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    for row in chosen.select("dim", "vector").collect():
        if DATA_BLOCK * len(pivots.get(row.dim, ())) < counts.get(row.dim, 0):
            pivots.setdefault(row.dim, []).append(row.vector)
    cells = _celled({dim: np.array(v, np.float64) for dim, v in pivots.items()})
    celled = lambda df: df.select("row", "id", "vector", "dim").mapInArrow(cells, "row long, id long, vector array<long>, dim int, cell long")
    copies = Window.partitionBy("vector").orderBy("id", "row")
    data = blocks(celled(x.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)), DATA_BLOCK)
    queries = blocks(celled(x.where(F.col("id") % every == 0)), QUERY_BLOCK)
    pairs = written(block_pairs(queries, data), "block-pairs")
    asks = queries.select("dim", F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def searched(chosen: DataFrame) -> DataFrame:
        met = chosen.join(data.select("block", "rows", "ids", "vectors"), "block").join(asks, "q_block").repartition("q_block", "block")
        return met.select("q_block", "dim", "rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors", "worst").mapInArrow(_searched(k), _FOUND)

    # A block of k rows or fewer may leave a query without a kth score.
    home = pairs.groupBy("q_block").agg(F.max_by("block", F.struct(F.col("size") > k, "inner", "block")).alias("block"))
    first = written(searched(home.withColumn("worst", F.lit(None).cast("binary"))), "first-round")
    found = first.unionByName(searched(reachable(pairs, home, first))).select(F.inline("found"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
