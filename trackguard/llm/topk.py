"""Exact top-k search by inner product, with norm-sorted candidates and bounds on rotated vectors.

Every component x becomes floor(SCALE * x); scores are inner products of these integers. The rotation (eigenvectors of the candidates'
second moments, the SVD's right vectors) moves most of a vector's length into its first LEAD coordinates. For a query q and a candidate x,

    q.x  <=  q[:LEAD].x[:LEAD] + |q[LEAD:]| |x[LEAD:]|         (Cauchy-Schwarz on what is left)

so a candidate is scored in full only if this bound reaches the query's k-th best score so far, and a batch of candidates, longest first,
ends for a query where even |q| |x| no longer reaches it. The k-th scores start from the HEAD longest candidates.

Queries go in blocks of at most BLOCK_BYTES; a block and its thresholds are broadcast, every partition keeps its own k best per query, and
one more aggregation merges them. More queries are more blocks, each a pass over the candidates; nothing is left out.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part; rows without id take no part; a
shorter vector counts as filled up with zeros; a query is never its own candidate by id (rows that repeat an id are all left out for the
query of that id, and are candidates of their own for others; the query of a repeated id is its first row by vector); ties go to the
smaller id; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trackguard.session import stored

SCALE = 1024
K, EVERY = 10, 100
LEAD = 16
HEAD = 4096
BLOCK_BYTES = 16 << 20
TILE = 256                  # queries compared at once
_EXACT = float(1 << 53)     # inner products below are exact in floating point
_LOWEST = np.iinfo(np.int64).min


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the scaled integer components of every vector that takes part, with its squared length."""
    x = F.col("x").cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    rows = rows.select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("v"))
    return rows.withColumn("squared", F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d integers; what a vector lacks is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d) < length[:, None]] = column.flatten().to_numpy()
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Orthonormal directions, the ones with most of the candidates' squared length first. Partitions send d x d sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column("v"), d).astype(float)
            total += m.T @ m
        yield pa.record_batch([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], names=["i", "j", "s"])
    sums = rows.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    moments = np.zeros((d, d))
    moments[sums["i"], sums["j"]] = sums["s"]
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < _EXACT else a @ b.T


class Block:
    """Queries, their rotated parts and the score each of their next results has to reach."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int, lead: int):
        self.ids, self.v, self.turn, self.k = ids, v, turn, k
        self.lead = min(lead, v.shape[1])
        self.first, self.rest, self.norm = self.rotated(v)
        self.least = np.full(len(ids), _LOWEST, np.int64)

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = v.astype(float) @ self.turn
        return np.ascontiguousarray(y[:, :self.lead]), np.sqrt((y[:, self.lead:] ** 2).sum(1)), np.sqrt((v.astype(float) ** 2).sum(1))

    def search(self, ids: np.ndarray, v: np.ndarray, best: Best) -> None:
        """Adds these candidates' results to best, raising its thresholds."""
        first, rest, norm = self.rotated(v)
        order = np.argsort(-norm, kind="stable")
        ids, v, first, rest, norm = ids[order], v[order], first[order], rest[order], norm[order]
        for at in range(0, len(self.ids), TILE):
            tile = slice(at, at + TILE)
            least = best.least[tile].astype(float)
            slack = 1e-9 * (self.norm[tile] * norm.max(initial=0) + 1)           # what rounding may cost a bound
            reach = int(((self.norm[tile][:, None] * norm) >= (least - slack)[:, None]).any(0).sum())    # norms fall, so it is a prefix
            if not reach:
                continue
            bound = self.first[tile] @ first[:reach].T + self.rest[tile][:, None] * rest[:reach]
            q, c = np.nonzero(bound >= (least - slack)[:, None])
            keep = ids[c] != self.ids[at + q]
            q, c = q[keep], c[keep]
            if not len(q):
                continue
            if len(q) * 4 > bound.size:
                score = _inner(self.v[tile], v[:reach])[q, c]
            else:
                score = np.einsum("ij,ij->i", self.v[at + q], v[c])
            best.add(at + q, ids[c], score)


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[query]
        q, i, s = (np.concatenate([a, b[good]]) for a, b in ((self.query, query), (self.ids, ids), (self.score, score)))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        start = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - start
        keep = rank < self.k
        self.query, self.ids, self.score = q[keep], i[keep], s[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _blocks(queries: DataFrame, count: int) -> Iterator[DataFrame]:
    for b in range(count):
        yield queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(count)) == b)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", lead: int = LEAD, head: int = HEAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among the vectors."""
    schema = "query_id long, vec_id long, score long"
    rows = stored(integers(vectors, vec_id, embedding))
    asked = stored(integers(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")))
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    d = max(d, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(d, 1)
    turn = rotation(rows, d)
    longest = rows.orderBy(F.desc("squared"), "vec_id").limit(head).select("vec_id", "v").toArrow()
    head_ids, head_v = longest.column("vec_id").to_numpy(), _matrix(longest.column("v"), d)
    found = []
    for part in _blocks(asked, -(-n * (d + lead + 2) * 8 // block_bytes)):
        got = part.orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        block = Block(got.column("vec_id").to_numpy(), _matrix(got.column("v"), d), turn, k, lead)
        best = Best(len(block.ids), k, block.least)
        block.search(head_ids, head_v, best)
        block.least = best.least
        found.append(_pass(rows, block, d, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return _ranked(out, k)


def _pass(rows: DataFrame, block: Block, d: int, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = Best(len(own.ids), own.k, own.least)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own.search(part.column("vec_id").to_numpy(), _matrix(part.column("v"), d), best)
        yield pa.record_batch([pa.array(own.ids[best.query]), pa.array(best.ids), pa.array(best.score)], names=["query_id", "vec_id", "score"])
    return rows.select("vec_id", "v").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
