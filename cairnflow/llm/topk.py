"""Exact top-k inner products over a bit-sliced index.

Rows lie in blocks. A block stores each attribute as bit slices, one bitmap over its rows per
kept bit: offset from the attribute's minimum, cut to SLICES high bits. A query's score is
a weighted sum of attributes, so its bit slices come from the attributes' by bitmap
arithmetic: every set bit of a weight adds the attribute's slices, shifted, and carry-save
adders sum the bitmaps of each position. Negative weights take the complemented slices. The k-th best
sliced sum is found from the most significant slice downward; since the bits that were cut off
are bounded, every row that could still be among the k best is within a known
distance of it, and those boundary rows are scored exactly.

Groups of queries meet blocks of rows (a stated query set against all rows); each pair yields
k rows per query at most. A block is sent and unpacked once per group of some thousands of queries; wide vectors make
blocks and groups of fewer rows, so that a pair's bytes are bounded at any width.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do
rows without an id;
vectors meet only queries with as many components; equal vectors tie, and ties go to the
smaller id; components and scores beyond 64 bits are cut to the nearest 64-bit number; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits kept of each attribute; rows of a block and queries of a group at most; and components of each at most, which bound their bytes.
SLICES, ROWS, QUERIES = 7, 16384, 2048
ROW_VALUES, QUERY_VALUES = 1 << 22, 1 << 19

BLOCK = "dim int, block int, ids binary, vectors binary, least binary, cut binary, slices binary"


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, v): components as floor(scale * x), of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fixed = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    v: Column = F.when(F.col(vector).isNotNull() & finite, fixed)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").select("id", F.size("v").alias("dim"), "v")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).astype(np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _block(table: pa.Table) -> pa.Table:
    """The bit slices of one block of rows."""
    dim = table["dim"][0].as_py()
    ids, v = table["id"].to_numpy(), _matrix(table["v"], dim)
    least = v.min(0) if dim else np.zeros(0, np.int64)
    up = (v - least).astype(np.uint64)
    width = np.array([int(x).bit_length() for x in up.max(0)] if dim else [], np.int64)
    cut = np.maximum(width - SLICES, 0)
    high = up >> cut.astype(np.uint64)
    words = -(-len(ids) // 64)
    bits = np.zeros((dim, SLICES, words * 8), np.uint8)
    for s in range(SLICES):
        packed = np.packbits(((high >> np.uint64(s)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        bits[:, s, : packed.shape[1]] = packed
    row = [dim, table["block"][0].as_py(), *(x.tobytes() for x in (ids, v, least, cut, bits))]
    return pa.table([[x] for x in row], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "least", "cut", "slices"))]))


def _count(vectors: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and the components of the widest."""
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()  # one row
    return n, max(width, 1)


def index(vectors: DataFrame, rows: int = ROWS) -> tuple[DataFrame, int]:
    """BLOCK rows, and how many blocks there are."""
    n, width = _count(vectors)
    blocks = max(1, -(-n // max(1, min(rows, ROW_VALUES // width))))
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("dim", "block").applyInArrow(_block, BLOCK), blocks


def add_slices(stacks: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bit slices of the sum. stacks[p]: arrays of bitmaps that count 2**p each."""
    out, p = [], 0
    while p < len(stacks):
        held = [x.reshape(-1, words) for x in stacks[p]]
        stack = np.concatenate(held) if held else np.zeros((0, words), np.uint64)
        carries = []
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                x = a ^ b
                carries.append((a & b) | (c & x))
                stack = np.concatenate([x ^ c, stack[3 * n :]])
            else:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        if carries:
            if p + 1 == len(stacks):
                stacks.append([])
            stacks[p + 1] += carries
        p += 1
    return out


class Block:
    """One block of rows, ready for queries."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes, least: bytes, cut: bytes, slices: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.n, self.dim, self.words = len(self.ids), dim, -(-len(self.ids) // 64)
        self.v = np.frombuffer(vectors, np.int64).reshape(self.n, dim)
        self.cut = np.frombuffer(cut, np.int64)
        self.most = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.v.min(0), self.v.max(0), strict=True)]
        plain = np.frombuffer(slices, np.uint64).reshape(dim, SLICES, self.words)
        self.slices = np.stack([plain, ~plain])  # for positive and negative weights
        full = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        full[: len(packed)] = packed
        self.rows = full.view(np.uint64)

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own."""
        rows = self.rows.copy()
        for i in np.flatnonzero(self.ids == own):
            rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        k = min(k, int(np.bitwise_count(rows).sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        q = np.maximum(q, -(2**63) + 1)
        weight, negative = np.abs(q), (q < 0).astype(np.int64)
        stacks: list[list[np.ndarray]] = [[] for _ in range(int((self.cut + SLICES).max(initial=0)) + int(weight.max(initial=0)).bit_length() + 1)]
        for t in range(int(weight.max(initial=0)).bit_length()):
            on = np.flatnonzero((weight >> t) & 1)
            for s in range(SLICES):
                for c in np.unique(self.cut[on]):
                    j = on[self.cut[on] == c]
                    stacks[t + s + int(c)].append(self.slices[negative[j], j, s])
        total = add_slices(stacks, self.words)
        # the k-th best sliced sum, from the most significant slice downward
        sure, edge, bound = np.zeros_like(rows), rows, 0
        for p in range(len(total) - 1, -1, -1):
            x = sure | (edge & total[p])
            if int(np.bitwise_count(x).sum()) >= k:
                edge, bound = edge & total[p], bound | 1 << p
            else:
                sure, edge = x, edge & ~total[p]
        bound -= sum(int(w) * ((1 << int(c)) - 1) for w, c in zip(weight, self.cut, strict=True))  # what cut bits can change
        if bound > 0:
            more, same = np.zeros_like(rows), rows
            for p in range(len(total) - 1, -1, -1):
                if bound >> p & 1:
                    same = same & total[p]
                else:
                    more, same = more | (same & total[p]), same & ~total[p]
            rows = more | same
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little", count=self.n))
        if sum(int(a) * int(b) for a, b in zip(weight.tolist(), self.most, strict=True)) < 1 << 62:
            score = self.v[at] @ q
            first = np.lexsort((self.ids[at], -score))[:k]
            return self.ids[at][first], score[first]
        exact = [sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in self.v[at].tolist()]
        cut = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact]
        first = sorted(range(len(at)), key=lambda i: (-cut[i], self.ids[at[i]]))[:k]
        return self.ids[at][first], np.array([cut[i] for i in first], np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows. Both: whole_vectors()."""
    blocks, n = index(rows, block_rows)
    asked, width = _count(queries)
    groups = max(1, -(-asked // max(1, min(QUERIES, QUERY_VALUES // width))))
    packed = (
        queries.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))
        .agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about QUERIES in each, fewer if they are wide
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    )
    pairs = packed.join(blocks, ["dim", "block"]).select("dim", "ids", "vectors", "least", "cut", "slices", "queries")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vectors, least, cut, slices, asked = (batch.column(c)[i] for c in range(7))
                block = Block(dim.as_py(), ids.as_py(), vectors.as_py(), least.as_py(), cut.as_py(), slices.as_py())
                own, v = asked.values.flatten()
                v = v.flatten().to_numpy().reshape(len(own), block.dim)
                out = [(q, *block.best(q, x, k)) for q, x in zip(own.to_pylist(), v, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in ([np.full(len(o[1]), o[0]) for o in out], [o[1] for o in out], [o[2] for o in out])],
                    ["query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every vector whose id is divisible by 100, among all rows."""
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 1024)
    return top_k(rows, rows.where(F.col("id") % 100 == 0), 10)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
