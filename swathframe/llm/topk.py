"""Exact inner-product search by tiled matrix products.

Components are quantised to floor(scale * x). Queries and candidates are packed into blocks by a hash of their id, as many
blocks as their counts ask for, so a block's rows and bytes are bounded. Every query block meets every shard block: one matrix product
a tile and a partial selection of each query's k best in it. The tiles' lists merge in a tree of bounded fan-in, block by
block, so neither a query's candidates nor the whole result ever meet in one task.

Products are exact: single precision while all sums stay under 2^24, double under 2^53, integers of any size beyond (scores
saturate at 64 bits). Defined cases: null vectors, vectors with null or non-finite components and null ids take no part, as
query or candidate; vectors of different lengths compare as if padded with zeros; an empty vector is the zero vector; repeated
rows are candidates each, and queries each of whose own id's rows are left out; ties go to the smaller id; fewer than k
candidates give all; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a query block at least and of a shard block; bytes that a query block may have beyond; lists that one merge takes.
QUERY_ROWS, SHARD_ROWS, QUERY_BYTES, FAN_IN = 2048, 16384, 16 << 20, 8


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    lists = lists.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), flat.dtype)
    if len(size) and (size == out.shape[1]).all():
        return flat.reshape(out.shape)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of q and c."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(d, 1)
    if top < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if top < 1 << 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if top < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = q.astype(object) @ c.astype(object).T  # LOWEST stays free
    return np.clip(whole, LOWEST + 1, NONE).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k best by score, ties to the smaller id: their scores and ids."""
    if score.shape[1] > 4 * k:  # partial selection: all above the k-th score, and of its equals those of the smallest ids
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        out_s, out_i = np.empty((len(score), k), np.int64), np.empty((len(score), k), np.int64)
        for r in range(len(score)):
            at = np.flatnonzero(score[r] >= cut[r])
            o = at[np.lexsort((ids[r, at] if ids.ndim == 2 else ids[at], -score[r, at]))[:k]]
            out_s[r], out_i[r] = score[r, o], ids[r, o] if ids.ndim == 2 else ids[o]
        return out_s, out_i
    ids = np.broadcast_to(ids, score.shape)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


LOWEST, NONE = -np.iinfo(np.int64).max, np.iinfo(np.int64).max
TOPS = "qb long, slot long, row array<long>, query array<long>, width int, scores binary, ids binary"


def _tops(qb: int, slot: int, row: np.ndarray, query: np.ndarray, s: np.ndarray, i: np.ndarray) -> pa.Table:
    make = lambda x, t: pa.array([x], t)
    return pa.table([make(qb, pa.int64()), make(slot, pa.int64()), make(row, pa.list_(pa.int64())), make(query, pa.list_(pa.int64())), make(s.shape[1], pa.int32()), make(s.tobytes(), pa.binary()), make(i.tobytes(), pa.binary())], [x.split()[0] for x in TOPS.split(", ")])


def _tile(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """Partial lists of a query block in a shard block, some hundred queries at a time."""
    none = pa.table({n: pa.array([], t) for n, t in zip([x.split()[0] for x in TOPS.split(", ")], (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()))})
    if not queries.num_rows or not shard.num_rows:
        return none
    q, c = _matrix(queries.column("v")), _matrix(shard.column("cv"))
    row, query, ids = (t.column(n).to_numpy() for t, n in ((queries, "row"), (queries, "id"), (shard, "cid")))
    out_s, out_i = [], []
    for at in range(0, len(q), 256):
        s = product(q[at : at + 256], c)
        own = ids[None, :] == query[at : at + 256, None]
        s[own] = LOWEST
        i = np.where(own, NONE, ids[None, :]) if own.any() else ids
        a, b = best(s, i, k)
        out_s.append(a)
        out_i.append(b)
    return _tops(queries.column("qb")[0].as_py(), shard.column("sb")[0].as_py(), row, query, np.concatenate(out_s), np.concatenate(out_i))


def _lists(group: pa.Table):
    """(rows, queries, scores, ids) of each partial list, its rows in one order."""
    for r in range(group.num_rows):
        row = np.array(group.column("row")[r].as_py(), np.int64)
        w = group.column("width")[r].as_py()
        s, i = (np.frombuffer(group.column(n)[r].as_py(), np.int64).reshape(len(row), w) for n in ("scores", "ids"))
        o = np.argsort(row)
        yield row[o], np.array(group.column("query")[r].as_py(), np.int64)[o], s[o], i[o]


def _merge(group: pa.Table, k: int) -> pa.Table:
    parts = list(_lists(group))
    s, i = best(np.concatenate([p[2] for p in parts], 1), np.concatenate([p[3] for p in parts], 1), k)
    return _tops(group.column("qb")[0].as_py(), group.column("slot")[0].as_py() // FAN_IN, parts[0][0], parts[0][1], s, i)


def _unpack(batches):
    for b in batches:
        for _, query, s, i in _lists(b):
            real = i != NONE
            rank = np.cumsum(real, axis=1)[real]
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query[:, None], s.shape)[real]), pa.array(rank.astype(np.int32)), pa.array(i[real]), pa.array(s[real])], ["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`, among all others' rows."""
    usable = "vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable)
    v = v.select("vec_id", F.expr(f"transform(v, x -> cast(floor({scale} * x) as bigint))").alias("v"))
    most = F.max(F.expr("aggregate(v, 0L, (a, x) -> greatest(a, x, -1 - x))"))
    n, nq, dim, most = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), most).first()
    # rows travel in the narrowest type, and queries in blocks as large as memory allows: each block reads all candidates
    width, kind = next((w, t) for w, t, top in ((2, "smallint", 1 << 15), (4, "int", 1 << 31), (8, "bigint", 1 << 64)) if (most or 0) < top)
    v = v.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    rows = max(QUERY_ROWS, QUERY_BYTES // (width * max(dim or 1, 1)))
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-nq // rows))
    mark = F.monotonically_increasing_id()
    c = v.select(F.col("vec_id").alias("id"), "v", mark.alias("row")).select("id", "v", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).alias("sb"))
    q = v.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("id"), "v", mark.alias("row")).withColumn("qb", F.pmod(F.xxhash64("row", "id"), F.lit(blocks)))
    # each query goes to every shard block (blocks meet, not rows), each candidate to every query block
    q = q.withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("qb", F.col("sb").cast("long").alias("sb"), "row", "id", "v")
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("qb").cast("long").alias("qb"), "sb", F.col("id").alias("cid"), F.col("v").alias("cv"))  # names of their own: a cogroup takes equal columns of both sides for one
    tops = q.groupBy("qb", "sb").cogroup(c.groupBy("qb", "sb")).applyInArrow(lambda a, b: _tile(a, b, k), TOPS)
    slots = shards
    while slots > 1:
        tops = tops.withColumn("up", F.expr(f"slot div {FAN_IN}")).groupBy("qb", "up").applyInArrow(lambda g: _merge(g.drop_columns(["up"]), k), TOPS)
        slots = -(-slots // FAN_IN)
    return tops.mapInArrow(_unpack, "query_id long, rank int, vec_id long, score long")
