"""Searches over vectors: approximate by rotated one-bit codes, and exact by a three-phase uniform threshold.

Queries are a stated part of the table and meet all rows in blocks: candidates are dealt to lanes of bounded size and
queries to blocks of bounded size, and a task sees one lane and one block. The shuffled tables are the two sides
repeated by the other's number of blocks; no pair of vectors is ever a row unless it may be an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import written

#: Candidates in a lane and queries in a block, about.
LANE, BLOCK = 16_384, 4_096
#: Queries scored at a time.
TILE = 256
#: Width of the error bound, in standard deviations of the estimate.
EPSILON = 2.5


def usable(vectors: DataFrame, name: str = "embedding", zero: bool = False) -> DataFrame:
    """``(vec_id, v)`` without null ids and without vectors that are null, empty, all zero (unless ``zero``) or hold null, NaN or infinity."""
    v = F.col(name).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & some)


def _asked(rows: DataFrame, every: int) -> DataFrame:
    """One row a query: of rows that repeat a query's id the smallest vector asks."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def _dealt(side: DataFrame, place: Column, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """``side`` dealt by ``place`` to ``n_own`` groups, once for each of the other side's groups."""
    return side.withColumn(own, F.pmod(place, F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _by_row() -> Column:
    """Even shares of a written table, whatever its values: its scan gives the same numbers each time."""
    return F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33)


def _by_id() -> Column:
    return F.xxhash64("vec_id")


def _matrix(t: pa.Table, name: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids, and for each dimension that occurs the rows of it and their matrix."""
    ids = t.column("vec_id").to_numpy()
    lists = t.column(name).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, base = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    return ids, [(at, flat[base[at][:, None] + np.arange(d)]) for d in np.unique(size).tolist() for at in [np.flatnonzero(size == d)]]


def _rotation(d: int) -> np.ndarray:
    """The same random rotation in every task."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def coded(rows: DataFrame) -> DataFrame:
    """The index: ``(vec_id, v, bits, norm, align)``. ``bits`` are the signs of the rotated vector, packed; ``align`` is the
    inner product of the unit vector with its code, the correction of every estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            ids, parts = _matrix(t, "v")
            bits, norm, align = [b""] * len(ids), np.zeros(len(ids)), np.zeros(len(ids))
            for at, m in parts:
                turned = m @ _rotation(m.shape[1])
                norm[at] = np.sqrt((m * m).sum(axis=1))
                align[at] = np.abs(turned).sum(axis=1) / np.sqrt(m.shape[1]) / norm[at]
                for i, x in zip(at.tolist(), np.packbits(turned > 0, axis=1), strict=True):
                    bits[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(bits, pa.binary()), pa.array(norm), pa.array(align)], names=["vec_id", "v", "bits", "norm", "align"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, bits binary, norm double, align double")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _near(k: int, epsilon: float):
    """Per lane and block: estimates from codes, a bound around each, exact scores for whatever may be among the k best."""

    def run(key, queries: pa.Table, lane: pa.Table) -> pa.Table:
        found: list = []
        if queries.num_rows and lane.num_rows:
            qid, qparts = _matrix(queries, "v")
            cid, cparts = _matrix(lane, "v")
            bits = lane.column("bits").to_pylist()
            norm, align = lane.column("norm").to_numpy(), lane.column("align").to_numpy()
            for at, m in cparts:
                d, ids = m.shape[1], cid[at]
                code = np.unpackbits(np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), -1), axis=1, count=d)
                code = (code.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
                scale = (norm[at] / align[at]).astype(np.float32)
                width = norm[at] * np.sqrt(np.maximum(0, 1 - align[at] ** 2)) / align[at] * epsilon / np.sqrt(max(1, d - 1))
                for qat, q in qparts:
                    if q.shape[1] != d:
                        continue
                    turned, length = (q @ _rotation(d)).astype(np.float32), np.sqrt((q * q).sum(axis=1))
                    for i in range(0, len(qat), TILE):
                        about = (turned[i : i + TILE] @ code.T) * scale
                        for j in range(len(about)):
                            est, off, own = about[j], width * length[i + j], ids == qid[qat[i + j]]
                            low = np.where(own, -np.inf, est - off)
                            kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                            some = np.flatnonzero((est + off >= kth) & ~own)
                            exact = (m[some] * q[i + j]).sum(axis=1)
                            best = _top(exact, ids[some], k)
                            found.append((np.full(len(best), qid[qat[i + j]]), ids[some][best], exact[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return run


def _ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", *more)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, epsilon: float = EPSILON, lane: int = LANE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the k largest inner products found.

    Each vector is indexed by one bit a dimension after a random rotation. An estimate is off by more than its
    bound with small probability (``epsilon`` standard deviations), so what may be among a lane's k best by its bound is scored in
    double precision from the vectors themselves, and the lanes' best are ranked.

    Vectors that are null, empty, zero, or hold null, NaN or infinity take no part, nor do null ids. Vectors of different
    dimensions do not meet. Rows with the query's id are its own. Repeated rows are candidates each; of repeated queries the smallest
    vector asks. Ties go to smaller ids. An empty table gives no row.
    """
    index = written(coded(usable(vectors)), "codes")
    asked = written(_asked(index, every), "queries")
    lanes, blocks = -(-max(1, index.count()) // lane), -(-max(1, asked.count()) // block)
    left = _dealt(asked, _by_id(), "block", blocks, "lane", lanes)
    right = _dealt(index, _by_row(), "lane", lanes, "block", blocks)
    met = left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block"))
    return _ranked(met.applyInArrow(_near(k, epsilon), "query_id long, vec_id long, score double"), k)


def whole_numbers(name: str = "v", scale: int = 256) -> Column:
    return F.transform(F.col(name), lambda x: F.floor(x * scale).cast("double"))


def _sliced(rows: DataFrame, slices: int) -> DataFrame:
    """One row for each vector and slice of its components."""
    width = F.ceil(F.size("v") / F.lit(slices)).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    cut = rows.select("vec_id", "v", at.alias("slice"), width.alias("width"))
    return cut.select("vec_id", F.size("v").alias("dim"), "slice", F.slice("v", F.col("slice") * F.col("width") + 1, F.greatest(F.col("width"), F.lit(1))).alias("v"))


def _partial(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact whatever their size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 24:
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    return (q @ c.T).astype(np.int64) if most < 1 << 53 else q.astype(np.int64) @ c.T.astype(np.int64)


def _met(queries: pa.Table, lane: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Each query's id, the lane's ids, the partial scores, and the query's place in its table; different dimensions do not meet."""
    if not (queries.num_rows and lane.num_rows):
        return
    qdim, cdim = (t.column("dim").to_numpy() for t in (queries, lane))
    for dim in np.intersect1d(qdim, cdim).tolist():
        qrows = np.flatnonzero(qdim == dim)
        (qid, qparts), (cid, cparts) = (_matrix(t.filter(pc.equal(t.column("dim"), dim)), "v") for t in (queries, lane))
        for (qat, q), (at, c) in ((x, y) for x in qparts for y in cparts if x[1].shape[1] == y[1].shape[1]):
            for i in range(0, len(qat), TILE):
                for j, scores in enumerate(_partial(q[i : i + TILE], c)):
                    yield int(qid[qat[i + j]]), cid[at], scores, int(qrows[qat[i + j]])


def _lists(depth: int):
    """Phase 1, per lane, block and slice: the rows of each query's best partial scores."""

    def run(key, queries: pa.Table, lane: pa.Table) -> pa.Table:
        asked, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for me, ids, scores, _ in _met(queries, lane):
            best = np.argpartition(-scores, depth)[:depth] if len(scores) > depth else np.arange(len(scores))
            asked.append(np.full(len(best), me))
            rows.append(ids[best])
        return pa.table({"query_id": np.concatenate(asked), "row": np.concatenate(rows)})

    return run


def _entries(key, queries: pa.Table, lane: pa.Table) -> pa.Table:
    """Phase 2, per lane, block and slice: all entries from the query's cutoff on."""
    out = [[np.zeros(0, np.int64)] * 3]
    cut = queries.column("cutoff").to_numpy()
    for me, ids, scores, at in _met(queries, lane):
        best = np.flatnonzero(scores >= cut[at])
        out.append([np.full(len(best), me), ids[best], scores[best]])
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
    return pa.table(dict(zip(("query_id", "row", "score"), columns, strict=True)))


def _exact(k: int | None):
    """Whole scores of asked pairs, per lane and block: a query's vector with the rows it asks for, against the lane's vectors."""

    def run(key, queries: pa.Table, lane: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        if queries.num_rows and lane.num_rows:
            row, ids = lane.column("row").to_numpy(), lane.column("vec_id").to_numpy()
            order = np.argsort(row)
            held = lane.column("v").combine_chunks()
            flat, size = held.flatten().to_numpy(zero_copy_only=False), held.value_lengths().to_numpy(zero_copy_only=False)
            base = np.cumsum(size) - size
            for me, v, want in zip(queries.column("query_id").to_pylist(), queries.column("v"), queries.column("rows"), strict=True):
                at = order[np.searchsorted(row[order], want.values.to_numpy(zero_copy_only=False))]
                q = v.values.to_numpy(zero_copy_only=False)
                at = at[(ids[at] != me) & (size[at] == len(q))]
                scores = _partial(q[None, :], flat[base[at][:, None] + np.arange(len(q))])[0]
                if k is not None:
                    best = _top(scores, ids[at], k)
                    at, scores = at[best], scores[best]
                out.append([np.full(len(at), me), ids[at], scores])
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def top_inner(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, slices: int = 2, depth: int = 16, lane: int = LANE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the k largest integer inner products, exactly.

    Components become floor(scale * x). A vector's components are cut into ``slices``, and each slice keeps lists of partial scores.

    1. Every slice names each query's ``depth`` best partial scores of each lane. Scored in full, the k-th best of them is a lower
       bound of the k-th best score.
    2. The bound's even share is the cutoff: whoever stays below it in every slice stays below the bound. The slices give all
       entries from the cutoff on; those known in every slice that miss the bound go.
    3. What remains is scored in full.

    Cutoffs travel as a column of the query blocks. Null ids, null vectors and vectors that hold null, NaN or infinity take no
    part (empty ones neither; zero vectors do). Different dimensions do not meet. Rows with the query's id are its own; repeated rows
    are candidates each; of repeated queries the smallest vector asks. Ties go to smaller ids. An empty table gives no row.
    """
    rows = usable(vectors, zero=True).select("vec_id", whole_numbers("v", scale).alias("v"))
    # Rows that repeat an id must not add up: each row gets a number, and partial scores meet under it.
    rows = written(rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "v"), "whole")
    asked = written(_asked(rows, every), "queries")
    lanes, blocks = -(-max(1, rows.count()) // lane), -(-max(1, asked.count()) // block)
    held = _dealt(_sliced(rows.select(F.col("row").alias("vec_id"), "v"), slices), _by_row(), "lane", lanes, "block", blocks)
    group = ("lane", "block", "slice")
    number = F.col("row") + F.shiftright("row", 33)
    vectors_ = _dealt(rows, number, "lane", lanes, "block", blocks).groupBy("lane", "block")

    def scored(pairs: DataFrame, most: int | None) -> DataFrame:
        each = pairs.withColumn("lane", F.pmod(number, F.lit(lanes)).cast("int")).groupBy("query_id", "lane").agg(F.collect_list("row").alias("rows"))
        each = each.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return each.groupBy("lane", "block").cogroup(vectors_).applyInArrow(_exact(most), "query_id long, vec_id long, score long")

    # Own rows stand in the lists too: ask for as many more as a query's id has rows.
    own = rows.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    asks = _dealt(_sliced(asked, slices), _by_id(), "block", blocks, "lane", lanes)
    first = asks.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(_lists(depth + own), "query_id long, row long")
    known = scored(first.distinct(), None)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    bound = known.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("bound"))
    bound = written(bound, "bounds")
    # Queries with fewer than k known have few candidates in all, and take every entry.
    share = F.coalesce(F.ceil(F.col("bound") / slices), F.lit(-(1 << 62))).alias("cutoff")
    cut = asked.join(bound.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", share)
    sliced = _sliced(asked, slices).join(cut.select("vec_id", "cutoff"), "vec_id")
    again = _dealt(sliced, _by_id(), "block", blocks, "lane", lanes)
    second = again.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(_entries, "query_id long, row long, score long")
    sums = second.groupBy("query_id", "row").agg(F.sum("score").alias("sum"), F.count("*").alias("seen"))
    alive = sums.join(bound, "query_id", "left").where((F.col("seen") < slices) | F.col("bound").isNull() | (F.col("sum") >= F.col("bound")))
    return _ranked(scored(alive.select("query_id", "row"), k), k)
