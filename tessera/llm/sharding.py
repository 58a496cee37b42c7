"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import written

#: Standard deviations around the mode that a draw weighs; what lies beyond is below double precision.
WIDTH = 9
#: Rows that one step of the second permutation should see.
ROWS_A_STEP = 64


def _draw(total: str, good: str, picked: str, u: str) -> str:
    """SQL for one hypergeometric variate: of ``total`` rows ``good`` are of the shard, ``picked`` go left; ``u`` is uniform.

    Inversion over the weights around the mode: upward from it, then downward. Each weight follows from its neighbour by their
    exact ratio, relative to the mode's own, so it is right to rounding at any size, and none is kept.
    """
    mode = f"cast(floor((({picked}) + 1D) * (({good}) + 1D) / (({total}) + 2D)) as bigint)"
    spread = f"cast(ceil({WIDTH} * sqrt(greatest(0D, cast({picked} as double) * ({good}) / greatest(1, {total}) * (({total}) - ({good})) / greatest(1, {total}) * (({total}) - ({picked})) / greatest(1, ({total}) - 1)))) as bigint) + {WIDTH}"
    one = f"transform(array(named_struct('t', {total}, 'g', {good}, 'p', {picked}, 'm', {mode}, 's', {spread}, 'u', {u})), y -> named_struct('t', y.t, 'g', y.g, 'p', y.p, 'm', y.m, 'u', y.u, 'lo', greatest(0L, y.p + y.g - y.t, y.m - y.s), 'hi', least(y.g, y.p, y.m + y.s)))"
    up = "cast(z.g - k as double) * (z.p - k) / ((k + 1D) * (z.t - z.g - z.p + k + 1D))"
    down = "cast(k as double) * (z.t - z.g - z.p + k) / ((z.g - k + 1D) * (z.p - k + 1D))"
    total_of = lambda upto, ratio: f"aggregate(sequence(z.m, z.{upto}), named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * ({ratio}), 's', a.s + a.w), a -> a.s)"
    summed = f"transform({one}, z -> named_struct('z', z, 'left', z.u * ({total_of('hi', up)} + {total_of('lo', down)} - 1D)))"
    seek = lambda start, upto, ratio: (
        f"aggregate(sequence(z.m, z.{upto}), {start}, (a, k) -> if(a.k is not null, a, if(a.left < a.w, named_struct('w', a.w, 'left', a.left, 'k', k), named_struct('w', a.w * ({ratio}), 'left', a.left - a.w, 'k', cast(null as bigint)))))"
    )
    start = "named_struct('w', 1D, 'left', {left}, 'k', cast(null as bigint))"
    first = f"transform({summed}, x -> element_at(transform(array(x.z), z -> named_struct('z', z, 'a', {seek(start.format(left='x.left'), 'hi', up)})), 1))"
    # The way down passes the mode again: its weight has been taken off already, so it is given back.
    second = f"transform({first}, y -> element_at(transform(array(y.z), z -> coalesce(y.a.k, {seek(start.format(left='y.a.left + 1D'), 'lo', down)}.k, z.m)), 1))"
    return f"element_at({second}, 1)"


def matrix(blocks: DataFrame, n_blocks: int, shards: int, seed: int) -> DataFrame:
    """``(block, counts array<long>)``: how many rows of each block go to each shard, drawn exactly.

    ``blocks`` has ``(block, n)``. Capacities differ by one at most. The root holds all blocks; each
    level halves the blocks and draws how much of every shard's capacity the left half gets, shard
    after shard, which is the law of a uniform permutation. ``log2(n_blocks)`` narrow steps.
    """
    levels = max(0, math.ceil(math.log2(max(1, n_blocks))))
    leaves = 1 << levels
    listed = F.array_sort(F.collect_list(F.struct("block", F.col("n").cast("long").alias("n"))))
    root = blocks.agg(listed.alias("all"))
    root = root.selectExpr(
        f"transform(sequence(1, {leaves}), i -> coalesce(get(all, i - 1).n, 0L)) as sizes",
        f"transform(sequence(1, {leaves}), i -> get(all, i - 1).block) as names",
    )
    root = root.withColumn("total", F.expr("aggregate(sizes, 0L, (s, x) -> s + x)"))
    node = root.selectExpr(
        "0L as node", "sizes", "names",
        f"transform(sequence(0L, {shards - 1}L), s -> total div {shards} + if(s < total % {shards}, 1L, 0L)) as caps",
    )
    for level in range(levels):
        half = 1 << (levels - level - 1)
        u = f"(shiftrightunsigned(xxhash64({seed}L, {level}L, node, s), 11) / 9007199254740992D)"
        draw = _draw("acc.rest", "element_at(caps, cast(s as int))", "acc.need", u)
        took = (
            f"aggregate(sequence(1L, {shards}L), named_struct('rest', aggregate(sizes, 0L, (s, x) -> s + x), 'need', aggregate(slice(sizes, 1, {half}), 0L, (s, x) -> s + x), 'out', cast(array() as array<bigint>)), "
            f"(acc, s) -> element_at(transform(array({draw}), d -> named_struct('rest', acc.rest - element_at(caps, cast(s as int)), 'need', acc.need - d, 'out', concat(acc.out, array(d)))), 1), acc -> acc.out)"
        )
        node = node.withColumn("took", F.expr(took))
        node = node.selectExpr(
            "node", f"inline(array(named_struct('left', true, 'part', slice(sizes, 1, {half}), 'who', slice(names, 1, {half}), 'cap', took), "
            f"named_struct('left', false, 'part', slice(sizes, {half + 1}, {half}), 'who', slice(names, {half + 1}, {half}), 'cap', zip_with(caps, took, (c, t) -> c - t))))",
        ).selectExpr("node * 2 + if(left, 0, 1) as node", "part as sizes", "who as names", "cap as caps")
        if level % 6 == 5:
            node = node.repartition("node")
    return node.selectExpr("element_at(names, 1) as block", "caps as counts").where("block is not null")


def shuffle(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """A uniformly random order of ``docs`` in ``shards`` shards whose counts differ by one at most.

    Rows are permuted within their scan partition (a local sort by a hash, no exchange), the block's
    counts of the communication matrix deal them to shards, and one exchange by (shard, step)
    permutes them again; ``slot`` is the place in the shard. The permuted rows are written once in the
    shared folder, so that counts and rows agree even if an executor is lost. No task holds a shard:
    each is cut into hashed steps.

    Returns ``doc_id, size, text_crc32, shard, slot``. Size is the text's UTF-8 bytes plus 1; null texts have size
    1 and the checksum of nothing, 0. Null and repeated ids are rows like any other. An empty table gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).sortWithinPartitions("turn", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("block", F.spark_partition_id().cast("long")).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = written(rows, "permuted")
    blocks = written(rows.groupBy("block").agg(F.count("*").alias("n")), "blocks")
    n_blocks, n = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    deal = matrix(blocks, n_blocks, shards, seed)
    if n_blocks * shards * 8 < 8 << 20:
        deal = F.broadcast(deal)
    # The shard of the row-th row of a block: how many running totals it has passed.
    passed = "aggregate(counts, named_struct('sum', 0L, 'n', 0), (a, c) -> named_struct('sum', a.sum + c, 'n', a.n + if(row >= a.sum + c, 1, 0)), a -> a.n)"
    steps = max(1, min(1 << 20, n // (shards * ROWS_A_STEP)))
    dealt = rows.join(deal, "block").withColumn("shard", F.expr(passed))
    dealt = dealt.withColumn("again", F.xxhash64(F.lit(seed + 1), "turn", "block", "row")).withColumn("step", F.pmod("again", F.lit(steps)))
    counts = dealt.groupBy("shard", "step").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "step", (F.sum("n").over(Window.partitionBy("shard").orderBy("step")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "step").orderBy("again", "block", "row")) - 1
    out = dealt.withColumn("place", place).join(starts, ["shard", "step"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


