"""Best-fit packing of token sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.plans.scratch import written

CAPACITY, END = 2048, 0
#: Pieces of up to CAPACITY // TINY ids are first bundled, so that the rounds are fewer than about 2 * TINY.
TINY = 64


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(uid, doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and an end id, cut only where longer than ``capacity``.

    Null and empty texts are the end id alone. ``uid`` numbers the pieces; it holds once the table is written.
    """
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(found.encode_all(b.column("text"))):
                raw += last
                for k in range(0, len(raw), 4 * capacity):
                    part = raw[k : k + 4 * capacity]
                    at.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {types['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.withColumn("uid", F.monotonically_increasing_id())


def _share(rows: DataFrame, n: int) -> int:
    """Rows that one step of a ranking should see, so that no task ranks a whole class."""
    return max(64, n // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _bundled(items: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """``(id, size)`` to place, and ``(uid, id, shift)`` for all: tiny pieces in a row share an id."""
    tiny, slot = max(1, capacity // TINY), max(1, 2 * capacity // TINY)
    small = items.where(F.col("length") <= tiny)
    steps = max(1, small.count() // 64)
    inside = Window.partitionBy("step").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("step", F.pmod(F.xxhash64("uid"), F.lit(steps)))
    small = small.withColumn("ahead", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn("slot", F.floor(F.col("ahead") / slot))
    each = Window.partitionBy("step", "slot")
    small = small.select("uid", "length", (-1 - F.min("uid").over(each)).alias("id"), (F.col("ahead") - F.min("ahead").over(each)).alias("shift"))
    small = written(small, "bundles")
    large = items.where(F.col("length") > tiny)
    ids = large.select(F.col("uid").alias("id"), F.col("length").alias("size")).union(small.groupBy("id").agg(F.sum("length").alias("size")))
    return ids, large.selectExpr("uid", "uid as id", "0L as shift").union(small.select("uid", "id", "shift"))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, sequence_id, offset)`` for ``items`` (id, size up to ``capacity``): a place in as few sequences as best-fit finds.

    A round sorts documents and gaps by size, gaps first among equals. Sweeping down from the largest, every
    document takes the nearest free gap above it, that is, the smallest that fits and that no larger document
    has taken: brackets that match. The sweep is a running sum: a gap opens a level and a document closes one, so
    a document's gap is the row before it within its level. Ranks within a class of equal size give the levels and
    settle conflicts; classes are at most 2 * capacity, so their totals fit the driver, and levels spread over all tasks.
    Then gaps shrink and the next round begins. Where a round places nothing, new sequences open: as many as the rest
    needs at least.
    """
    spark = items.sparkSession
    state = written(items.selectExpr("1 as kind", "id", "size", "cast(null as long) as got", "cast(null as long) as got_size"), "round")
    opened, rounds = 0, []
    while True:
        # Unplaced documents (kind 1), and gaps that are left (kind 0).
        docs = state.where("kind = 1 and got is null").select("kind", "id", "size")
        gaps = state.where("kind = 0").selectExpr("kind", "id", "size - coalesce(got_size, 0) as size").where("size > 0")
        now = docs.union(gaps)
        counts = {(r.kind, r["size"]): r["count"] for r in now.groupBy("kind", "size").count().collect()}
        left = {s: n for (k, s), n in counts.items() if k == 1}
        if not left:
            break
        usable = {s: n for (k, s), n in counts.items() if k == 0 and s >= min(left)}
        fresh = 0
        if not usable or min(left) > max(usable):
            total, halves = sum(s * n for s, n in left.items()), sum(n for s, n in left.items() if 2 * s > capacity)
            fresh = max(1, -(-total // capacity), halves)
        # Running level before each class, from the largest size down; a new sequence's rank is its number.
        share = _share(items, sum(left.values()) + sum(usable.values()))
        ways = {c: max(1, n // share) for c, n in counts.items() if c[0] == 1 or c[1] in usable}
        ranked = now.where(F.col("size") >= min(left)).join(F.broadcast(_table(spark, ways)), ["kind", "size"])
        ranked = ranked.withColumn("step", F.pmod(F.xxhash64("id"), F.col("ways")))
        steps = {c + (0,): counts[c] for c, w in ways.items() if w == 1}
        if any(w > 1 for w in ways.values()):
            split = ranked.where("ways > 1").groupBy("kind", "size", "step").count().collect()
            steps |= {(r.kind, r["size"], r.step): r["count"] for r in split}
        level, base = fresh, {}
        for kind, size, step in sorted(steps, key=lambda c: (-c[1], c[0], c[2])):
            base[kind, size, step] = level
            level += steps[kind, size, step] * (1 if kind == 0 else -1)
        bases = spark.createDataFrame([(*c, b) for c, b in base.items()], "kind int, size long, step long, base long")
        place = F.row_number().over(Window.partitionBy("kind", "size", "step").orderBy("id"))
        levels = F.when(F.col("kind") == 0, F.col("base") + F.col("place")).otherwise(F.col("base") - F.col("place") + 1)
        rows = ranked.withColumn("place", place).join(F.broadcast(bases), ["kind", "size", "step"])
        rows = rows.select("kind", "id", "size", "step", levels.alias("level"))
        if fresh:
            new = spark.range(fresh).select(F.lit(0).alias("kind"), (F.col("id") + opened).alias("id"), F.lit(capacity).cast("long").alias("size"), F.lit(-1).cast("long").alias("step"), (F.col("id") + 1).alias("level"))
            rows, opened = rows.union(new), opened + fresh
        sweep = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind", "step")
        after = lambda c: F.when((F.col("kind") == 0) & (F.lead("kind").over(sweep) == 1), F.lead(c).over(sweep))
        taken = (F.col("kind") == 1) & (F.lag("kind").over(sweep) == 0)
        met = rows.select("kind", "id", "size", after("id").alias("got"), after("size").alias("got_size"), F.coalesce(taken, F.lit(False)).alias("taken"))
        # Gaps below every document left are out of the game; placed documents are told by their gap.
        state = written(met.where("not taken").drop("taken"), "round")
        rounds.append(state)
    placed = spark.createDataFrame([], "id long, sequence_id long, offset long")
    for r in rounds:
        placed = placed.union(r.where("got is not null").select(F.col("got").alias("id"), F.col("id").alias("sequence_id"), (capacity - F.col("size")).alias("offset")))
    return placed


def _table(spark, ways: dict[tuple[int, int], int]) -> DataFrame:
    return spark.createDataFrame([(*c, w) for c, w in ways.items()], "kind int, size long, ways long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` ids, filled from 0 without a gap.

    Full pieces are sequences by themselves; all others, the last pieces of long documents included, go
    through ``best_fit``. Only ids and lengths take part in the rounds. Sequence numbers are arbitrary.

    Null and empty texts are one end id. Null and repeated ids and rows are documents of their own. An
    empty table gives no row.
    """
    cut = written(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    ids, members = _bundled(cut.where(F.col("length") < capacity).select("uid", "length"), capacity)
    placed = best_fit(ids, capacity)
    found = members.join(placed, "id").select("uid", "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    alone = cut.where(F.col("length") >= capacity).selectExpr("uid", "-1 - uid as sequence_id", "0L as offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return cut.join(found.union(alone), "uid").select(*columns)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_ids, ids)`` of a ``pack`` with ids: each sequence's ids, little-endian unsigned 32-bit."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), listed.alias("parts"))
    return joined.select("sequence_id", "n_ids", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
