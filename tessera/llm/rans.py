"""Token-ID output in entropy-coded blocks: a static range asymmetric numeral system with shared frequency tables.

A file set is a Parquet folder ``blocks`` of independent blocks, in ascending document order, and one of the shared
table. A block holds whole documents' ids, dealt to interleaved lanes and coded
with one table, so any block can be read alone; checkpoints inside it are lane states and word positions from which
parts of it decode alone, and checksums guard ids and codes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.plans.scratch import dropped, shared_dir, written

#: Frequencies add up to 2 ** PRECISION; LANES states are coded side by side.
PRECISION, LANES = 20, 2048
#: Ids in a block, and steps of all lanes between two checkpoints.
BLOCK, CHECKPOINT = 1_000_000, 128
VERSION = 1
LOW = np.uint64(1 << 31)

_BLOCK = "part int, block long, version int, n_ids long, docs binary, lengths binary, crcs binary, states binary, marks binary, codes binary, crc long"


def normalised(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of sum 2 ** precision, at least 1 for whatever occurs; the excess goes to the most frequent."""
    total, size = int(counts.sum()), 1 << precision
    if not total:
        return np.zeros(len(counts), np.uint64)
    if (counts > 0).sum() > size:
        raise ValueError("more symbols than the precision can tell apart")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    spare = size - int(freq.sum())
    if spare >= 0:
        freq[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        cut = min(-spare, int(freq[i]) - 1)
        freq[i] -= cut
        spare += cut
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes id arrays by one frequency table. States stay in [2**31, 2**63); renormalisation moves 32 bits."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.freq, self.precision = freq.astype(np.uint64), np.uint64(precision)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (uint32), states (a row of lanes for each checkpoint, the first at the block's start), and where each reads on.

        Id k is in lane k % lanes. Encoding runs backward so that decoding runs forward.
        """
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out, states, marks, written_ = [], [], [], 0
        limit = (LOW >> self.precision) << np.uint64(32)
        for step in range(steps - 1, -1, -1):
            s = ids[step * lanes : (step + 1) * lanes]
            x, f = state[: len(s)], self.freq[s]
            full = x >= limit * f
            if full.any():
                out.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
                written_ += len(out[-1])
                x[full] >>= np.uint64(32)
            q = x // f
            state[: len(s)] = (q << self.precision) + (x - q * f) + self.start[s]
            if step % every == 0:
                states.append(state.copy())
                marks.append(written_)
        codes = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
        return codes, np.array(states[::-1], np.uint64).reshape(-1, lanes), len(codes) - np.array(marks[::-1], np.int64)

    def decode(self, codes: np.ndarray, states: np.ndarray, marks: np.ndarray, n: int, every: int = CHECKPOINT, only: int | None = None) -> np.ndarray:
        """The ids; with ``only`` those from that checkpoint to the next."""
        lanes = states.shape[1]
        steps = range(-(-n // lanes)) if only is None else range(only * every, min(-(-n // lanes), (only + 1) * every))
        at = int(marks[only or 0]) if len(marks) else 0
        state, out = (states[only or 0].copy() if len(states) else None), []
        mask = np.uint64((1 << int(self.precision)) - 1)
        for step in steps:
            k = min(lanes, n - step * lanes)
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            x = self.freq[s] * (x >> self.precision) + slot - self.start[s]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << np.uint64(32) | codes[at : at + len(low)].astype(np.uint64)
            at += len(low)
            state[:k] = x
            out.append(s)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _tokenized(tokenizer: str, end: int):
    """Ids of each document (kind 0), and one row with the counts of all ids of the task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last, total = encoder(tokenizer), np.array([end], "<u4").tobytes(), np.zeros(1 << 16, "<i8")
        if found.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits need another tokenizer")

        def out(kind: int, docs: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), docs, pa.array(ids, pa.binary())], names=["kind", "doc_id", "ids"])

        for b in batches:
            small = [np.frombuffer(x + last, "<u4").astype("<u2") for x in found.encode_all(b.column("text"))]
            if small:
                total += np.bincount(np.concatenate(small), minlength=1 << 16)
            yield out(0, b.column("doc_id"), [x.tobytes() for x in small])
        yield out(1, pa.nulls(1, pa.int64()), [total.tobytes()])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for counts in b.column("ids"):
            total += np.frombuffer(counts.as_py(), "<i8")
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["symbol", "n"])


def _encoded(freq):
    """Blocks from rows as they were written: each part's in rising order, a block named by its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first, last, held, size = Coder(freq.value), -1, 0, -1, [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            codes, states, marks = coder.encode(ids)
            codes, named = codes.astype("<u4").tobytes(), [d is not None for d, _ in held]
            row = {
                "part": part, "block": first, "version": VERSION, "n_ids": len(ids),
                "docs": np.packbits(named).tobytes() + np.array([d or 0 for d, _ in held], "<i8").tobytes(), "lengths": np.array([len(x) for _, x in held], "<i4").tobytes(),
                "crcs": np.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in held], "<u4").tobytes(),
                "states": states.astype("<u8").tobytes(), "marks": marks.astype("<i8").tobytes(), "codes": codes, "crc": zlib.crc32(codes),
            }
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 6 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for b in batches:
            for p, row, doc, ids in zip(b.column("part").to_pylist(), b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if p == part and row <= last:
                    raise ValueError(f"rows of part {p} are out of order")
                if held and (size >= BLOCK or p != part):
                    yield block()
                    held, size = [], 0
                if not held:
                    first = row
                part, last = p, row
                held.append((doc, np.frombuffer(ids.as_buffer(), "<u2")))
                size += len(held[-1][1])
        if held:
            yield block()

    return run


def _decoded(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            for r in b.to_pylist():
                if r["version"] != VERSION or zlib.crc32(r["codes"]) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                lengths = np.frombuffer(r["lengths"], "<i4")
                states = np.frombuffer(r["states"], "<u8").reshape(-1, LANES)
                ids = coder.decode(np.frombuffer(r["codes"], "<u4"), states, np.frombuffer(r["marks"], "<i8"), r["n_ids"]).astype("<u4")
                n = len(lengths)
                named = np.unpackbits(np.frombuffer(r["docs"], np.uint8, -(-n // 8)))[:n].astype(bool)
                docs = np.frombuffer(r["docs"], "<i8", offset=-(-n // 8))
                ends = np.cumsum(lengths, dtype=np.int64)
                parts = [ids[a - k : a].tobytes() for a, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                crcs = np.array([zlib.crc32(x) for x in parts], np.int64)
                if (crcs != np.frombuffer(r["crcs"], "<u4")).any():
                    raise ValueError(f"ids of block {r['block']} of part {r['part']} do not match their checksums")
                whole = [np.full(n, r["part"], np.int32), np.full(n, r["block"], np.int64)]
                columns = [*map(pa.array, whole), pa.array(docs, pa.int64(), mask=~named), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "ahead", "n_tokens", "ids_crc32", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 0) -> None:
    """Write ``docs`` as files of the format under ``path``: ids of each whole text and ``end``, in ascending doc_id order.

    Documents are range-sorted, tokenized where they land, counted over the whole corpus, and coded with the table that
    those counts give. Null ids come first, null texts are empty, repeated ids follow one another in the order of
    their texts' hashes. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    ids = written(ranged.mapInArrow(_tokenized(tokenizer, end), "kind int, doc_id long, ids binary").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = ids.where("kind = 1").select("ids").mapInArrow(_counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # the vocabulary bounds it
    total = np.zeros(max([0, *(r.symbol for r in rows)]) + 1, np.int64)
    for r in rows:
        total[r.symbol] = r.n
    freq = normalised(total)
    table = [(int(s), int(freq[s])) for s in np.flatnonzero(freq)]
    spark.createDataFrame(table, "symbol int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    # A part is a file of its own and is read in the order in which it was written: no second exchange.
    sorted_ids = ids.where("kind = 0").select("part", "row", "doc_id", "ids")
    sorted_ids.mapInArrow(_encoded(shared), _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    dropped(ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` from the files: every block decoded by itself and checked.

    ``start`` counts the ids of all documents before. It comes from the blocks' lengths: a sum over parts, and one over the blocks of
    each part. ``ids`` are little-endian unsigned 32-bit. Damaged blocks raise ValueError.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # the vocabulary bounds it
    freq = np.zeros(max([0, *(r.symbol for r in rows)]) + 1, np.uint64)
    for r in rows:
        freq[r.symbol] = r.freq
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.withColumn("before_block", inside).join(parts, "part").select("part", "block", (F.col("before_part") + F.col("before_block")).alias("before"))
    kind = "part int, block long, doc_id long, ahead long, n_tokens long, ids_crc32 long, ids binary"
    each = blocks.mapInArrow(_decoded(spark.sparkContext.broadcast(freq)), kind)
    return each.join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", "ids")


def scratch_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
