"""Lexical retrieval packing: windows filled with a seed document and the documents that BM25 finds nearest to it.

Terms are token ids, so that document frequencies are one number for each id of the vocabulary. Whole windows of documents longer than one stand by
themselves; what is left of each document is sorted by its weightiest terms over all tasks, and runs of that order are the shards of an
inverted index. A shard is searched and packed in one task: its first unused document is the seed, its unused neighbours follow in the order of
their scores, and the one that no longer fits is cut there and is the next seed. The window that a task is left with goes, with the others',
into a last run over all tasks' leftovers, cut at windows again and, behind the last one, at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.plans.scratch import written

CAPACITY, END = 2048, 1
#: Ids and documents of a shard: one more document would make it larger.
SHARD, SHARD_DOCS = 1 << 21, 4096
#: How BM25 dampens repeated terms and long documents.
K1, B = 1.2, 0.75
#: Weightiest terms by which documents are sorted.
TERMS = 4


def _tokenised(tokenizer: str, capacity: int, end: int, wide: str, type_of: str):
    """Rows to whole windows (``ids`` null) and what is left of each document (``ids``), and, for each batch, terms with their document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        seen = np.zeros(0, np.int64)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms", "times"]
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(found.encode_all(b.column("text"))):
                raw += last
                ids = np.frombuffer(raw, "<u4")
                n = len(ids)
                there = np.unique(ids)
                if len(there) and there[-1] >= len(seen):
                    seen = np.concatenate((seen, np.zeros(int(there[-1]) + 1 - len(seen), np.int64)))
                seen[there] += 1
                whole = n // capacity * capacity
                for k in range(0, whole, capacity):
                    at.append(i)
                    rows.append((k, capacity, zlib.crc32(raw[4 * k : 4 * (k + capacity)]), n, None))
                if n > whole:
                    at.append(i)
                    rows.append((whole, n - whole, None, n, ids[whole:].astype(wide).tobytes()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary()]
                columns = [b.column("doc_id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]]
                none = [pa.nulls(len(at), pa.list_(t)) for t in (pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *none], names=names)
        if seen.any():
            terms = np.flatnonzero(seen)
            lists = [pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([seen[terms]], pa.list_(pa.int64()))]
            kinds = [pa.type_for_alias(type_of), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds], *lists], names=names)

    return run


def _weights(idf: np.ndarray, ids: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms, and what BM25 gives each of them where a query has it."""
    terms, times = np.unique(ids, return_counts=True)
    return terms, (idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32)


def _sorted_by(idf: np.ndarray, mean: float, wide: str):
    """Adds the weightiest terms, heaviest first, ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for raw in b.column("ids").to_pylist():
                terms, weight = _weights(idf, np.frombuffer(raw, wide), mean)
                keys.append(terms[np.argsort(-weight, kind="stable")[:TERMS]].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*b.schema.names, "heavy"])

    return run


class Index:
    """An inverted index of a shard: for each term the documents that hold it, with their weights; rows for terms that a quarter of them hold. It shrinks as documents are used."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        of = [_weights(idf, d, mean) for d in docs]
        sizes = np.fromiter((len(t) for t, _ in of), np.int64, len(docs))
        every = np.concatenate([t for t, _ in of])
        terms, place = np.unique(every, return_inverse=True)
        #: Each document's terms, as places among the shard's.
        self.of = np.split(place, np.cumsum(sizes)[:-1])
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=len(terms))
        often = 4 * counts > self.n
        # Documents by their places among those held.
        self.held = np.arange(self.n)
        doc, weight, term = np.repeat(np.arange(self.n), sizes)[order], np.concatenate([w for _, w in of])[order].astype(np.float64), place[order]
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        common = often[term]
        self.rows = np.zeros((int(often.sum()), self.n))
        self.rows[self.row[term[common]], doc[common]] = weight[common]
        self.docs, self.weight = doc[~common], weight[~common]
        self.ends = np.cumsum(np.where(often, 0, counts))

    def shrink(self, unused: np.ndarray) -> None:
        """Forget used documents once they are a third of those held."""
        stays = unused[self.held]
        if 3 * int(np.count_nonzero(stays)) > 2 * len(stays):
            return
        kept = stays[self.docs]
        self.ends = np.concatenate(([0], np.cumsum(kept)))[self.ends]
        self.docs, self.weight = (np.cumsum(stays) - 1)[self.docs[kept]], self.weight[kept]
        self.rows, self.held = np.ascontiguousarray(self.rows[:, stays]), self.held[stays]

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document held for the terms of document ``i``, others 0."""
        at = self.of[i]
        row = self.row[at]
        ends = self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        some = ends > starts
        score = self.rows[row[row >= 0]].sum(axis=0)
        if some.any():
            runs = list(map(slice, starts[some].tolist(), ends[some].tolist()))
            score += np.bincount(np.concatenate([self.docs[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), len(self.held))
        out = np.zeros(self.n)
        out[self.held] = score
        return out


def _nearest(left: np.ndarray, score: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents from the highest score on, ties in their order, at least as many as exceed ``room`` (all, if none do), and their sizes added up."""
    most = 64
    while True:
        if most < len(left):
            some = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
            near = left[some[np.argsort(-score[some], kind="stable")]]
        else:
            near = left[np.argsort(-score, kind="stable")]
        upto = np.cumsum(sizes[near])
        if upto[-1] > room or len(near) == len(left):
            return near, upto
        most *= 8


def filled(docs: list[np.ndarray], idf: np.ndarray, mean: float, capacity: int, room: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Windows of (document, from, to) that hold all ``docs``, each once, and what room the last has left.

    The first window has ``room``, as the shard before left it.
    """
    index, sizes = Index(docs, idf, mean), np.fromiter(map(len, docs), np.int64, len(docs))
    unused, first = np.ones(len(docs), bool), 0
    windows: list[list[tuple[int, int, int]]] = [[]]
    seed, start = None, 0
    while True:
        if seed is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return windows, room
            seed, start = first, 0
            unused[seed] = False
        take = min(room, int(sizes[seed]) - start)
        windows[-1].append((seed, start, start + take))
        room -= take
        if start + take < sizes[seed]:
            windows.append([])
            room, start = capacity, start + take
            continue
        asked, seed, start = seed, None, 0
        if room and unused.any():
            index.shrink(unused)
            score = index.scores(asked)
            left = np.flatnonzero(unused)
            near, upto = _nearest(left, score[left], sizes, room)
            whole = int(np.searchsorted(upto, room, "right"))
            windows[-1] += [(int(d), 0, int(sizes[d])) for d in near[:whole]]
            unused[near[:whole]] = False
            room -= int(upto[whole - 1]) if whole else 0
            if room and whole < len(near):
                # It is cut at the window's end, and what is left of it is the next seed.
                seed = int(near[whole])
                unused[seed] = False
        if not room:
            windows.append([])
            room = capacity


def _packed(idf: np.ndarray, mean: float, capacity: int, wide: str, type_of: str):
    """Rows in the order of their weightiest terms to pieces; those of the window that a task is left with keep their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # Pieces of the open window: (doc_id, start, ids, doc_tokens).
        opened: list[tuple] = []
        room, number = capacity, 0
        shard: list[tuple] = []
        size = 0

        def pieces(rows: list[tuple], sequence: int | None) -> pa.RecordBatch:
            ids = [np.ascontiguousarray(x, wide) for _, _, x, _ in rows]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            doc, start, _, n = zip(*rows, strict=True)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            keep = [x.tobytes() if sequence is None else None for x in ids]
            columns = [pa.array(doc, pa.type_for_alias(type_of)), *[pa.array(c, pa.int64()) for c in (start, sizes, crc, n)], pa.array([sequence] * len(ids), pa.int64())]
            columns += [pa.array(np.cumsum(sizes) - sizes), pa.array(keep, pa.binary()), pa.array([part] * len(ids), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal room, number, opened, shard, size
            windows, room = filled([x for _, _, x, _ in shard], idf, mean, capacity, room)
            for i, window in enumerate(windows):
                opened += [(shard[d][0], shard[d][1] + a, shard[d][2][a:b], shard[d][3]) for d, a, b in window]
                if i < len(windows) - 1:
                    yield pieces(opened, part << 33 | number)
                    number, opened = number + 1, []
            shard, size = [], 0

        for b in batches:
            for doc, start, n, raw in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")], strict=True):
                ids = np.frombuffer(raw, wide)
                if shard and (size + len(ids) > SHARD or len(shard) == SHARD_DOCS):
                    yield from close()
                shard.append((doc, start, ids, n))
                size += len(ids)
        if shard:
            yield from close()
        if opened:
            yield pieces(opened, None)

    return run


def _rest(wide: str, capacity: int, base: dict[int, int], total: int, type_of: str):
    """Leftover pieces, placed in a row over all tasks, cut where sequences end."""
    whole = total // capacity * capacity
    tail, at = [], whole
    for bit in range(capacity.bit_length(), -1, -1):
        if (total - whole) >> bit & 1:
            tail.append(at)
            at += 1 << bit
    tail = np.array([*tail, total], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, start, n, offset, raw, part in zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "offset", "ids", "part")], strict=True):
                ids = np.frombuffer(raw, wide).astype("<u4")
                place = base[part] + offset
                stops = np.unique(np.concatenate((np.arange(place // capacity * capacity, min(place + len(ids), whole) + 1, capacity), tail)))
                cuts = [place, *stops[(stops > place) & (stops < place + len(ids))].tolist(), place + len(ids)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    sequence = a // capacity * capacity if a < whole else int(tail[np.searchsorted(tail, a, "right") - 1])
                    rows.append((doc, start + a - place, z - a, zlib.crc32(ids[a - place : z - place].tobytes()), n, -1 - 2 * sequence, a - sequence))
            if rows:
                doc, *rest = zip(*rows, strict=True)
                columns = [pa.array(doc, pa.type_for_alias(type_of)), *[pa.array(c, pa.int64()) for c in rest]]
                yield pa.RecordBatch.from_arrays(columns, names=OUT)

    return run


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
ALIAS = {"bigint": "int64", "int": "int32", "string": "string"}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: each document's ids and an end id, in pieces that fill sequences of ``capacity`` with what is lexically near.

    Sequences are full, but for one of each power of two at most. Numbers of sequences are arbitrary. Document frequencies and the mean length are those
    of all documents. Null and empty texts are the end id alone; null and repeated ids and rows are documents of their own; an empty table gives no row.
    Ties of scores go to what comes first in the shard's order: by weightiest terms, then by place in the table.
    """
    type_of = dict(docs.dtypes)["doc_id"]
    alias = ALIAS[type_of]
    wide = "<u2" if max(encoder(tokenizer).full.get_vocab_size() - 1, end) < 1 << 16 else "<u4"
    schema = f"doc_id {type_of}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms array<int>, times array<long>"
    cut = written(docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, capacity, end, wide, alias), schema), "lexical")
    # At most a number for each id of the vocabulary.
    frequency = cut.where("terms is not null").select(F.inline(F.arrays_zip("terms", "times"))).groupBy("terms").agg(F.sum("times").alias("times")).collect()
    pieces = cut.where("terms is null")
    n, tokens = pieces.where("start + length = doc_tokens").agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    idf = np.zeros(max((r.terms for r in frequency), default=0) + 1)
    for r in frequency:
        idf[r.terms] = np.log1p((n - r.times + 0.5) / (r.times + 0.5))
    mean = tokens / max(n, 1)
    whole = pieces.where("ids is null").withColumn("sequence_id", -2 - 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids").withColumn("uid", F.monotonically_increasing_id())
    # Written, as a range sort asks for its keys twice.
    keyed = written(rest.mapInArrow(_sorted_by(idf, mean, wide), f"doc_id {type_of}, start long, doc_tokens long, ids binary, uid long, heavy array<int>"), "lexical")
    order = [*[F.try_element_at("heavy", F.lit(k + 1)) for k in range(TERMS)], F.col("uid")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("heavy", "uid")
    packed = written(placed.mapInArrow(_packed(idf, mean, capacity, wide, alias), f"{', '.join(f'{c} {type_of if c == 'doc_id' else 'long'}' for c in OUT)}, ids binary, part long"), "lexical")
    # One number a task: less than a window each.
    left = packed.where("sequence_id is null")
    sizes = {r.part: r["size"] for r in left.groupBy("part").agg(F.sum("length").alias("size")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]
    last = left.mapInArrow(_rest(wide, capacity, base, total, alias), ", ".join(f"{c} {type_of if c == 'doc_id' else 'long'}" for c in OUT))
    return whole.select(*OUT).unionByName(packed.where("sequence_id is not null").select(*OUT)).unionByName(last)
