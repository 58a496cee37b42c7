"""Removal of repeated passages: every word in a window of words that also starts earlier goes.

Windows travel as super-k-mers: consecutive windows with the same minimiser are one packed string, in the bucket
of that minimiser, where sorting the windows counts them exactly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import FACTOR, grams, mixed, words
from tessera.plans.scratch import dropped, written

WINDOW, MMER = 20, 4
#: Bytes of text whose strings a worker packs together, and that it cuts at a time.
CHUNK, PIECE = 6_000_000, 1_000_000
#: Bytes of strings that a bucket and a partition should hold (strings take some three times their text), and buckets to a partition at least.
BUCKET, PARTITION, BUCKETS_A_PARTITION = 4_000_000, 64_000_000, 16
#: One document in so many is read to find the minimisers that need several buckets.
SAMPLED = 16
NULL_ID = -(1 << 63)

_PACKED = "bucket int, kind int, n int, docs binary, ties binary, los binary, his binary, text binary"
_SPANS = "kind int, doc long, tie long, lo int, hi int, digest binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents as (doc, tie, text) in rising order, some megabytes at a time."""
    rows, held = [], 0
    for batch in batches:
        for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            rows.append((doc, tie, text.as_py() or b""))
            held += len(rows[-1][2])
            if held >= CHUNK:
                yield sorted(rows)
                rows, held = [], 0
    yield sorted(rows)


def _pieces(rows: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows in the same order, so many that their texts are PIECE bytes or one text."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[2]) > PIECE:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield held


class _Cut:
    """Super-k-mers of a chunk: first and last window (flat word positions), minimiser, owner, and their bytes."""

    def __init__(self, rows: list[tuple[int, int, bytes]], window: int, mmer: int):
        texts, docs, ties, before = [], [], [], None
        for doc, tie, text in rows:
            if (doc, tie) == before and tie:  # the same row again
                continue
            before = (doc, tie)
            texts.append(text)
            docs.append(doc)
            ties.append(tie)
        self.of = words(texts)
        self.docs, self.ties, counts = np.array(docs, np.int64), np.array(ties, np.int64), self.of.counts
        self.base = np.cumsum(counts) - counts
        n = int(counts.sum())
        self.first = self.last = self.owner = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.uint64)
        if n < window:
            return
        h = self.of.hashes()
        span, width, low = window - mmer + 1, 1, grams(h, mmer)
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        at = np.flatnonzero(np.repeat(self.base + counts, counts) - np.arange(n) >= window)
        if not len(at):
            return
        least, owner = low[at], owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        self.first, self.last = at[begin], at[np.append(begin[1:], len(at)) - 1]
        self.least, self.owner = least[begin], owner[begin]

    def strings(self, window: int) -> list[bytes]:
        joined, starts, ends = self.of.flat.tobytes(), self.of.starts, self.of.ends
        return [joined[a:b] for a, b in zip(starts[self.first].tolist(), ends[self.last + window - 1].tolist(), strict=True)] if len(self.first) else []


def _pack(window: int, mmer: int, buckets: int, salts: dict[int, int]):
    """Documents to one packed row for each bucket and chunk. Copies within a chunk are settled here: only their first travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        hot = np.array(sorted(salts), np.uint64)
        ways = np.array([salts[x] for x in sorted(salts)], np.uint64)
        for rows in _chunks(batches):
            # A bucket's parts gather over the chunk; texts are cut a piece at a time.
            held: dict[int, list] = defaultdict(list)
            seen: set[bytes] = set()
            for piece in _pieces(rows):
                cut = _Cut(piece, window, mmer)
                strings = cut.strings(window)
                if not strings:
                    continue
                fresh = np.zeros(len(strings), bool)
                for i, x in enumerate(strings):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                lo, hi = cut.first - cut.base[cut.owner], cut.last + window - cut.base[cut.owner]
                doc, tie = cut.docs[cut.owner], cut.ties[cut.owner]
                kind = np.zeros(len(strings), np.int32)
                place = mixed(cut.least + np.uint64(1))
                if len(hot):
                    where = np.minimum(np.searchsorted(hot, cut.least), len(hot) - 1)
                    is_hot = hot[where] == cut.least
                    kind[is_hot] = 1
                    salt = mixed(doc.view(np.uint64) + np.uint64(7)) % ways[where]
                    place = np.where(is_hot, mixed(place + salt), place)
                bucket = (place % np.uint64(buckets)).astype(np.int64) * 4 + kind
                bucket[~fresh] = (mixed(doc[~fresh].view(np.uint64)) % np.uint64(buckets)).astype(np.int64) * 4 + 2
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    k = int(bucket[part[0]])
                    text = b"" if k % 4 == 2 else b"\n".join([strings[i] for i in part.tolist()])
                    held[k].append((len(part), *[x[part].astype(t).tobytes() for x, t in ((doc, "<i8"), (tie, "<i8"), (lo, "<i4"), (hi, "<i4"))], text))
            seen.clear()
            out = []
            for k in sorted(held):
                n, *packed = zip(*held.pop(k), strict=True)
                text = packed.pop()
                out.append((k // 4, k % 4, sum(n), *[zip_(b"".join(x)) for x in packed], zip_(b"" if k % 4 == 2 else b"\n".join(text))))
                if len(out) >= 256 or not held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "kind", "n", "docs", "ties", "los", "his", "text"])
                    out = []

    return run


def _runs(mask: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of marked windows that follow one another in one string."""
    i = np.flatnonzero(mask)
    if not len(i):
        return i, i
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(at[i]) != 1) | (np.diff(owner[i]) != 0)
    begin = np.flatnonzero(new)
    return i[begin], i[np.append(begin[1:], len(i)) - 1]


def _settle(strings: list[bytes], doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, window: int, hot: bool) -> list:
    """Spans of repeated windows in one bucket, as columns; of a hot bucket also the windows that came first in it."""
    flat = words(strings)
    counts, ids = flat.counts, flat.numbers()
    base = np.cumsum(counts) - counts
    at = np.flatnonzero(np.repeat(base + counts, counts) - np.arange(len(ids)) >= window)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), counts)[at]
    done, h, width = 0, None, 1
    power, factor = mixed((ids + 1).astype(np.uint64)), np.full(1, FACTOR)
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            h = power[at] if h is None else h * factor + power[at + done]
            done += width
        if 2 * width <= window:
            power = power[: len(power) - width] * factor + power[width:]
        factor, width = factor * factor, 2 * width
    start = lo[owner] + at - base[owner]
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    some = order[same[1:] | same[:-1]]
    covered = np.zeros(len(h), bool)
    if len(some):
        group = np.concatenate(([0], np.cumsum(np.diff(h[some].view(np.int64)) != 0)))
        differ = np.zeros(len(some) - 1, bool)
        for i in range(window):
            x = ids[at[some] + i]
            differ |= x[1:] != x[:-1]
        if (differ & (np.diff(group) == 0)).any():  # two texts with one hash: compare the words themselves
            group = np.unique(ids[at[some][:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
        keys = (start[some], tie[owner[some]], doc[owner[some]])
        by = np.lexsort((*keys, group))
        lead = np.ones(len(by), bool)
        lead[1:] = np.diff(group[by]) != 0
        head = np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))
        later = np.zeros(len(by), bool)
        for k in keys:
            later |= k[by] != k[by][head]
        covered[some[by[later]]] = True
    a, b = _runs(covered, at, owner)
    out = [(0, doc[owner[a]], tie[owner[a]], start[a], start[b] + window, None)]
    if hot:
        from xxhash import xxh3_128_digest

        i = np.flatnonzero(~covered)
        joined = flat.flat.tobytes()
        digest = [xxh3_128_digest(joined[a:b]) for a, b in zip(flat.starts[at[i]].tolist(), flat.ends[at[i] + window - 1].tolist(), strict=True)]
        out.append((1, doc[owner[i]], tie[owner[i]], start[i], start[i] + window, digest))
    return out


def _count(window: int):
    """Packed rows in bucket order to spans."""

    def batch(kind, doc, tie, lo, hi, digest) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc.astype(np.int64)), pa.array(tie.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(digest or [None] * len(doc), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc", "tie", "lo", "hi", "digest"])

    def settled(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            strings, doc, tie, lo = [], *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            for x in held:
                strings += x[4].split(b"\n")
            for x in _settle(strings, doc, tie, lo, window, held[0][0][1] == 1):
                if len(x[1]):
                    yield batch(*x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        held: list = []
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(i)[r].as_py() for i, n in enumerate(b.schema.names)}
                doc, tie, lo, hi = (np.frombuffer(unzip(row[n]), t) for n, t in (("docs", "<i8"), ("ties", "<i8"), ("los", "<i4"), ("his", "<i4")))
                if row["kind"] == 2:
                    yield batch(0, doc, tie, lo, hi, None)
                    continue
                key = (row["bucket"], row["kind"])
                if held and held[0][0] != key:
                    yield from settled(held)
                    held = []
                held.append((key, doc, tie, lo, unzip(row["text"])))
        yield from settled(held)

    return run


def _sampled(rows: DataFrame, window: int, mmer: int) -> DataFrame:
    """``(least, n, size)`` of one document in SAMPLED: how many different strings each minimiser has, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for piece in _pieces(chunk):
                cut = _Cut(piece, window, mmer)
                least = dict(zip(cut.strings(window), cut.least.tolist(), strict=True))
                value, at, n = np.unique(np.fromiter(least.values(), np.uint64, len(least)), return_inverse=True, return_counts=True)
                size = np.bincount(at, np.fromiter(map(len, least), np.float64, len(least)), len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(size)], names=["least", "n", "size"])

    some = rows.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(SAMPLED)) == 0).mapInArrow(run, "least long, n long, size long")
    return some.groupBy("least").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def _hot(some: DataFrame, total: int, parts: int) -> dict[int, int]:
    """Minimisers whose different strings would fill a partition's share, and how many buckets each needs.

    Found from one document in SAMPLED; this only decides where strings travel, never what is found.
    There are fewer than 4 * SAMPLED * ``parts`` of them.
    """
    most = max(16, total // (4 * parts))
    return {r["least"] % (1 << 64): -(-r["n"] // most) + 1 for r in some.where(F.col("n") > most).collect()}


def repeated_spans(rows: DataFrame, window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """``(doc, tie, lo, hi)``: spans of words of ``rows`` (doc, tie, text) that repeat earlier windows. Spans may overlap.

    Partitions and buckets follow the bytes of the strings, as one document in SAMPLED foretells them.
    """
    some = written(_sampled(rows, window, mmer), "minimisers")
    n, size = some.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-size * SAMPLED // PARTITION))
    salts = _hot(some, n, parts)
    dropped(some)
    packed = rows.mapInArrow(_pack(window, mmer, max(parts * BUCKETS_A_PARTITION, -(-size * SAMPLED // BUCKET)), salts), _PACKED)
    met = (packed.repartition(parts, "bucket") if parts > usual else packed.repartition("bucket")).sortWithinPartitions("bucket", "kind")
    found = written(met.mapInArrow(_count(window), _SPANS), "spans")
    spans = found.where("kind = 0").select("doc", "tie", "lo", "hi")
    if salts:
        # Windows of hot minimisers that came first in their own bucket: only the first over all buckets stays.
        first = found.where("kind = 1").select("digest", F.struct("doc", "tie", "lo").alias("at"), "hi")
        least = first.groupBy("digest").agg(F.min("at").alias("least"))
        later = first.join(least, "digest").where("at <> least").select("at.doc", "at.tie", "at.lo", "hi")
        spans = spans.union(later)
    return spans


def _keep(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, spans in zip(b.column("text").cast(pa.binary()), b.column("spans"), strict=True):
                raw = text.as_py()
                words = (raw or b"").split()
                n = len(words)
                gone = np.zeros(n, bool)
                if spans.is_valid:
                    flat = spans.values
                    for lo, hi in zip(flat.field("lo").to_numpy(), flat.field("hi").to_numpy(), strict=True):
                        gone[lo:hi] = True
                if gone.any():
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append((kept.decode() if len(words) < n else raw and raw.decode()) if with_text else None)
            rest = [b.column(i) for i, c in enumerate(b.schema.names) if c not in ("text", "spans")]
            names = [c for c in b.schema.names if c not in ("text", "spans")]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=[*names, *out])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, mmer: int = MMER, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept`` and the columns named in ``keep``, as ``of_<name>``.

    A word goes if some window of ``window`` words over it also starts earlier: at a smaller doc_id, or earlier in
    its document. Windows are judged on the input. ``kept`` (``with_text``) is the text itself where nothing went, else the kept words
    joined by one space.

    Null texts have no words. Null ids come before all others. Rows that repeat an id are told apart, and ordered, by
    their text's hash; rows that repeat both are one document and get one answer. Texts of under ``window`` words lose
    nothing. An empty table gives no row.
    """
    ids = F.coalesce("doc_id", F.lit(NULL_ID))
    again = docs.select(ids.alias("doc")).groupBy("doc").count().where("count > 1").select("doc")
    rows = docs.select(ids.alias("doc"), "doc_id", "text", *[F.col(c).alias(f"of_{c}") for c in keep])
    if again.limit(1).count():
        marked = again.withColumn("again", F.lit(True))
        rows = rows.join(marked, "doc", "left").withColumn("tie", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0))).drop("again")
    else:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    spans = repeated_spans(rows.select("doc", "tie", "text"), window, mmer)
    of = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = rows.join(of, ["doc", "tie"], "left").select("doc_id", *[f"of_{c}" for c in keep], "text", "spans")
    types = dict(docs.dtypes)
    kept = "".join(f"`of_{c}` {types[c]}, " for c in keep)
    out = joined.mapInArrow(_keep(with_text), f"doc_id {types['doc_id']}, {kept}n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", *[f"of_{c}" for c in keep])
