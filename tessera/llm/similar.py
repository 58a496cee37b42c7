"""Near duplicates by word shingles: SimHash with multi-index hashing finds who may be near, exact similarity decides.

Fingerprints are wide and made from pairs of words, so that texts whose five-word shingles agree to 0.8 differ in some
tenth of the bits. Each segment of a fingerprint is looked up under all keys of a small Hamming ball: the one spanned by the
bits that the text decides least clearly, which are those that its near duplicates are likely to flip. At 0.8 a tail that was appended turns some
seventh of the bits, more than any affordable ball; so texts also stand under bands of smallest hashes of their shingles, which agree as often as the sets do. Texts that meet
under a segment and whose check words are near, and texts that meet under a band, make up neighbourhoods. Within these, and only there, all sets of shingles are
compared, by tiles of bounded size. Nothing is ever emitted for all pairs: buckets and tiles give spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import grams, mixed, words
from tessera.operators.components import connected_components
from tessera.plans.scratch import dropped, written

#: Words of a shingle that a fingerprint is made from; segments, their bits, and the bits of each that span its ball.
PAIR, SEGMENTS, WIDTH, BALL = 2, 9, 35, 2
#: Bands of smallest hashes, and hashes of a band: sets that agree to 0.8 share a band but for one pair in a hundred.
BANDS, ROWS = 16, 6
#: Bits of the fingerprint: the segments', and those of a check word in which near texts differ by CHECK bits at most.
BITS, CHECK = 384, 15
#: Texts of a block of a neighbourhood, and bytes of their shingles; two blocks make a tile.
BLOCK, BLOCK_BYTES = 256, 2_000_000
#: Members of a bucket that are compared all with all; of larger ones, all with leaders.
ALL = 1024

_EVEN = np.uint64(0x0001000100010001)
_SHIFTS = np.arange(16, dtype=np.uint64)


def totals(h: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, how many of the hashes set it."""
    out = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        for word in range(BITS // 64):
            lanes = ((mixed(part + np.uint64(word + 1))[:, None] >> _SHIFTS) & _EVEN).sum(axis=0, dtype=np.uint64)
            # Lane k of shift s counts bit 16 * k + s.
            out[64 * word : 64 * word + 64] += lanes.view("<u2").reshape(16, 4).T.ravel()
    return out


def keys(total: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The keys under which a text stands in all segments, (segment, ball) in rows, and its check word."""
    side = 2 * total - n
    bits = side > 0
    part = bits[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    weak = np.argsort(np.abs(side[: SEGMENTS * WIDTH]).reshape(SEGMENTS, WIDTH), axis=1, kind="stable")[:, :BALL]
    place = np.int64(1) << np.arange(WIDTH, dtype=np.int64)
    value = (part * place).sum(axis=1) | (np.arange(SEGMENTS, dtype=np.int64) << WIDTH)
    flips = np.zeros((SEGMENTS, 1 << BALL), np.int64)
    for m in range(1 << BALL):
        for k in range(BALL):
            if m >> k & 1:
                flips[:, m] |= place[weak[:, k]]
    return value[:, None] ^ flips, int(np.packbits(bits[BITS - 64 :], bitorder="little").view("<i8")[0])


_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A negative key for each band of a set of hashes, made of the smallest under ROWS orders of them."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1 << 12):
        part = h[at : at + (1 << 12)]
        # An odd factor permutes all hashes, its upper bits depend on all of theirs.
        np.minimum(least, (part * _SEEDS[:, None]).min(axis=1), out=least)
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    key = mixed(key + np.arange(BANDS, dtype=np.uint64)) | np.uint64(1 << 63)
    return key.view(np.int64)


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row the packed keys, of segments and of bands, and the check word; null without words."""
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()):
                one = words([text.as_py() or b""], lower=True).hashes()
                if not len(one):
                    out.append(None)
                    continue
                h = grams(one, min(PAIR, len(one)))
                of, check = keys(totals(h), len(h))
                band = bands(grams(one, min(shingle, len(one))))
                out.append(of.astype("<i8").tobytes() + band.astype("<i8").tobytes() + np.int64(check).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h1"), b.column("h2"), pa.array(out, pa.binary())], names=["key", "h1", "h2", "print"])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of the tables for each key of each text."""
    each = (SEGMENTS << BALL) + BANDS
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            some = b.slice(at, 4096)
            of = np.frombuffer(b"".join(some.column("print").to_pylist()), "<i8").reshape(-1, each + 1)
            c = np.repeat(some.column("c").to_numpy(), each)
            yield pa.RecordBatch.from_arrays([pa.array(of[:, :each].ravel()), pa.array(c), pa.array(np.repeat(of[:, each], each))], names=["key", "c", "word"])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges, those that first join two trees."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _near(check: np.ndarray, most: int = CHECK, all_with_all: int = ALL) -> list[tuple[int, int]]:
    """A forest that holds together all members of a bucket whose check words differ in ``most`` bits or fewer.

    Large buckets go by leaders: a member farther than ``most`` from every leader becomes one, and every member hangs on all
    leaders within twice that, so two near members share one. What hangs together too much is parted by the exact comparison.
    """
    n = len(check)
    if n <= all_with_all:
        a, b = np.nonzero(np.triu(np.bitwise_count(check[:, None] ^ check) <= most, 1))
        return forest(n, a, b)
    free, a, b = np.ones(n, bool), [], []
    while free.any():
        lead = int(np.argmax(free))
        far = np.bitwise_count(check ^ check[lead])
        free &= far > most
        some = np.flatnonzero(far <= 2 * most)
        a.append(np.full(len(some), lead))
        b.append(some)
    return forest(n, np.concatenate(a), np.concatenate(b))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys to forests of buckets. Arrow batches may cut a bucket: its rows wait for the next."""
    left = [np.zeros(0, np.int64)] * 3

    def edges(key: np.ndarray, c: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        out = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.append(cuts, len(key))
        for i in np.flatnonzero(ends - starts > 1).tolist() if len(key) else []:
            of, first = np.unique(c[starts[i] : ends[i]], return_index=True)
            word = check[starts[i] : ends[i]][first].view(np.uint64)
            if key[starts[i]] < 0:
                # All of a band are likely alike: each hangs on the first.
                out += [(int(of[0]), int(x)) for x in of[1:]]
            elif len(of) == 2:
                if int(word[0] ^ word[1]).bit_count() <= CHECK:
                    out.append((int(of[0]), int(of[1])))
            elif len(of) > 2:
                out += [(int(of[x]), int(of[y])) for x, y in _near(word)]
        found = sorted(set(out))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate((x, batch.column(n).to_numpy())) for x, n in zip(left, ("key", "c", "word"), strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if whole:
            yield edges(*[x[:whole] for x in now])
        left = [x[whole:] for x in now]
    yield edges(*left)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()):
                h = words([text.as_py() or b""], lower=True).hashes()
                out.append(np.unique(grams(h, min(shingle, len(h)))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("hood"), pa.array(out, pa.binary())], names=["c", "hood", "shingles"])

    return run


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A forest of the pairs (one of ``left``, one of ``right``) whose Jaccard similarity is ``similarity`` or more."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    # Shingles that one text alone has count in sizes only.
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(sets), min(4096, n - at)), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        both += has[left] @ has[right].T
    whole = size[left][:, None] + size[right] - both
    x, y = np.nonzero(both >= similarity * whole - 1e-6)
    x, y = left[x], right[y]
    return forest(len(sets), x[x != y], y[x != y])


def _compared(similarity: float):
    """Rows in the order of their tiles to the forests of similar texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, bool, bool]] = {}
        now, out = None, []

        def close() -> None:
            ids = list(held)
            sets = [held[c][0] for c in ids]
            left, right = (np.array([i for i, c in enumerate(ids) if held[c][k]], np.int64) for k in (1, 2))
            out.extend((ids[x], ids[y]) for x, y in alike(sets, left, right, similarity))

        def done() -> pa.RecordBatch:
            of = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out.clear()
            return of

        for b in batches:
            tiles = zip(*[b.column(n).to_pylist() for n in ("hood", "low", "high", "block", "c")], b.column("shingles"), strict=True)
            for hood, low, high, block, c, shingles in tiles:
                if (hood, low, high) != now:
                    if len(held) > 1:
                        close()
                    held, now = {}, (hood, low, high)
                if c not in held:
                    held[c] = np.frombuffer(shingles.as_py(), np.uint64), block == low, block == high
            if out:
                yield done()
        if len(held) > 1:
            close()
        yield done()

    return run


def _verified(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges of ``members`` (c, hood) whose ``texts`` (c, text) are similar: a forest of each tile."""
    sets = texts.join(members, "c").mapInArrow(_sets(shingle), "c long, hood long, shingles binary")
    sets = written(sets, "shingles")
    sizes = sets.groupBy("hood").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = sets.join(sizes, "hood").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # Blocks i and j meet in the tile (i, j): a text goes to one tile for each block of its neighbourhood.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("hood", "c", "block", "shingles", other.alias("other"))
    rows = rows.select("hood", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "c", "shingles")
    met = rows.repartition("hood", "low", "high").sortWithinPartitions("hood", "low", "high")
    return written(met.mapInArrow(_compared(similarity), "a long, b long"), "alike")


def classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Texts and their groups: ``(h1, h2, group)`` of every different text, and ``(key, h1, h2, group, first, repeats)`` of every
    different row of id and text, where ``first`` says that it stands for its group.

    A group is what pairs of similar texts connect: their sets of shingles (A-Z lower-cased words of anything but space and \\t..\\r; of shorter
    texts the whole) have a Jaccard similarity of ``similarity`` or more. Wordless and null texts are alike and form one group.
    """
    null = F.col("doc_id").isNull()
    key = F.struct(null.alias("null"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"))
    rows = docs.select(key.alias("key"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    prints = rows.select(F.col("key.id").alias("key"), "h1", "h2", "text").mapInArrow(_prints(shingle), "key long, h1 long, h2 long, print binary")
    # Copies of a text are one from here on.
    each = prints.groupBy("h1", "h2").agg(F.min("print").alias("print"))
    each = written(each.withColumn("c", F.monotonically_increasing_id()), "prints")
    tables = each.where("print is not null").select("c", "print").mapInArrow(_tables, "key long, c long, word long")
    met = tables.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long")
    hoods = connected_components(met)
    members = written(hoods.select(F.col("node").alias("c"), F.col("component").alias("hood")), "hoods")
    # One text for each class that has a neighbour: copies are merged where they are read.
    named = each.select("c", "h1", "h2").join(members.select("c"), "c")
    texts = rows.select("h1", "h2", "text").join(named, ["h1", "h2"]).groupBy("c").agg(F.first("text").alias("text"))
    links = _verified(members, texts, shingle, similarity)
    found = connected_components(links).withColumnRenamed("node", "c")
    group = F.when(F.col("print").isNull(), F.lit(-1)).otherwise(F.coalesce("component", "c"))
    of = written(each.join(found, "c", "left").select("h1", "h2", group.alias("group")), "groups")
    single = rows.groupBy("key", "h1", "h2").agg(F.count("*").alias("repeats")).join(of, ["h1", "h2"])
    lead = single.groupBy("group").agg(F.min(F.struct("key", "h1", "h2")).alias("lead"))
    single = single.join(lead, "group").select("key", "h1", "h2", "group", (F.struct("key", "h1", "h2") == F.col("lead")).alias("first"), "repeats")
    dropped(members, links, each)
    return of, written(single, "rows")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id, whole rows as they are.

    Rows are told apart by id and text. Null ids come last: such a row stays only if its group has no other. Where one
    id has several texts of a group, the one of the smallest hash stays; of rows that repeat id and text, any one. An empty
    table gives no row.
    """
    _, rows = classes(docs, shingle, similarity)
    stay = rows.where("first").select(F.col("key.null").alias("_null"), F.col("key.id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "repeats")
    names = ["_null", "_id", "_h1", "_h2"]
    told = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"),
        F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2"),
    )
    kept = told.join(stay.where("repeats = 1").select(*names), names, "left_semi").select("_row.*")
    again = stay.where("repeats > 1").select(*names)
    if again.limit(1).count():
        kept = kept.unionByName(told.join(again, names, "left_semi").dropDuplicates(names).select("_row.*"))
    return kept
