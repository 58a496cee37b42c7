"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders, and put back together.

A unit is a run of A-Z and a-z, or any other single sign. Texts are read as UTF-8 in blocks of a fixed number of bytes; a Fenwick
tree over the blocks holds how many units end and how many code points begin in each, and descends by powers of two to the block in
which a cut falls. Only that block is then looked at sign by sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block, and of texts whose blocks are counted together.
BLOCK, CHUNK = 1024, 1_000_000
#: The marks before prefix, suffix and middle; in a hundred, texts from PLAIN on stay plain and those below SPM have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 90, 20

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that begin a code point.
HEAD = np.ones(256, bool)
HEAD[0x80:0xC0] = False


class Fenwick:
    """Prefix sums over blocks of units that end and code points that begin there: node i holds the last ``i & -i`` blocks."""

    def __init__(self, counts: np.ndarray):
        """``counts``: a row (units, code points) for each block."""
        self.n = len(counts)
        total = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)))
        at = np.arange(self.n + 1)
        self.tree = total - total[at - (at & -at)]
        self.top = 1 << self.n.bit_length() - 1 if self.n else 0

    def descend(self, units: int) -> tuple[int, int, int]:
        """The block in which unit number ``units`` (from 1) ends, and the units and code points before that block."""
        block, step, before, points = 0, self.top, 0, 0
        while step:
            if block + step <= self.n and before + self.tree[block + step, 0] < units:
                block += step
                before += int(self.tree[block, 0])
                points += int(self.tree[block, 1])
            step >>= 1
        return block, before, points


class Units:
    """The units of texts that lie in a row in one buffer."""

    def __init__(self, flat: np.ndarray, cuts: np.ndarray):
        letter = LETTER[flat]
        follows = np.zeros(len(flat), bool)
        follows[:-1] = letter[1:]
        follows[cuts[1:][np.diff(cuts) > 0] - 1] = False
        self.head = HEAD[flat]
        #: A unit ends at a letter with none behind it, and at the last byte of any other sign.
        last = np.ones(len(flat), bool)
        last[:-1] = self.head[1:]
        last[cuts[1:][np.diff(cuts) > 0] - 1] = True
        self.end = np.where(letter, ~follows, last)
        self.cuts = cuts
        # Blocks begin anew with each text.
        blocks = -(-np.diff(cuts) // BLOCK)
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        starts = np.repeat(cuts[:-1], blocks) + BLOCK * (np.arange(self.first[-1]) - np.repeat(self.first[:-1], blocks))
        sums = [np.add.reduceat(x, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for x in (self.end, self.head)]
        self.counts = np.stack(sums, axis=1)

    def of(self, i: int) -> tuple[Fenwick, int]:
        """A text's tree and its number of units."""
        counts = self.counts[self.first[i] : self.first[i + 1]]
        return Fenwick(counts), int(counts[:, 0].sum())

    def cut(self, i: int, tree: Fenwick, units: int) -> tuple[int, int]:
        """Bytes and code points of text ``i`` up to the end of its first ``units`` units."""
        if not units:
            return 0, 0
        block, before, points = tree.descend(units)
        at = int(self.cuts[i]) + block * BLOCK
        upto = min(at + BLOCK, int(self.cuts[i + 1]))
        behind = int(np.flatnonzero(self.end[at:upto])[units - before - 1]) + 1
        return block * BLOCK + behind, points + int(np.count_nonzero(self.head[at : at + behind]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
        yield at, upto
        at = upto


def _cut(seed: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = pc.fill_null(b.column("text").cast(pa.binary()), b"")
            for at, upto in _chunks(every):
                texts, ids = every.slice(at, upto - at).to_pylist(), b.column("doc_id").slice(at, upto - at)
                cuts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
                units = Units(np.frombuffer(b"".join(texts), np.uint8), cuts)
                rows = []
                for i, (doc_id, text) in enumerate(zip(ids.to_pylist(), texts, strict=True)):
                    tree, n = units.of(i)
                    h1, h2, h3, h4 = draws(doc_id, seed)
                    if not text or h3 % 100 >= PLAIN or any(mark in text for mark in marks):
                        rows.append((n, "plain", None, None, text))
                        continue
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (a, a_points), (z, z_points) = units.cut(i, tree, first), units.cut(i, tree, second)
                    spm = h4 % 100 < SPM
                    out = [s, text[z:], p, text[:a], m, text[a:z]] if spm else [p, text[:a], s, text[z:], m, text[a:z]]
                    rows.append((n, "spm" if spm else "psm", a_points, z_points - a_points, b"".join(out)))
                n, form, before, within, out = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: each text with its middle moved to the end.

    ``n`` counts units. Both cuts are drawn from the id and ``seed`` alone, evenly over the n + 1 borders. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (the text itself: empty, one that holds a mark, or one that is
    drawn to stay); sizes are in code points, null where plain.

    A null text is empty, a null id draws as an empty one. Repeated rows are rows of their own with the same cuts; an empty table gives no
    row. Rows are independent of each other: nothing is shuffled, and a task holds CHUNK bytes of texts or one longer text.
    """
    types = dict(docs.dtypes)
    return docs.select("doc_id", "text").mapInArrow(_cut(seed), f"doc_id {types['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form"):
    """The column of exact texts, rebuilt from ``output`` and ``form`` alone: marks stand once each, in the form's order."""
    out = F.col(output)

    def between(left: str, right: str | None):
        begin = F.locate(left, out) + len(left)
        return F.substring(out, begin, (F.locate(right, out) if right else F.length(out) + 1) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
