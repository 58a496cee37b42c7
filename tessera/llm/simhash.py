"""SimHash fingerprints, their links by multi-index hashing, and the groups that links make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import written

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in pairs), "<u8", len(words) - shingle + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every whole text; A-Z lower-cased, words of anything but space and \\t..\\r.

    Null, empty and wordless texts have fingerprint 0; shorter texts than a shingle hash as a whole. One row a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", shingle) for t in text]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(found, "<u8").view("<i8"))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    """``n`` spans of bits, as (lowest bit, width)."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _around(segment: int, key: Column, ball: list[int]) -> Column:
    """The segment's keys that differ from ``key`` by a mask of the ball."""
    return F.transform(F.array(*[F.lit(x) for x in ball]), lambda x: F.struct(F.lit(segment).alias("segment"), key.bitwiseXOR(x).alias("key")))


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints in column ``fp`` that differ in ``radius`` bits at most.

    Two such fingerprints differ in ``radius // segments`` bits at most within some segment. Every fingerprint
    stands once in each segment's table and asks there for all keys of the small Hamming ball around its own; what it finds
    is verified over all bits, and made in the first segment that finds it. Copies have been merged before, so a bucket holds different fingerprints alone,
    and no link is lost to a cap.
    """
    near = radius // segments
    table, probe, differ = [], [], F.col("a").bitwiseXOR(F.col("b"))
    first = F  # the first segment in which a pair is near: each pair is made there alone
    for k, (low, width) in enumerate(_segments(segments)):
        mask = ((1 << width) - 1) << low
        first = first.when(F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= near, k)
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        ball = [_signed(sum(1 << low + i for i in flips)) for r in range(near + 1) for flips in combinations(range(width), r)]
        table.append(F.struct(F.lit(k).alias("segment"), key.alias("key")))
        probe.append(_around(k, key, ball))
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("at")).select("b", "at.*")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probe))).alias("at")).select("a", "at.*")
    found = asked.join(held, ["segment", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (first == F.col("segment")))
    return found.select("a", "b")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest doc_id that links lead to, itself included.

    Null ids count in no minimum (a group of null ids alone has a null component); repeated ids and rows are
    rows of their own with the same answer. Wordless texts form one group. An empty table gives no row.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    each = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = connected_components(links(each.select("fp"), radius, segments))
    each = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = each.groupBy("group").agg(F.min("first").alias("component_id"))
    answer = each.join(least, "group").select("fp", "component_id")
    return rows.join(answer, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
