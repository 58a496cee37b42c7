"""Token counts of whole texts, without their ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder
from tessera.plans.scratch import written

#: Most frequent pre-tokens whose counts every worker holds; all others are joined.
HEAD = 100_000
#: Bytes of the frequent pre-tokens of 64 and more characters that every worker holds besides.
LONG_HEAD = 4_000_000
#: Different pre-tokens a task counts before it hands them on.
FLUSH = 200_000


def _frequencies(tokenizer: str):
    """Pre-tokens of a task's documents with how often they came, added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = encoder(tokenizer), Counter()

        def out() -> pa.RecordBatch:
            of = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])
            seen.clear()
            return of

        for b in batches:
            for units, where, _ in found.chunks(b.column("text")):
                n = np.bincount(where, minlength=len(units))
                once = n == 1
                # What came once in a chunk goes on as it is: adding it up here would seldom spare a row.
                yield pa.RecordBatch.from_arrays([units.filter(pa.array(once)), pa.array(n[once])], names=["unit", "n"])
                seen.update(dict(zip(units.filter(pa.array(~once)).to_numpy(zero_copy_only=False), n[~once].tolist(), strict=True)))
                if len(seen) >= FLUSH:
                    yield out()
        yield out()

    return run


def _pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("n"), pa.array(found.flat(b.column("unit"))[1].astype(np.int64))], names=["unit", "n", "pieces"])

    return run


def _documents(tokenizer: str, head):
    """Per document: what its frequent pre-tokens add up to, and the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = encoder(tokenizer), head.value
        kind = pa.list_(pa.struct([("unit", pa.string()), ("f", pa.int64())]))
        for b in batches:
            at = 0
            for units, where, ends in found.chunks(b.column("text")):
                n = len(ends) - 1
                pieces = np.fromiter((known.get(u, -1) for u in units.to_numpy(zero_copy_only=False)), np.int64, len(units))
                of = pieces[where]
                heads = np.concatenate(([0], np.cumsum(np.maximum(of, 0))))[ends]
                # The rare ones: one number for each pair of document and unit, so equal pairs are counted by sorting.
                rare = np.flatnonzero(of < 0)
                pairs, f = np.unique((np.searchsorted(ends, rare, "right") - 1) * len(units) + where[rare], return_counts=True)
                doc, unit = np.divmod(pairs, max(1, len(units)))
                offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([units.take(pa.array(unit)), pa.array(f.astype(np.int64))], fields=list(kind.value_type)))
                size = pc.fill_null(pc.binary_length(b.column("text").slice(at, n)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), size, pa.array(np.diff(heads)), rest], names=["doc_id", "n_bytes", "n_head", "rest"])
                at += n

    return run


def _least(classes: list[tuple[int, int]], bound: int) -> int:
    """The lowest class, from the highest on, down to which the sizes stay within the bound."""
    least, held = 64, 0
    for p, n in classes:
        if held + n > bound:
            break
        least, held = p, held + n
    return least


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text.

    A pre-token here is what stands between white space, where token boundaries always fall. Each distinct
    one is tokenized once in the corpus. Documents join their own frequencies of pre-tokens to those
    counts and sum: the HEAD most frequent ones are a broadcast table of bounded size and are summed where the document
    is read; the rare rest is joined by a shuffle, and no pre-token of it is frequent enough to be a hot key.

    Null and empty texts have 0 bytes and 0 tokens. Null and repeated ids and rows are rows of their own. Special
    strings count as the library's default has them. An empty table gives no row.
    """
    spark, types = docs.sparkSession, dict(docs.dtypes)
    found = docs.select("text").mapInArrow(_frequencies(tokenizer), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = written(found.mapInArrow(_pieces(tokenizer), "unit string, n long, pieces long"), "units")
    # The head is the largest set of whole frequency classes (powers of two) that stays within HEAD.
    power = F.floor(F.log2("n")).cast("int")
    # Those of 64 and more characters have a bound of bytes of their own.
    short = F.length("unit") < 64
    classes = units.groupBy(power.alias("p")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~short, F.octet_length("unit"))), F.lit(0)).alias("size"))
    classes = classes.orderBy(F.desc("p")).collect()
    least = _least([(r.p, r.n) for r in classes], HEAD)
    least_long = _least([(r.p, r["size"]) for r in classes], LONG_HEAD)
    rows = units.where((short & (power >= least)) | (~short & (power >= F.greatest(F.lit(least), F.lit(least_long))))).select("unit", "pieces").collect()
    head = spark.sparkContext.broadcast({r.unit: r.pieces for r in rows})
    kind = f"doc_id {types['doc_id']}, n_bytes long, n_head long, rest array<struct<unit: string, f: long>>"
    each = docs.select("doc_id", "text").mapInArrow(_documents(tokenizer, head), kind)
    each = written(each.withColumn("uid", F.monotonically_increasing_id()), "frequencies")
    rare = each.select("uid", F.inline("rest")).join(units.select("unit", "pieces"), "unit")
    sums = rare.groupBy("uid").agg(F.sum(F.col("f") * F.col("pieces")).alias("n_rest"))
    tokens = (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_tokens")
    return each.join(sums, "uid", "left").select("doc_id", "n_bytes", tokens, (tokens > limit).alias("over_limit"))
