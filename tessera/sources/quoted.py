"""Delimited files whose quoted cells hold line breaks, split all the same.

Whether a line break ends a record depends on everything before it in the file, but only through one bit: whether a quoted cell is open. Each block of a file (what one
task reads of it) is summarised by the bit it ends with, for either bit it may begin with; these compose over a file's blocks, so every block learns where it begins
and takes its lines apart by itself. What a block's first lines still owe to the record before is stitched to it afterwards.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.scratch import written

#: Blocks whose beginnings are broadcast; more are joined by a shuffle.
FEW = 100_000


def open_after(line: str, sep: str, opened: bool) -> bool:
    """Whether a quoted cell is open behind a line. A quote opens a cell only where the cell begins; two in a row within it are one sign; behind its end the rest is plain."""
    at, n = 0, len(line)
    while True:
        if opened:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at += 1
        elif line[at : at + 1] == '"':
            at, opened = at + 1, True
            continue
        # On to the next cell.
        at, opened = line.find(sep, at), False
        if at < 0:
            return False
        at += 1
        if at >= n:
            return False


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in a block's order to one row a block and batch: the bits behind them, for either bit before."""
    for b in batches:
        out: list[list] = []
        now = None
        for file, block, at, sep, line in zip(*[b.column(c).to_pylist() for c in ("file", "block", "at", "sep", "value")], strict=True):
            if (file, block) != now:
                now = file, block
                out.append([file, block, at, False, True])
            last = out[-1]
            if '"' in line:
                same = last[3] == last[4]
                last[3] = open_after(line, sep, last[3])
                last[4] = last[3] if same else open_after(line, sep, last[4])
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "at", "from_closed", "from_open"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, each block with its bit, to records; ``begins`` is false for what belongs to the record before, ``ends`` for what goes on in the next block."""
    names = ["file", "block", "at", "value", "begins", "ends"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    now, opened, begins, first, lines = None, False, True, 0, []
    for b in batches:
        out = []

        def close(ends: bool) -> None:
            if lines:
                out.append((*now, first, "\n".join(lines), begins, ends))  # noqa: B023
                lines.clear()

        for file, block, at, sep, line, start in zip(*[b.column(c).to_pylist() for c in ("file", "block", "at", "sep", "value", "opened")], strict=True):
            if (file, block) != now:
                close(False)
                now, opened, begins = (file, block), start, not start
            if not lines:
                first = at
            lines.append(line)
            if opened or '"' in line:
                opened = open_after(line, sep, opened)
            if not opened:
                close(True)
                begins = True
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, first, "\n".join(lines), begins, False), types, strict=True)], names=names)


def records(lines: DataFrame) -> DataFrame:
    """``(file, block, at, value)`` of ``lines`` (file, block, at, sep, value), in order within the tasks that read them: whole records, with their line breaks, by the place where each begins.

    Two passes over the lines; between them, one row a block. A cell that is never closed takes the rest of its file. An empty table gives no row.
    """
    spark = lines.sparkSession
    told = lines.mapInArrow(_summaries, "file string, block long, at long, from_closed boolean, from_open boolean")
    # A file's summaries in its order, composed; the bit before each block is the one behind those before it.
    listed = F.array_sort(F.collect_list(F.struct("block", "at", "from_closed", "from_open")))
    behind = lambda bit, x: F.when(bit, x["from_open"]).otherwise(x["from_closed"])
    start = F.struct(F.lit(False).alias("bit"), F.array().cast("array<struct<block:bigint,opened:boolean>>").alias("seen"))
    step = lambda acc, x: F.struct(behind(acc["bit"], x).alias("bit"), F.concat(acc["seen"], F.array(F.struct(x["block"].alias("block"), acc["bit"].alias("opened")))).alias("seen"))
    each = told.groupBy("file").agg(listed.alias("blocks")).select("file", F.inline(F.aggregate("blocks", start, step)["seen"]))
    # A block's first summary says how it begins.
    begun = written(each.withColumn("nth", F.monotonically_increasing_id()).groupBy("file", "block").agg(F.min_by("opened", "nth").alias("opened")), "quoted")
    n = begun.count()
    if n <= FEW:
        placed = lines.join(F.broadcast(begun), ["file", "block"])
    else:
        placed = lines.join(begun, ["file", "block"]).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "file", "block").sortWithinPartitions("file", "block", "at")
    cut = written(placed.select("file", "block", "at", "sep", "value", "opened").mapInArrow(_records, "file string, block long, at long, value string, begins boolean, ends boolean"), "records")
    whole = cut.where("begins and ends").select("file", "block", "at", "value")
    parts = cut.where("not (begins and ends)")
    # Parts of a record follow each other in their file: each that begins one opens a number.
    order = Window.partitionBy("file").orderBy("block", "at")
    parts = parts.withColumn("nth", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("file", "nth").agg(F.min(F.struct("block", "at")).alias("place"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return whole.unionByName(joined.select("file", "place.block", "place.at", text.alias("value")))


def cells(record: Column, sep: str) -> Column:
    """A record's cells, as the csv module takes them apart."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([next(csv.reader(io.StringIO(v, newline=""), delimiter=sep), []) for v in values], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(record)
