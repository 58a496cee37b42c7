"""Landing, Bronze and Silver tables: scans, manifests, hashes and sinks."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import trim
from tessera.plans.scratch import written
from tessera.sources import quoted

DELIMITERS = ",;|\t"
#: Contract types and the Spark types that hold them; unknown words are text.
TYPES = {"string": T.StringType(), "int64": T.LongType(), "decimal": T.DecimalType(18, 4), "date": T.DateType(), "timestamp_utc": T.TimestampType(), "bool": T.BooleanType(), "uuid": T.StringType(), "json": T.StringType()}
NAME = re.compile(r"^[a-z][a-z0-9_]{0,50}$")
AUDIT = ("source_system", "ingestion_ts", "batch_id", "record_hash", "created_ts", "updated_ts")


def clean_header(cells: list[str]) -> list[str]:
    """Stripped names; blanks become ``column_<i>``, the n-th repeat of a name ``<name>_<n>``."""
    names, repeats = [], {}
    for i, cell in enumerate(cells, 1):
        name = cell.strip() or f"column_{i}"
        repeats[name] = repeats.get(name, -1) + 1
        names.append(f"{name}_{repeats[name]}" if repeats[name] else name)
    return names


def sniff(head: str) -> str:
    """The delimiter that the lines of the first 8192 characters agree on, outside quotes: the one that most of them hold equally
    often, more often before less often; else a comma."""
    lines = [x for x in re.sub(r'"[^"]*"', "", head[:8192]).splitlines() if x.strip()]
    best, held = ",", (0, 0)
    for d in DELIMITERS:
        n = lines[0].count(d) if lines else 0
        like = (sum(x.count(d) == n for x in lines), n) if n else (0, 0)
        if like > held:
            best, held = d, like
    return best


def table_name(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"not a feed or table name: {name!r}")
    return name


#: Lines of a file that its delimiter is told from.
HEAD = 200


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, at, value)``: lines as they lie there, without their ends, in order within the task that reads them."""
    raw = spark.read.text(path, lineSep="\n")
    bare = F.when(F.col("value").endswith("\r"), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"), bare.alias("value"))


def _decoded(encoding: Column | str, raw: str = "raw", value: str = "value") -> Column:
    """Text of other files than UTF-8 ones, from their bytes."""
    named = F.lit(encoding) if isinstance(encoding, str) else encoding
    other = F.rtrim(F.decode(F.col(raw).cast("binary"), encoding if isinstance(encoding, str) else "ISO-8859-1"), F.lit("\r"))
    return F.when(F.upper(named) == "UTF-8", F.col(value)).otherwise(other)


def _files(spark: SparkSession, path: str, sep: str | None, encoding: str | None) -> list:
    """One row a file, by name: its charset (UTF-8, else Latin-1), delimiter, header, and whether some quote is left open at a line's end."""
    lines = _lines(spark, path)
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    each = lines.groupBy("file").agg(F.max(~F.is_valid_utf8("raw")).alias("bad"), F.max(marks % 2 == 1).alias("broken"))
    # The first lines of each file; a task keeps no more of them.
    top = lines.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).where(F.col("nth") <= HEAD)
    heads = top.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("raw").cast("binary").alias("raw")))).alias("lines"))
    rows = each.join(heads, "file").select("file", "bad", "broken", F.transform("lines", lambda x: x["raw"]).alias("lines"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, bad, broken, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                charset = encoding or ("ISO-8859-1" if bad else "UTF-8")
                text = b"\n".join(first).decode(charset, "replace").lstrip("\ufeff")
                given = sep or sniff(text)
                header = next(csv.reader(io.StringIO(text, newline=""), delimiter=given), [])
                out.append({"file": file, "charset": charset, "sep": given, "broken": broken, "header": header})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("charset", pa.string()), ("sep", pa.string()), ("broken", pa.bool_()), ("header", pa.list_(pa.string()))]))

    return rows.mapInArrow(told, "file string, charset string, sep string, broken boolean, header array<string>").orderBy("file").collect()


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multiline: bool | None = None, placed: bool = False) -> DataFrame:
    """All-string columns of a delivery, stripped, ``""`` for missing; rows of blanks only are dropped.

    Each file is read by its own charset, delimiter and header, unless told: one pass over the lines finds whether they are UTF-8 (else Latin-1) and whether quoted
    cells hold line breaks; the driver gets one row a file. Columns that a file lacks are ``""``. Short rows are padded, extra cells
    ignored. Files with line breaks in cells are split too (``quoted``). Lines end in a line feed, with or without a carriage return before it. ``placed`` adds ``_file``, ``_block`` and ``_at``, for
    ``in_file_order``.
    """
    groups: dict[tuple, list[str]] = {}
    for r in _files(spark, path, sep, encoding):
        if any(c.strip() for c in r.header):
            groups.setdefault((tuple(clean_header(r.header)), r.charset, r.sep, r.broken if multiline is None else multiline), []).append(r.file)
    out, place = None, ["_file", "_block", "_at"] if placed else []
    for (names, charset, given, broken), some in groups.items():
        if broken:
            lines = _lines(spark, some).select("file", "block", "at", F.lit(given).alias("sep"), _decoded(charset).alias("value"))
            found = quoted.records(lines)
            # A header is a file's first record.
            first = Window.partitionBy("file").orderBy("block", "at")
            heads = found.where("block = 0").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("file", "block", "at")
            body = found.join(heads, ["file", "block", "at"], "left_anti")
            raw = body.select(quoted.cells(F.col("value"), given).alias("cells"), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("at").alias("_at"))
            raw = raw.select(*[F.try_element_at("cells", F.lit(i)).alias(n) for i, n in enumerate(names, 1)], *place)
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            raw = spark.read.csv(some, schema=schema, sep=given, header=True, encoding=charset, enforceSchema=True, quote='"', escape='"', mode="PERMISSIVE")
            if placed:
                raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.lit(None).cast("long").alias("_at"))
        part = raw.select(*[F.coalesce(trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names], *place)
        part = part.where(" or ".join(f"`{n}` <> ''" for n in names))
        if placed:
            # Places without a gap within a block, whatever was dropped.
            part = part.withColumn("_at", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")).cast("long") if broken else F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("column_1", T.StringType())]))
    return out.fillna("") if len(groups) > 1 else out


def cell_verdicts(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """``(rule_id, file, cells, expected, n_rows, action)``: B-10 blocks a file that has no header or whose rows differ from it in their number of cells, delimiters in quotes aside.

    One row for each other number of cells. Blank lines do not count.
    """
    out = spark.createDataFrame([], "file string, cells int, expected int, n_rows long")
    groups: dict[tuple, list[str]] = {}
    for r in _files(spark, path, sep, encoding):
        named = len(r.header) if any(c.strip() for c in r.header) else 0
        groups.setdefault((r.charset, r.sep, r.broken, named), []).append(r.file)
    for (charset, given, broken, expected), some in groups.items():
        lines = _lines(spark, some).select("file", "block", "at", F.lit(given).alias("sep"), _decoded(charset).alias("value"))
        rows = quoted.records(lines) if broken else lines
        bare = F.regexp_replace("value", '"[^"]*"', "")
        cells = (F.length(bare) - F.length(F.replace(bare, F.lit(given), F.lit(""))) + 1).alias("cells")
        found = rows.where(F.trim("value") != "").groupBy("file", cells).agg(F.count("*").alias("n_rows")).where(F.col("cells") != expected)
        out = out.unionByName(found.select("file", "cells", F.lit(expected).alias("expected"), "n_rows"))
    return out.select(F.lit("B-10").alias("rule_id"), "file", "cells", "expected", "n_rows", F.lit("block").alias("action"))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def numbered(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """``row_number`` from 1 without a gap: by ``order``, else in the order in which a scan lists ``rows``.

    Several files come in no promised order: read them with ``in_file_order`` first. Places within partitions need no shuffle, and
    partition totals are few, so no task sees all rows.
    """
    if order is not None:
        rows = rows.orderBy(order)
    marked = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return marked.join(F.broadcast(starts), "_part").withColumn("row_number", (F.col("_start") + low + 1).cast("long")).drop("_part", "_at", "_start")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of a scan numbered by file name and place in the file: blocks are ranked, rows keep their place within their block.

    Only the blocks' counts meet in one place; a block is what one task reads of a file, so its rows come in the file's order.
    """
    marked = rows
    if "_at" not in rows.columns:
        marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    marked = written(marked, "file-order")
    blocks = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = blocks.withColumn("_start", F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).drop("_n")
    joined = marked.join(F.broadcast(starts), ["_file", "_block"])
    return joined.withColumn("row_number", (F.col("_start") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_file", "_block", "_at", "_start", "_first")


def record_hash(columns: list[str]) -> Column:
    """32 hex digits of the columns' names and values, whatever their order; null and ``""`` are one."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in sorted(columns)]
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32))


def bronze(rows: DataFrame, feed_id: str, batch_id: str, source_system: str) -> DataFrame:
    """Bronze rows: surrogate id, number, the raw row as a map, hash and audit columns."""
    names = [c for c in rows.columns if c != "row_number"]
    pairs = [x for c in names for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
    out = rows.select(F.col("row_number"), F.create_map(*pairs).alias("raw_row"), record_hash(names).alias("record_hash"))
    now = F.current_timestamp()
    return out.select(
        F.expr("uuid()").alias("bronze_id"), F.lit(table_name(feed_id)).alias("feed_id"), "row_number", "raw_row", F.lit(source_system).alias("source_system"),
        now.alias("ingestion_ts"), F.lit(batch_id).alias("batch_id"), "record_hash", now.alias("created_ts"), now.alias("updated_ts"),
    )


def append(rows: DataFrame, path: str) -> int:
    """Append a batch; earlier batches are never touched. Returns the rows written, counted by the write itself."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("batch_id").parquet(path)
    return seen.get["n"]


def batch_state(table: DataFrame) -> DataFrame:
    """``(batch_id, n_rows, state)``: a content address of each batch, the same whatever the order of its rows and files."""
    each = F.xxhash64("row_number", "record_hash", "bronze_id").cast("decimal(38,0)")
    return table.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.sum(each).cast("string").alias("state"))


def _listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of every data file below a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, tuple[int, int]] = {}
    if files.exists(where):
        found = files.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString()
            if not f.getPath().getName().startswith(("_", ".")):
                out[name] = f.getLen(), f.getModificationTime()
    return out


def append_checked(rows: DataFrame, path: str) -> int:
    """``append``, then a second look at the files: raises RuntimeError if any that was there before is gone or is another now. No row of an earlier batch is read."""
    spark = rows.sparkSession
    before = _listing(spark, path)
    n = append(rows, path)
    after = _listing(spark, path)
    changed = sorted({m[1] if (m := re.search(r"batch_id=([^/]+)/", f)) else f for f, told in before.items() if after.get(f) != told})
    if changed:
        raise RuntimeError(f"earlier batches changed: {changed[:5]}")
    return n


def replace_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Rewrite one batch's partition alone; an empty rewrite clears it. Bronze is refused."""
    spark = rows.sparkSession
    refuse_bronze(spark, path)
    if rows.limit(1).count():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(rows: DataFrame) -> DataFrame:
    """A scan over as many partitions as there are cores: a small file of one row group would otherwise be one task."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def refuse_bronze(spark: SparkSession, path: str) -> None:
    """Bronze only grows: raises ValueError where ``path`` is a Bronze table or lies in a folder named bronze."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if any(part.lower().startswith("bronze") for part in path.rstrip("/").split("/")):
        raise ValueError(f"{path} is Bronze; its batches are never rewritten")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Folders of promotions have commits, and no table right below.
    if files.exists(where) and not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "commits")):
        try:
            names = spark.read.parquet(path).columns
        except AnalysisException:  # a folder without a table
            return
        if "bronze_id" in names:
            raise ValueError(f"{path} holds Bronze rows; they are never rewritten")


def contract(columns: list[tuple[str, str, bool, str]]) -> T.StructType:
    """The schema of ``(name, type word, nullable, comment)``; unknown types are text. Names must be plain."""
    return T.StructType([T.StructField(table_name(n), TYPES.get(t, T.StringType()), null, {"comment": c}) for n, t, null, c in columns])


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The contract's columns in its order, cast without raising; columns not mapped are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy("row_number").offset(offset).limit(limit)


def sample_stride(limit: int, rows: int, strategy: str = "spread") -> int:
    if strategy not in ("first", "spread"):
        raise ValueError(f"unknown sample strategy: {strategy}")
    return rows // limit if strategy == "spread" and 0 < limit < rows else 1


def strided(rows: DataFrame, limit: int, total: int, strategy: str = "spread") -> DataFrame:
    """Every k-th row by number, the first ``limit`` of them: the same rows each time."""
    k = sample_stride(limit, total, strategy)
    return rows.where(F.pmod(F.col("row_number") - 1, F.lit(k)) == 0).orderBy("row_number").limit(limit)


def new_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(path, fingerprint, length)`` of files whose content is not yet in the manifest."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", F.concat(F.lit("sha256-"), F.left(F.sha2("content", 256), F.lit(32))).alias("fingerprint"), "length")
    return found.join(manifest.select("fingerprint"), "fingerprint", "left_anti")


def landing_parts(path: Column) -> Column:
    """Domain, source system, feed, folder, business date and file of a landing path."""
    names = ("domain", "source_system", "feed", "folder", "business_date", "file")
    pattern = "/".join(["([^/]+)"] * len(names)) + "$"
    return F.struct(*[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def file_tokens(name: Column, pattern: str, fmt: str) -> Column:
    """The business date that a registered file-name pattern captures."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(fmt)))
