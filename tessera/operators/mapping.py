"""Mapping specs: validation, difference, and compilation to one struct Column a field; promotion of whole batches."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import CASTS, FALSE_WORDS, TRANSFORMS, TRUE_WORDS, blank
from tessera.plans.scratch import dropped, written
from tessera.sources.landing import AUDIT, TYPES, contract, record_hash, refuse_bronze, typed

ON_NULL, ON_UNMAPPED = ("pass", "reject", "default"), ("pass", "quarantine", "null")
#: Field outcomes that stop a row.
BLOCKING = ("failure", "quarantined", "rejected")
MEMBER_KEY = "source_system_id"


#: Which casts give a canonical type, the usual one first. Other types (uuid, json) take any.
CASTS_FOR = {
    "string": ("string",),
    "int64": ("int",),
    "int": ("int",),
    "decimal": ("decimal", "int"),
    "date": ("date",),
    "timestamp": ("timestamp", "date"),
    "timestamp_utc": ("timestamp", "date"),
    "bool": ("bool",),
}


@dataclass(frozen=True)
class Field:
    source: str
    target: str
    cast: str = "string"
    op: str | None = None
    args: dict = field(default_factory=dict)
    value_map: dict = field(default_factory=dict)
    on_null: str = "pass"
    default: str | None = None
    on_unmapped: str = "pass"
    note: str = ""


@dataclass(frozen=True)
class Spec:
    target_table: str
    fields: tuple[Field, ...]


def errors(spec: Spec, canonical: dict[str, str]) -> list[tuple[int, str, str]]:
    """Everything wrong with a spec at once, as (field, attribute, why). ``canonical``: type by ``table.field``."""
    out = [] if spec.fields else [(-1, "fields", "a mapping needs a field")]
    for attribute in ("source", "target"):
        seen: dict[str, int] = {}
        for i, f in enumerate(spec.fields):
            name = getattr(f, attribute)
            if not name.strip():
                out.append((i, attribute, "is required"))
            elif seen.setdefault(name, i) != i:
                out.append((i, attribute, f"{name} is claimed already"))
    for i, f in enumerate(spec.fields):
        kind = canonical.get(f.target)
        if f.target and kind is None:
            out.append((i, "target", f"{f.target} is no canonical field"))
        if f.cast not in CASTS:
            out.append((i, "cast", f"{f.cast} is no cast"))
        elif kind in CASTS_FOR and f.cast not in CASTS_FOR[kind]:
            out.append((i, "cast", f"{f.cast} does not give {kind}; use {' or '.join(CASTS_FOR[kind])}"))
        if f.op is not None:
            if f.op not in TRANSFORMS:
                out.append((i, "transform", f"{f.op} is no transform"))
            else:
                _, must, may = TRANSFORMS[f.op]
                out += [(i, "transform", f"{f.op} needs {a}") for a in must if a not in f.args]
                out += [(i, "transform", f"{f.op} knows no {a}") for a in f.args if a not in (*must, *may)]
        if f.on_null not in ON_NULL:
            out.append((i, "on_null", f"{f.on_null} is no policy"))
        if (f.on_null == "default") != (f.default is not None):
            out.append((i, "default", "a default and on_null 'default' come together"))
        elif f.default is not None and not _castable(f.default, f.cast):
            out.append((i, "default", f"'{f.default}' is no {f.cast}"))
        if f.on_unmapped not in ON_UNMAPPED or (f.on_unmapped != "pass" and not f.value_map):
            out.append((i, "on_unmapped", "needs a value map and a known policy"))
    return out


def _castable(text: str, cast: str) -> bool:
    """Whether a spec's constant is what its cast accepts. Dates are ISO ones."""
    word = text.strip()
    if cast in ("int", "int64"):
        return bool(re.fullmatch(r"[+-]?\d+", word)) and -(1 << 63) <= int(word) < 1 << 63
    if cast == "decimal":
        return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", word))
    if cast == "bool":
        return word.lower() in (*TRUE_WORDS, *FALSE_WORDS)
    if cast in ("date", "timestamp"):
        try:
            datetime.fromisoformat(word)
        except ValueError:
            return False
    return True


def kinds(spec: Spec, canonical: dict[str, str] | None = None) -> dict[str, str]:
    """The type word of each target: the canonical one, else what its cast gives."""
    words = {"int": "int64", "timestamp": "timestamp_utc"}
    return {f.target: words.get(k, k) for f in spec.fields for k in [(canonical or {}).get(f.target, f.cast)]}


def _fits(value: Column, kind: str) -> Column:
    """Whether a mapped value survives the contract's type as it is: not null, not cut, not rounded."""
    held = TYPES.get(kind, T.StringType())
    if isinstance(held, T.StringType):
        return F.lit(True)
    if isinstance(held, T.DecimalType):
        return F.coalesce(value.try_cast(held) == value.try_cast(T.DecimalType(38, 14)), F.lit(False))
    return value.try_cast(held).isNotNull()


def fingerprint(spec: Spec) -> str:
    """32 hex digits over what executes; notes do not."""
    told = [{k: v for k, v in asdict(f).items() if k != "note"} for f in spec.fields]
    return hashlib.sha256(json.dumps([spec.target_table, told], sort_keys=True).encode()).hexdigest()[:32]


def catalog(spark, specs: dict[str, Spec]) -> DataFrame:
    """Specs as rows ``(spec, position, source, target, cast, op, args, value_map, on_null, default_value, on_unmapped)``."""
    rows = [(n, i, f.source, f.target, f.cast, f.op, json.dumps(f.args, sort_keys=True), json.dumps(f.value_map, sort_keys=True), f.on_null, f.default, f.on_unmapped) for n, s in specs.items() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "spec string, position int, source string, target string, cast string, op string, args string, value_map string, on_null string, default_value string, on_unmapped string")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(source, change, attributes)`` of two specs' catalog rows: added, removed, or the attributes that changed."""
    names = ["target", "cast", "op", "args", "value_map", "on_null", "default_value", "on_unmapped"]
    joined = before.alias("b").join(after.alias("a"), F.col("b.source") == F.col("a.source"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{n}").eqNullSafe(F.col(f"a.{n}")), F.lit(n)) for n in names]))
    change = F.when(F.col("b.source").isNull(), "added").when(F.col("a.source").isNull(), "removed").when(F.size(changed) > 0, "changed")
    attributes = F.when(change == "changed", F.concat_ws(",", changed)).otherwise("")
    return joined.select(F.coalesce("a.source", "b.source").alias("source"), change.alias("change"), attributes.alias("attributes")).where("change is not null")


def _staged(i: int, f: Field, kind: str) -> list[dict[str, Column]]:
    """One field's columns, stage by stage: raw value (given), mapped value, moved and cast values, what the contract's type makes of it, then outcome and what it carries.

    Each stage reads the columns of the one before, so nothing is computed twice and every stage stays generated code. What a field does not ask for has no column.
    """
    raw, no = F.get("_raw", F.lit(i)), F.lit(False)
    col = lambda n: F.col(f"_{n}{i}")
    value = col("val") if f.value_map else raw
    moved = col("mov") if f.op else value
    cast = col("cast") if f.cast != "string" else moved
    first = {f"_non{i}": blank(raw)}
    if f.value_map:
        pairs = F.create_map(*[F.lit(x) for kv in f.value_map.items() for x in kv])
        known = F.try_element_at(pairs, raw)
        first[f"_val{i}"] = F.coalesce(known, raw)
        if f.on_unmapped in ("quarantine", "null"):
            first[f"_odd{i}"] = known.isNull()
    second = {f"_mov{i}": TRANSFORMS[f.op][0](value, **f.args)} if f.op else {}
    third = {f"_cast{i}": CASTS[f.cast](moved)} if f.cast != "string" else {}
    missing, odd = col("non"), col("odd") if f"_odd{i}" in first else no
    when_missing = {"reject": ("rejected", "on_null", "source is empty and the field rejects the row"), "default": ("defaulted", None, f"source is empty; default '{f.default}' applied")}.get(f.on_null, ("null", None, "source is empty; null allowed through"))
    loose = isinstance(TYPES.get(kind, T.StringType()), T.StringType)
    none, final, strict = F.lit(None).cast("string"), col("fin"), no if loose else col("bad")
    chain = lambda a, b, c, d, e, unfit: F.when(strict, unfit).when(missing, a).when(odd, b).when(moved.isNull(), c).when(cast.isNull(), d).otherwise(e)
    given = F.when(missing, F.lit(f.default).cast("string")).when(odd, none).otherwise(cast)
    between = {f"_fin{i}": given} | ({} if loose else {f"_bad{i}": given.isNotNull() & ~_fits(given, kind)})
    strange = F.concat(F.lit("'"), raw, F.lit("' is not in the value map"))
    fourth = {
        f"_out{i}": chain(F.lit(when_missing[0]), F.lit("null" if f.on_unmapped == "null" else "quarantined"), F.lit("failure"), F.lit("failure"), F.lit("ok"), F.lit("failure")),
        f"_to{i}": F.when(~strict, final),
        f"_why{i}": chain(F.lit(when_missing[2]), strange, F.concat(F.lit(f"{f.op} cannot read '"), value, F.lit("'")), F.concat(F.lit(f"not a {f.cast}: '"), moved, F.lit("'")), none, F.concat(F.lit("'"), final, F.lit(f"' does not fit {kind}"))),
        f"_rule{i}": chain(F.lit(when_missing[1]).cast("string"), F.lit("on_unmapped_value"), F.lit(f.op).cast("string"), F.lit("cast"), none, F.lit("type")),
    }
    return [first, second, third, between, fourth]


def evaluate(rows: DataFrame, spec: Spec, raw: str = "raw_row", types: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``fields`` (an outcome for each), ``outcome`` (the worst of them) and ``reasons`` (those that block).

    In order: null policy, value map, transform, cast, and, with ``types`` (word by target), whether the value or default fits its type unchanged. Nothing raises. Narrow projections alone; the spec's constants fold into them.
    Defaults and permitted nulls leave a row ok. Write the result once where several consumers follow.

    Every stage hands the raw values on through a lambda, which keeps its projection out of whole-stage code: fused, all
    fields of a spec are one method too large for the JVM to compile, while a projection's own code is split into small ones.

    The rows are counted behind the stages (``evaluated-...``, for a listener), as no filter may pass a count: a reader's filter
    on ``outcome`` or ``fields`` would otherwise be put below all stages, each column of theirs written out wherever it is read.
    """
    out = _judged(rows, spec, raw, types).observe(f"evaluated-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n_rows"))
    out = out.select(*rows.columns, F.array(*_told(spec)).alias("fields"), "outcome")
    stops = F.filter("fields", lambda x: x["outcome"].isin(*BLOCKING))
    return out.withColumn("reasons", F.when(F.col("outcome") == "ok", F.slice("fields", 1, 0)).otherwise(stops))


def _told(spec: Spec) -> list[Column]:
    """Each field of ``_judged`` rows as a struct."""
    told = []
    for i, f in enumerate(spec.fields):
        parts = {"source": F.lit(f.source), "target": F.lit(f.target), "source_value": F.get("_raw", F.lit(i)), "mapped_value": F.col(f"_to{i}"), "outcome": F.col(f"_out{i}"), "reason": F.col(f"_why{i}"), "rule": F.col(f"_rule{i}")}
        told.append(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return told


def _judged(rows: DataFrame, spec: Spec, raw: str, types: dict[str, str] | None) -> DataFrame:
    """``rows`` with the columns of ``_staged`` and the row's ``outcome``."""
    kind = dict(rows.dtypes)[raw]
    get = lambda s: F.try_element_at(F.col(raw), F.lit(s)) if kind.startswith("map") else F.col(f"{raw}.{s}")
    apart = F.transform("_raw", lambda x: x).alias("_raw")
    out = rows.select(*rows.columns, F.array(*[get(f.source) for f in spec.fields]).cast("array<string>").alias("_raw"))
    held = list(rows.columns)
    for stage in zip(*[_staged(i, f, (types or {}).get(f.target, "string")) for i, f in enumerate(spec.fields)], strict=True):
        fresh = {n: c for columns in stage for n, c in columns.items()}
        if fresh:
            out = out.select(*held, apart, *[c.alias(n) for n, c in fresh.items()])
            held += fresh
    any_ = lambda o: reduce(lambda a, b: a | b, [F.col(f"_out{i}") == o for i in range(len(spec.fields))], F.lit(False))
    outcome = F.when(any_("rejected"), "rejected").when(any_("failure"), "failure").when(any_("quarantined"), "quarantined").otherwise("ok")
    return out.withColumn("outcome", outcome)


def _compact(rows: DataFrame, spec: Spec, types: dict[str, str], seen: Observation, raw: str = "raw_row") -> DataFrame:
    """What a promotion's sinks read of evaluated rows: a column ``_to0``, ``_to1`` ... a field, so that each entity reads its own alone; what came in, and why, of rows that are stopped only. Balanced into ``seen`` on the way."""
    ok, primary = F.col("outcome") == "ok", primary_entity(spec)
    out = _judged(rows, spec, raw, types)
    counted = list(entities(spec))
    full = lambda t: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_to{i}"), F.lit("")) != "" for i, f in enumerate(spec.fields) if f.target.startswith(f"{t}.") and (t == primary or f.target != f"{t}.{MEMBER_KEY}")], F.lit(False))
    stopped = [F.when(~ok, F.col(c)).alias(c) for c in rows.columns if c != "row_number"]
    reasons = F.when(~ok, F.filter(F.array(*_told(spec)), lambda x: x["outcome"].isin(*BLOCKING))).alias("reasons")
    out = out.select("row_number", *stopped, *[f"_to{i}" for i in range(len(spec.fields))], "outcome", reasons, *[(ok & full(t)).alias(f"_has{j}") for j, t in enumerate(counted)])
    holds = reduce(lambda a, b: a | b, [F.col(f"_has{j}") for j in range(len(counted))])
    told = {"records_in": F.count(F.lit(1)), "records_out": F.count_if(holds), "quarantined": F.count_if(~ok), "drops": F.count_if(ok & ~holds)}
    told |= {f"to_{t}": F.count_if(F.col(f"_has{j}")) for j, t in enumerate(counted)}
    return out.observe(seen, *[c.alias(n) for n, c in told.items()]).drop(*[f"_has{j}" for j in range(len(counted))])


def outcome_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("outcome").agg(F.count("*").alias("n_rows"))


def tallies(evaluated: DataFrame) -> DataFrame:
    """``(tally, name, n)``: failures by ``source:rule``, targets without a usable value, sources with trouble; one pass."""
    stops = lambda f: f["outcome"].isin(*BLOCKING)
    kinds = lambda f: F.array(
        F.when(stops(f) & f["rule"].isNotNull(), F.struct(F.lit("failure").alias("tally"), F.concat_ws(":", f["source"], f["rule"]).alias("name"))),
        F.when(f["mapped_value"].isNull(), F.struct(F.lit("null_or_invalid").alias("tally"), f["target"].alias("name"))),
        F.when(stops(f), F.struct(F.lit("affected").alias("tally"), f["source"].alias("name"))),
    )
    each = evaluated.select(F.explode(F.array_compact(F.flatten(F.transform("fields", kinds)))).alias("k"))
    return each.groupBy("k.tally", "k.name").agg(F.count("*").alias("n"))


def entities(spec: Spec) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in spec.fields:
        table, _, name = f.target.partition(".")
        out.setdefault(table, []).append(name)
    return out


def primary_entity(spec: Spec) -> str:
    leaf = spec.target_table.rsplit(".", 1)[-1]
    return leaf if leaf in entities(spec) else min(entities(spec))


def entity_rows(evaluated: DataFrame, spec: Spec, table: str) -> DataFrame:
    """One entity's rows: its fields of every row that may be written, empty records left out, the member key handed down."""
    names, primary = entities(spec)[table], primary_entity(spec)
    at = {f.target: i for i, f in enumerate(spec.fields)}
    mapped = lambda i: F.col(f"_to{i}") if "fields" not in evaluated.columns else F.get("fields", F.lit(i))["mapped_value"]
    value = lambda t: mapped(at[t]) if t in at else F.lit(None).cast("string")
    told = [n for n in names if table == primary or n != MEMBER_KEY]
    some = reduce(lambda a, b: a | b, [F.coalesce(value(f"{table}.{n}"), F.lit("")) != "" for n in told], F.lit(False))
    columns = {n: value(f"{table}.{n}") for n in names}
    if table != primary:
        columns[MEMBER_KEY] = F.coalesce(F.nullif(value(f"{table}.{MEMBER_KEY}"), F.lit("")), value(f"{primary}.{MEMBER_KEY}"))
    rows = evaluated.where("outcome = 'ok'").where(some).select("row_number", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumn("record_hash", record_hash(list(columns)))


def expected_rows(evaluated: DataFrame, spec: Spec) -> DataFrame:
    """``(entity, n)``: how many rows each entity should get, counted from the outcomes alone: a second opinion on the fan-out."""
    primary = primary_entity(spec)
    part = lambda f, i: F.split_part(f["target"], F.lit("."), F.lit(i))
    told = F.filter("fields", lambda f: (F.coalesce(f["mapped_value"], F.lit("")) != "") & ((part(f, 1) == primary) | (part(f, 2) != MEMBER_KEY)))
    each = evaluated.where("outcome = 'ok'").select(F.explode(F.array_distinct(F.transform(told, lambda f: part(f, 1)))).alias("entity"))
    return each.groupBy("entity").agg(F.count("*").alias("n"))


def quarantine(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("outcome <> 'ok'")


def balance(evaluated: DataFrame, spec: Spec) -> DataFrame:
    """One row ``(records_in, records_out, quarantined, drops, balanced)`` at the grain of source rows. Rows without any entity are drops."""
    primary = primary_entity(spec)
    holds = F.exists("fields", lambda f: (F.coalesce(f["mapped_value"], F.lit("")) != "") & (f["target"].startswith(f"{primary}.") | ~f["target"].endswith(f".{MEMBER_KEY}")))
    ok = F.col("outcome") == "ok"
    out = evaluated.agg(F.count("*").alias("records_in"), F.count_if(ok & holds).alias("records_out"), F.count_if(~ok).alias("quarantined"), F.count_if(ok & ~holds).alias("drops"))
    return out.withColumn("balanced", F.expr("records_in = records_out + quarantined + drops"))


def entity_contract(spec: Spec, table: str, canonical: dict[str, str] | None = None) -> T.StructType:
    """An entity's schema: the row's number, its fields by canonical type (else by their cast), the member key, audit columns."""
    told = kinds(spec, canonical)
    names = entities(spec)[table]
    fields = [("row_number", "int64", False, ""), *((n, told[f"{table}.{n}"], True, f"{table}.{n}") for n in names)]
    if MEMBER_KEY not in names:
        fields.append((MEMBER_KEY, "string", True, "handed down"))
    audit = {"ingestion_ts": "timestamp_utc", "created_ts": "timestamp_utc", "updated_ts": "timestamp_utc"}
    return contract([*fields, *((n, audit.get(n, "string"), True, "audit") for n in AUDIT)])


def promote(bronze_rows: DataFrame, spec: Spec, path: str, batch_id: str, canonical: dict[str, str] | None = None, source_system: str = "") -> dict:
    """Write a batch to one typed table an entity and a quarantine, below ``path``; nothing is published unless everything balances.

    The evaluated batch is written once, is balanced while it is written, and feeds every sink. Each sink is written once, to a
    folder of this promotion alone; counts read back must equal the expectation from the outcomes. Then one row in the table
    ``commits`` publishes all of them together: readers (``published``) see the last committed version of a batch, so a
    crash before the commit leaves what was there. A value that its contract's type would make null, cut or round is a failure of its row, so casts at
    the sink lose nothing. Bronze is refused.
    """
    spark, version = bronze_rows.sparkSession, uuid.uuid4().hex
    refuse_bronze(spark, path)
    seen = Observation()
    done = written(_compact(bronze_rows, spec, kinds(spec, canonical), seen), "evaluated")
    total = {k: seen.get[k] for k in ("records_in", "records_out", "quarantined", "drops")}
    total["balanced"] = total["records_in"] == total["records_out"] + total["quarantined"] + total["drops"]
    if not total["balanced"]:
        raise RuntimeError(f"the batch does not balance: {total}; nothing is published")
    counts, now = {}, F.current_timestamp()
    audit = {"source_system": F.lit(source_system), "ingestion_ts": now, "batch_id": F.lit(batch_id), "created_ts": now, "updated_ts": now}
    for table in entities(spec):
        rows = typed(entity_rows(done, spec, table).withColumns(audit), entity_contract(spec, table, canonical))
        rows.write.parquet(f"{path}/{table}/{version}")
        counts[table] = spark.read.parquet(f"{path}/{table}/{version}").count()
        if counts[table] != seen.get[f"to_{table}"]:
            raise RuntimeError(f"{table}: {counts[table]} rows staged, {seen.get[f'to_{table}']} expected; nothing is published")
    held = [c for c in bronze_rows.columns if c != "batch_id"]
    quarantine(done).select(*held, "outcome", "reasons", F.lit(batch_id).alias("batch_id")).write.parquet(f"{path}/quarantine/{version}")
    dropped(done)
    commit = spark.createDataFrame([(batch_id, version, fingerprint(spec), time.time_ns())], _COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return {"balance": total, "entities": counts, "fingerprint": fingerprint(spec)}


_COMMIT = "batch_id string, version string, fingerprint string, at long"


def published(spark, path: str, table: str) -> DataFrame:
    """A promoted table: the last committed version of each batch. Commits are one row a promotion; the driver reads them alone."""
    commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    live = commits.groupBy("batch_id").agg(F.max_by("version", F.struct("at", "version")).alias("version")).collect()
    return spark.read.parquet(*sorted(f"{path}/{table}/{r.version}" for r in live))


def summary(quarantined: DataFrame) -> DataFrame:
    """``(batch_id, outcome, source, rule, n_rows)``: what a quarantine holds, by outcome and by the rules that stopped its rows."""
    each = quarantined.select("batch_id", "outcome", "row_number", F.explode_outer("reasons").alias("r"))
    return each.groupBy("batch_id", "outcome", F.col("r.source").alias("source"), F.col("r.rule").alias("rule")).agg(F.count("*").alias("n_rows"))


def masked(evaluated: DataFrame, sources: set[str], targets: set[str]) -> DataFrame:
    """Outcomes with values, mapped values and reasons of protected sources or targets hidden."""
    hide = lambda f: f["source"].isin(*sources, "") | f["target"].isin(*targets, "")
    dots = F.lit("•••")
    safe = lambda f: F.struct(
        f["source"].alias("source"), f["target"].alias("target"), F.when(hide(f) & f["source_value"].isNotNull(), dots).otherwise(f["source_value"]).alias("source_value"),
        F.when(hide(f) & f["mapped_value"].isNotNull(), dots).otherwise(f["mapped_value"]).alias("mapped_value"), f["outcome"].alias("outcome"),
        F.when(hide(f) & f["reason"].isNotNull(), dots).otherwise(f["reason"]).alias("reason"), f["rule"].alias("rule"),
    )
    return evaluated.withColumn("fields", F.transform("fields", safe)).withColumn("reasons", F.transform("reasons", safe))


def masked_row(raw: str, names: set[str]) -> Column:
    return F.transform_values(F.col(raw), lambda k, v: F.when(k.isin(*names, "") & (v != ""), F.lit("•••")).otherwise(v))


def seeded(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """A spec's first draft from matched columns ``(column, target, status)``: contested and illegal targets dropped, casts by
    canonical type ``(target, type)``, ``primary`` the entity with most fields (ties to the first name)."""
    from pyspark.sql import Window

    one = candidates.where("status = 'candidate'").join(canonical, "target")
    contested = F.count("*").over(Window.partitionBy("target"))
    one = one.withColumn("claims", contested).where("claims = 1")
    usual = F.create_map(*[F.lit(x) for k, v in CASTS_FOR.items() for x in (k, v[0])])
    kind = F.coalesce(F.try_element_at(usual, F.col("type")), F.lit("string"))
    one = one.select("column", "target", kind.alias("cast"), F.split_part("target", F.lit("."), F.lit(1)).alias("entity"))
    best = one.groupBy("entity").agg(F.count("*").alias("n")).agg(F.min_by("entity", F.struct(-F.col("n"), F.col("entity"))).alias("primary"))
    return one.withColumn("all", F.lit(1)).join(F.broadcast(best.withColumn("all", F.lit(1))), "all").select("column", "target", "cast", "primary")


def required_targets(canonical: DataFrame, mapped: DataFrame) -> DataFrame:
    """Keys that a mapping of their entity lacks. ``canonical`` (entity, target, is_key, system); an entity whose key has one mappable column requires it."""
    keys = canonical.where("is_key and not system").groupBy("entity").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    touched = mapped.select(F.split_part("target", F.lit("."), F.lit(1)).alias("entity")).distinct()
    return keys.join(touched, "entity", "left_semi").join(mapped, "target", "left_anti").select("entity", "target")
