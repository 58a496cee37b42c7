"""Mixing sources to target weights over a time-varying curriculum. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import written

#: A word is a maximal run of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Times of the schedule's knots, and the multiplier of each weight class at each of them.
KNOTS = (0.0, 0.5, 1.0)
CURVES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: Rows that one step of a running sum should see, and the most steps a source is cut into.
ROWS_A_STEP, MOST_STEPS = 64, 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that no null hides in: joins and windows need no null-safe comparison."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), source))


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Each source's target, from ``(key, source, source_size)``, one row a source.

    Sources in code-point order, null last, take ``weights`` in turn and share all sizes; no target
    passes ``cap`` times its source. Capping by rising ``cap * size / weight`` finds at once what
    resharing the excess again and again converges to: a source is capped if its ratio is at most the
    level that the sources not yet capped would have. The table holds one row a source, so its windows
    are small whatever the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", F.get(every, F.col("place") % len(weights)))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = ranked.withColumn("capped", F.col("ratio") <= level)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    share = F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("weight") * rest / free, F.col("most")))
    return capped.select("key", "source_size", (F.col("place") % len(weights)).cast("int").alias("curve"), share.alias("target"))


def training_time(share: Column, curve: Column, knots: Sequence[float], curves: Sequence[Sequence[float]]) -> Column:
    """The time in [0, 1] by which ``share`` of a source's demand has been met.

    The multiplier is linear between knots, so demand is a quadratic on each span: find the span by its
    cumulative share and solve for the time.
    """
    spans = []
    for c in curves:
        area = [(b - a) * (u + v) / 2 for a, b, u, v in zip(knots, knots[1:], c, c[1:], strict=False)]
        if not sum(area) > 0 or min(c) < 0:
            raise ValueError("a schedule needs non-negative multipliers, not all zero")
        done, of = 0.0, []
        for (a, b), (u, v), s in zip(zip(knots, knots[1:], strict=False), zip(c, c[1:], strict=False), area, strict=False):
            if s > 0:
                rows = (("t", a), ("d", b - a), ("from", done), ("u", u / sum(area)), ("v", v / sum(area)))
                of.append(F.struct(*[F.lit(float(x)).alias(n) for n, x in rows]))
            done += s / sum(area)
        spans.append(F.array(*of))
    span = F.element_at(F.filter(F.get(F.array(*spans), curve), lambda s: s["from"] <= share), -1)
    more = share - span["from"]
    slope = (span["v"] - span["u"]) / span["d"]
    down = span["u"] + F.sqrt(F.greatest(span["u"] * span["u"] + 2 * slope * more, F.lit(0.0)))
    return F.least(F.lit(1.0), span["t"] + F.when(down > 0, 2 * more / down).otherwise(0.0))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    knots: Sequence[float] = KNOTS,
    curves: Sequence[Sequence[float]] = CURVES,
    whole: bool = False,
    seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row a document: its size in words, its source's size and target, what the mix takes of it, and when.

    Documents of a source stand in a seeded order and are taken around and around until the target is
    met, so ``taken`` is ``copies`` whole readings but for the last document, which is cut where the
    target ends; with ``whole`` a reading is taken if its middle lies within the target, and none is
    cut. ``position`` is the training time at which the first reading falls under the source's
    curve, ``positions`` all of them (null, empty: never). ``keep`` names columns to carry along, as ``kept_<name>``.

    The running sum over a source is cut into up to MOST_STEPS hashed steps, so a source with a third
    of all rows is summed by many tasks; only ids and sizes are shuffled unless ``keep`` asks for more.

    Null text and empty text have size 0 and are never taken. Null sources form one source, the last.
    Repeated rows and ids are separate documents; ties of the seeded order are equal rows. Empty tables
    give no row. Other columns of ``docs`` do no harm.
    """
    steps = max(1, min(MOST_STEPS, docs.count() // ROWS_A_STEP))
    size = word_count(F.col("text"))
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = docs.select("doc_id", *[F.col(c).alias(f"kept_{c}") for c in keep], F.col("source").alias("src"), size.alias("size"))
    rows = rows.withColumn("turn", turn).withColumn("key", source_key(F.col("src"))).withColumn("step", F.pmod("turn", F.lit(steps)))
    if not keep:
        rows = written(rows, "sizes")  # words are counted once
        sums = rows.groupBy("key", "step").agg(F.sum("size").alias("sum"), F.first("src").alias("src"))
    else:
        narrow = docs.select("doc_id", F.col("source").alias("src"), size.alias("size")).withColumn("key", source_key(F.col("src")))
        sums = narrow.withColumn("step", F.pmod(turn, F.lit(steps))).groupBy("key", "step").agg(F.sum("size").alias("sum"), F.first("src").alias("src"))
    sums = written(sums, "sums")
    of = sums.groupBy("key").agg(F.sum("sum").alias("source_size"), F.first("src").alias("source"))
    starts = sums.select("key", "step", (F.sum("sum").over(Window.partitionBy("key").orderBy("step")) - F.col("sum")).alias("start"))
    placed = starts.join(F.broadcast(targets(of, weights, cap)) if _few(of) else targets(of, weights, cap), "key")
    inside = Window.partitionBy("key", "step").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["key", "step"])
    rows = rows.withColumn("at", F.col("start") + F.col("ahead"))

    budget = F.floor("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - turns * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("at")))
    if whole:
        # A reading counts if its middle is within the target; "taken" then has whole readings alone.
        extra = F.when((F.col("size") > 0) & (2 * F.col("at") + F.col("size") < 2 * left), 1).otherwise(0)
        rows = rows.withColumn("copies", F.when(F.col("size") > 0, turns + extra).otherwise(0))
        rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    else:
        rows = rows.withColumn("taken", turns * F.col("size") + part)
        rows = rows.withColumn("copies", F.when(F.col("size") > 0, turns + F.when(part > 0, 1).otherwise(0)).otherwise(0))
    share = lambda e: (e * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target")
    time = lambda e: training_time(F.least(F.lit(1.0), share(e)), F.col("curve"), knots, curves)
    several = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), time)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("positions", several).withColumn("position", F.get("positions", F.lit(0)))
    return rows.select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"), "position", "positions", *[F.col(f"kept_{c}") for c in keep],
    )


def _few(of: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast (rows of some 50 bytes)."""
    return of.limit(most + 1).count() <= most


def training_order(docs: DataFrame, columns: Sequence[str], **how) -> DataFrame:
    """The mix itself: ``columns`` of each reading of each document, range-sorted by training time.

    Whole readings only. A document taken three times gives three rows, at its three times. Nulls,
    empty texts and repeats as in ``mix``.
    """
    rows = mix(docs, whole=True, keep=columns, **how)
    out = rows.select(F.explode("positions").alias("position"), *[f"kept_{c}" for c in columns], F.xxhash64("doc_id").alias("tie"))
    out = out.repartitionByRange(out.position, out.tie).sortWithinPartitions("position", "tie")
    return out.select(*[F.col(f"kept_{c}").alias(c) for c in columns])
