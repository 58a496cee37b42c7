"""Value-based-care metrics. Reference data (coefficients, value sets, benchmarks) are always inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.change import merged_spans


def member_month_totals(months: DataFrame, by: list[str], rolled: bool = False) -> DataFrame:
    """``(by, members, member_months)``; ``rolled`` adds subtotals (null marks all)."""
    grouped = months.rollup(*by) if rolled else months.groupBy(*by)
    return grouped.agg(F.count_distinct("member").alias("members"), F.round(F.sum("share"), 4).alias("member_months"))


def pmpm(costs: DataFrame, months: DataFrame, by: list[str]) -> DataFrame:
    """Allowed per member month over members that have months: both sides are aggregated before they meet."""
    base = months.groupBy(*by).agg(F.sum("share").alias("member_months"))
    own = costs.join(months.select("member").distinct(), "member", "left_semi").groupBy(*by).agg(F.sum("allowed").alias("allowed"))
    out = base.join(own, by, "left").withColumn("allowed", F.coalesce("allowed", F.lit(0.0)))
    return out.withColumn("pmpm", F.round(F.try_divide("allowed", "member_months"), 4))


def pmpm_parts(periods: DataFrame, key: str) -> DataFrame:
    """``(key, change, by_use, by_price)`` between ``(period 0, period 1)`` rows of ``(units, allowed, member_months)``: use at the old
    price plus price at the new use is the whole change."""
    get = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    w = periods.groupBy(key).agg(*[get(p, c).alias(f"{c[0]}{p}") for p in (0, 1) for c in ("units", "allowed", "member_months")])
    use = lambda p: F.try_divide(F.col(f"u{p}"), F.col(f"m{p}"))
    price = lambda p: F.try_divide(F.col(f"a{p}"), F.col(f"u{p}"))
    r = lambda c: F.round(c, 6)
    return w.select(key, r(use(1) * price(1) - use(0) * price(0)).alias("change"), r((use(1) - use(0)) * price(0)).alias("by_use"), r(use(1) * (price(1) - price(0))).alias("by_price"))


def per_thousand(events: DataFrame, months: DataFrame, by: list[str]) -> DataFrame:
    e, m = events.groupBy(*by).agg(F.count("*").alias("events")), months.groupBy(*by).agg(F.sum("share").alias("member_months"))
    return m.join(e, by, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long"))).withColumn("rate", F.round(F.try_divide(F.col("events") * 12000, F.col("member_months")), 4))


def readmission_rate(flagged: DataFrame, by: list[str], days: int = 30, excluded: Column | None = None) -> DataFrame:
    """``(by, index_stays, readmissions, incomplete, rate)``; stays whose window is still open are counted apart."""
    rows = flagged if excluded is None else flagged.where(~excluded)
    done = F.col("window_complete")
    out = rows.groupBy(*by).agg(F.count_if(done).alias("index_stays"), F.count_if(done & F.col(f"readmit_{days}")).alias("readmissions"), F.count_if(~done).alias("incomplete"))
    return out.withColumn("rate", F.round(F.try_divide("readmissions", "index_stays"), 6))


def length_of_stay(closed: DataFrame, by: list[str]) -> DataFrame:
    nights = F.datediff("discharge_ts", "admit_ts")
    return closed.groupBy(*by).agg(F.count("*").alias("stays"), F.sum(nights).alias("days"), F.round(F.avg(nights), 4).alias("alos"))


def days_at_home(spans: DataFrame, away: DataFrame) -> DataFrame:
    """``(member, days, days_away, days_home)``: covered days less days of any stay, each day once."""
    covered = merged_spans(spans, ["member"]).select("member", "from_date", "to_date")
    gone = merged_spans(away, ["member"]).select("member", F.col("from_date").alias("a"), F.col("to_date").alias("b"))
    total = covered.groupBy("member").agg(F.sum(F.datediff("to_date", "from_date") + 1).alias("days"))
    met = covered.join(gone, "member").where("a <= to_date and b >= from_date")
    lost = met.groupBy("member").agg(F.sum(F.datediff(F.least("to_date", "b"), F.greatest("from_date", "a")) + 1).alias("days_away"))
    return total.join(lost, "member", "left").withColumn("days_away", F.coalesce("days_away", F.lit(0).cast("long"))).withColumn("days_home", F.col("days") - F.col("days_away"))


def total_cost(costs: DataFrame, months: DataFrame, benchmarks: DataFrame, by: str, cap: float, complete_until: Column) -> DataFrame:
    """``(by, pmpm, benchmark, ratio, provisional)``: members' costs above ``cap`` are cut off; benchmarks ``(by, pmpm)`` are given."""
    each = costs.groupBy(by, "member").agg(F.least(F.sum("allowed"), F.lit(cap)).alias("allowed"), F.max("service_date").alias("last"))
    own = each.groupBy(by).agg(F.sum("allowed").alias("allowed"), F.max("last").alias("last"))
    out = own.join(months.groupBy(by).agg(F.sum("share").alias("member_months")), by).join(benchmarks.withColumnRenamed("pmpm", "benchmark"), by, "left")
    rate = F.try_divide("allowed", "member_months")
    return out.select(by, F.round(rate, 4).alias("pmpm"), "benchmark", F.round(F.try_divide(rate, "benchmark"), 6).alias("ratio"), (F.col("last") > complete_until).alias("provisional"))


def lag_triangle(paid: DataFrame, lags: int) -> DataFrame:
    """``(service_month, lag_0 .. lag_n)``: what was paid so many months after service, cumulative; later ones go to the last column."""
    lag = F.least(F.floor(F.months_between("paid_month", "service_month")).cast("int"), F.lit(lags))
    cells = paid.withColumn("lag", lag).groupBy("service_month").pivot("lag", list(range(lags + 1))).agg(F.round(F.sum("amount"), 2))
    total = lambda k: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{i}`"), F.lit(0.0)) for i in range(k + 1)])
    return cells.select("service_month", *[F.round(total(k), 2).alias(f"lag_{k}") for k in range(lags + 1)])


def completion_factors(triangle: DataFrame, lags: int, as_of: Column) -> DataFrame:
    """``(lag, paid, ultimate, factor)`` from months that are old enough for every lag: what share is known after so many months."""
    old = triangle.where(F.months_between(as_of, "service_month") >= lags)
    cells = old.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("paid"), F.col(f"lag_{lags}").alias("ultimate")) for k in range(lags + 1)])))
    return cells.groupBy("lag").agg(F.round(F.sum("paid"), 2).alias("paid"), F.round(F.sum("ultimate"), 2).alias("ultimate")).withColumn("factor", F.round(F.try_divide("paid", "ultimate"), 6))


def chain_ladder(paid: DataFrame, lags: int, as_of: Column) -> DataFrame:
    """``(service_month, age, paid, to_ultimate, ultimate, estimate)``: what months of every age cost in the end, the estimate kept apart from what was paid.

    ``paid`` (service_month, paid_month, amount); nothing paid after ``as_of`` is looked at. From each lag to the next, the link ratio is what the months old enough for
    both had paid at the later one over the earlier; a month's factor is the product of the ratios it has not seen yet. Where no month shows a ratio, or
    nothing was paid, the factor is null, and so is what follows from it.
    """
    months = lambda a, b: F.floor(F.months_between(a, b)).cast("int")
    known = paid.where((F.col("paid_month") <= as_of) & (F.col("service_month") <= as_of))
    cells = known.groupBy("service_month", F.least(months("paid_month", "service_month"), F.lit(lags)).alias("lag")).agg(F.sum("amount").alias("amount"))
    age = F.least(months(as_of, F.col("service_month")), F.lit(lags))
    each = cells.groupBy("service_month").agg(F.map_from_entries(F.collect_list(F.struct("lag", "amount"))).alias("by_lag")).withColumn("age", age)
    upto = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at("by_lag", x), F.lit(0.0)))
    # A month of age a shows the links from 0 to a - 1.
    seen = each.where("age > 0").select(F.explode(F.sequence(F.lit(0), F.col("age") - 1)).alias("lag"), "by_lag")
    links = seen.groupBy("lag").agg(F.try_divide(F.sum(upto(F.col("lag") + 1)), F.sum(upto(F.col("lag")))).alias("link"))
    # One row of as many entries as there are lags.
    table = links.agg(F.map_from_entries(F.collect_list(F.struct("lag", "link"))).alias("links"))
    rest = F.filter(F.sequence(F.lit(0), F.lit(lags)), lambda x: (x >= F.col("age")) & (x < lags))
    factor = F.aggregate(rest, F.lit(1.0), lambda a, x: a * F.try_element_at("links", x))
    out = each.crossJoin(F.broadcast(table)).select("service_month", "age", upto(F.col("age")).alias("paid"), factor.alias("to_ultimate"))
    return out.withColumn("ultimate", F.col("paid") * F.col("to_ultimate")).withColumn("estimate", F.col("ultimate") - F.col("paid"))


def loss_ratio(costs: DataFrame, premiums: DataFrame, by: list[str]) -> DataFrame:
    a, b = costs.groupBy(*by).agg(F.sum("allowed").alias("costs")), premiums.groupBy(*by).agg(F.sum("premium").alias("premium"))
    return a.join(b, by, "full_outer").withColumn("ratio", F.round(F.try_divide("costs", "premium"), 6))


def risk_scores(diagnoses: DataFrame, mapping: DataFrame, hierarchy: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``(member, n_conditions, score)``: conditions by ``mapping`` (code, hcc); a condition goes where its parent in ``hierarchy`` (hcc, parent) is present; the rest sum their
    supplied coefficients (hcc, coefficient)."""
    have = diagnoses.join(mapping, "code").select("member", "hcc").distinct()
    beaten = have.join(hierarchy, "hcc").join(have.select("member", F.col("hcc").alias("parent")), ["member", "parent"], "left_semi")
    kept = have.join(beaten.select("member", "hcc").distinct(), ["member", "hcc"], "left_anti").join(coefficients, "hcc", "left")
    return kept.groupBy("member").agg(F.count("*").alias("n_conditions"), F.round(F.sum(F.coalesce("coefficient", F.lit(0.0))), 6).alias("score"))


def gap_closure(members: DataFrame, events: DataFrame, sets: DataFrame) -> DataFrame:
    """``(measure, eligible, excluded, compliant, rate)`` by value sets ``(measure, role, code)``, roles numerator and exclusion."""
    met = events.join(sets, "code").select("member", "measure", "role").distinct()
    every = members.select("member").join(F.broadcast(sets.select("measure").distinct()))
    flags = every.join(met.groupBy("member", "measure").agg(F.max((F.col("role") == "numerator").cast("int")).alias("hit"), F.max((F.col("role") == "exclusion").cast("int")).alias("out")), ["member", "measure"], "left")
    out_, hit = F.coalesce("out", F.lit(0)) == 1, F.coalesce("hit", F.lit(0)) == 1
    agg = flags.groupBy("measure").agg(F.count("*").alias("eligible"), F.count_if(out_).alias("excluded"), F.count_if(hit & ~out_).alias("compliant"))
    return agg.withColumn("rate", F.round(F.try_divide(F.col("compliant"), F.col("eligible") - F.col("excluded")), 6))


def attributed(visits: DataFrame, chosen: DataFrame, tiers: list[str]) -> DataFrame:
    """``(member, provider, basis)``: a member's own choice; else most allowed among primary visits, else among the next tier. Ties: more visits, latest, smaller provider.

    Programmes are attributed apart: run it for each.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    sums = visits.where(F.col("tier").isin(*tiers)).groupBy("member", "provider", place.alias("place")).agg(F.sum("allowed").alias("allowed"), F.count("*").alias("n"), F.max("service_date").alias("last"))
    order = Window.partitionBy("member").orderBy("place", F.col("allowed").desc(), F.col("n").desc(), F.col("last").desc(), "provider")
    best = sums.withColumn("r", F.row_number().over(order)).where("r = 1").select("member", "provider", F.get(F.array(*[F.lit(t) for t in tiers]), F.col("place").cast("int") - 1).alias("basis"))
    own = chosen.select("member", "provider", F.lit("voluntary").alias("basis"))
    return own.union(best.join(own, "member", "left_anti"))


def attributed_counts(rows: DataFrame) -> DataFrame:
    """Members per programme and version; a member of two programmes counts in both."""
    return rows.groupBy("programme", "version").agg(F.count_distinct("member").alias("members"))


def days_covered(fills: DataFrame, start: Column, end: Column) -> DataFrame:
    """``(member, drug_class, days, pdc)``: share of the period's days with any supply, from islands rather than single days."""
    spans = fills.select("member", "drug_class", F.greatest("filled_date", start).alias("from_date"), F.least(F.date_add("filled_date", F.col("days_supply") - 1), end).alias("to_date")).where("from_date <= to_date")
    one = merged_spans(spans, ["member", "drug_class"])
    period = F.datediff(end, start) + 1
    return one.groupBy("member", "drug_class").agg(F.sum(F.datediff("to_date", "from_date") + 1).alias("days")).withColumn("pdc", F.round(F.col("days") / period, 6))


def cohort(spans: DataFrame, anchors: DataFrame, look_back: int, gap_days: int) -> DataFrame:
    """``(member, anchor)`` covered without a gap of over ``gap_days`` through ``look_back`` days before the anchor."""
    one = merged_spans(spans, ["member"], gap_days + 1).select("member", "from_date", "to_date")
    return anchors.join(one, "member").where((F.col("from_date") <= F.date_sub("anchor", look_back)) & (F.col("anchor") <= F.col("to_date"))).select("member", "anchor").distinct()


def triage(values: DataFrame, dimensions: list[str], width: float = 2.0, back: int = 6) -> tuple[DataFrame, DataFrame]:
    """Moves of a rate, and where they come from. ``values`` (period, dimensions, numerator, denominator).

    First ``(period, rate, change, from_numerator, from_denominator, unusual)``; then, over all groupings of the dimensions, ``share`` of the last period's change of the numerator.
    """
    w = Window.orderBy("period")
    whole = values.groupBy("period").agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"))
    n0, d0, n, d = F.lag("n").over(w), F.lag("d").over(w), F.col("n"), F.col("d")
    moves = whole.withColumn("rate", n / d).withColumn("change", n / d - n0 / d0).withColumn("from_numerator", (n - n0) / d0).withColumn("from_denominator", n / d - n / d0)
    band = F.stddev_samp("change").over(w.rowsBetween(-back, -1))
    moves = moves.withColumn("unusual", F.coalesce(F.abs("change") > width * band, F.lit(False)))
    r = lambda c: F.round(c, 6).alias(c)
    moves = moves.select("period", r("rate"), r("change"), r("from_numerator"), r("from_denominator"), "unusual")
    last = values.join(F.broadcast(values.agg(F.max("period").alias("hi"))))
    two = last.where((F.col("period") == F.col("hi")) | (F.col("period") == F.col("hi") - 1))
    delta = F.sum(F.when(F.col("period") == F.col("hi"), F.col("numerator")).otherwise(-F.col("numerator")))
    cubed = two.cube(*dimensions).agg(delta.alias("delta"), F.grouping_id().alias("level"))
    top = F.max(F.when(F.col("level") == 2 ** len(dimensions) - 1, F.col("delta"))).over(Window.partitionBy())
    return moves, cubed.withColumn("share", F.round(F.try_divide("delta", top), 6)).select(*dimensions, F.col("level").cast("int").alias("level"), F.round("delta", 4).alias("delta"), "share")


def bridge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(category, n, amount)`` that lead from one total to another: rows on one side only, rows that differ, and no residual beyond them."""
    j = left.select(key, F.col("amount").alias("a")).join(right.select(key, F.col("amount").alias("b")), key, "full_outer")
    kind = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").when(F.col("a") != F.col("b"), "differs").otherwise("equal")
    return j.groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))), 2).alias("amount"))


def suppressed(rates: DataFrame, child: str, parent: str, least: int) -> DataFrame:
    """``(parent, child, denominator, rate, basis)``: cells below ``least`` show their parent's rate, or nothing if that is small too."""
    up = Window.partitionBy(parent)
    out = rates.withColumn("pn", F.sum("numerator").over(up)).withColumn("pd", F.sum("denominator").over(up))
    basis = F.when(F.col("denominator") >= least, "own").when(F.col("pd") >= least, "parent").otherwise("suppressed")
    rate = F.when(basis == "own", F.col("numerator") / F.col("denominator")).when(basis == "parent", F.col("pn") / F.col("pd"))
    return out.select(parent, child, F.when(basis == "own", F.col("denominator")).alias("denominator"), F.round(rate, 6).alias("rate"), basis.alias("basis"))


def across_sources(rates: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key, one column a source: the same rate as each source has it, labelled."""
    every = reduce(DataFrame.unionByName, [df.select(key, "rate").withColumn("source", F.lit(s)) for s, df in rates.items()])
    return every.groupBy(key).pivot("source", list(rates)).agg(F.first("rate"))
