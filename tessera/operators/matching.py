"""Matching source columns to canonical fields, over all feeds' columns at once."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Confidence of each rung of the ladder, best first.
LADDER = {"precedent": 0.95, "glossary": 0.92, "history": 0.85, "leaf": 0.70}

#: The characters of normalised words, rare ones first: keys of rare letters make small groups.
RARE_FIRST = "0123456789zqxjkvbwpygfumcdlhrsnioate"


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_")


def glossary_match(columns: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(feed, column, target)`` by term or alias; target null where nothing matches. ``glossary`` (term, aliases, target)."""
    names = glossary.select(F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), "target")
    names = names.select(normalised(F.col("name")).alias("name"), "target").distinct()
    return columns.withColumn("name", normalised(F.col("column"))).join(names, "name", "left").select("feed", "column", "target")


def decision_hints(decisions: DataFrame) -> DataFrame:
    """``(column, target)`` from records ``(record_id, text)`` that say ``column -> table.field``; the first record wins."""
    found = decisions.select("record_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+\s*->\s*\w+\.\w+)"), F.lit(1))).alias("hint"))
    parts = F.split("hint", r"\s*->\s*")
    rows = found.select("record_id", parts[0].alias("column"), parts[1].alias("target"))
    return rows.groupBy("column").agg(F.min_by("target", "record_id").alias("target"))


def approved_history(*decisions: DataFrame) -> DataFrame:
    """Approved ``(column, target)`` of all feeds of a domain, the latest by ``decided_at``."""
    every = decisions[0]
    for d in decisions[1:]:
        every = every.unionByName(d)
    return every.groupBy("column").agg(F.max_by("target", "decided_at").alias("target"))


def match_ladder(columns: DataFrame, rungs: dict[str, DataFrame], canonical: DataFrame) -> DataFrame:
    """``(feed, column, target, basis, confidence, status)``: each column's best rung.

    ``rungs`` holds (column, target) by rung name; the leaf rung compares names with canonical fields and
    is ambiguous where several tables have the leaf. A target that several columns of a feed claim is contested, hence ambiguous.
    Columns without any match stay, as unknown.
    """
    tries = []
    for place, (name, confidence) in enumerate(LADDER.items()):
        if name == "leaf":
            pairs = canonical.select(F.split_part("target", F.lit("."), F.lit(2)).alias("key"), "target")
        elif name in rungs:
            pairs = rungs[name].select(normalised(F.col("column")).alias("key"), "target")
        else:
            continue
        tries.append(pairs.distinct().withColumn("place", F.lit(place)).withColumn("basis", F.lit(name)).withColumn("confidence", F.lit(confidence)))
    every = tries[0]
    for t in tries[1:]:
        every = every.unionByName(t)
    named = columns.select("feed", "column", normalised(F.col("column")).alias("key"))
    found = named.join(every, "key", "left").groupBy("feed", "column", "place", "basis", "confidence").agg(F.min("target").alias("target"), F.count("target").alias("targets"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("feed", "column").orderBy(F.col("place").asc_nulls_last()))).where("r = 1")
    claims = F.count("target").over(Window.partitionBy("feed", "target"))
    status = F.when(F.col("target").isNull(), "unknown").when((F.col("targets") > 1) | (claims > 1), "ambiguous").otherwise("candidate")
    return best.withColumn("status", status).select("feed", "column", "target", "basis", "confidence", "status")


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("feed", "status").agg(F.count("*").alias("n"))


def block_ratio(column: Column, concept: Column) -> Column:
    """Ratcliff and Obershelp's ratio of two names: twice the letters in their longest common block, and in those to its left and right, over all letters."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(column, concept)


def lexical_matches(columns: DataFrame, concepts: DataFrame, floor: float = 0.55, k: int = 3) -> DataFrame:
    """``(feed, column, target, score, rank)``: the k closest concepts by shared words or, for a column of one word, by the blocks of letters that it shares with the
    concept written as one word; ``floor`` is above 0.

    Distinct normalised names are matched once and joined back to their feeds. No pair of the floor is lost. Of n words at least floor * n are shared. A ratio is at
    most that of the letters that two names have in common, each told apart by its occurrence, so of n letters at least floor / (2 - floor) * n are shared. The
    first of a fixed order, as many as must hold one of these, meet the other's; pairs whose letters could reach the floor are then compared.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(normalised(c), "_"), lambda x: x != ""))
    squashed = lambda c: F.replace(normalised(c), F.lit("_"), F.lit(""))
    ordered = lambda c: F.translate(squashed(c), RARE_FIRST, "".join(sorted(RARE_FIRST)))
    seen = lambda t, i: F.length(F.substring(t, F.lit(1), i)) - F.length(F.replace(F.substring(t, F.lit(1), i), F.substring(t, i, F.lit(1)), F.lit("")))
    letters = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, i, F.lit(1)), F.lpad(seen(t, i).cast("string"), 4, "0")))
    needed = lambda n, least: F.greatest(F.ceil(n * (least - 1e-6)), F.lit(1)).cast("int")
    first = lambda x, least: F.slice(F.array_sort(x), F.lit(1), F.size(x) - needed(F.size(x), least) + 1)
    marked = lambda x, mark, least: F.transform(first(x, least), lambda v: F.concat(F.lit(mark), v))
    none = F.array().cast("array<string>")
    words = lambda c: F.when(F.size(split(c)) > 0, marked(split(c), "w|", floor)).otherwise(none)
    by_letter = lambda c: F.when(F.length(squashed(c)) > 0, marked(letters(ordered(c)), "l|", floor / (2 - floor))).otherwise(none)
    names = columns.select("feed", "column", normalised(F.col("column")).alias("name")).distinct()
    one = F.size(split(F.col("column"))) == 1
    left = names.select(F.col("name").alias("column")).distinct().select("column", F.explode(F.concat(words(F.col("column")), F.when(one, by_letter(F.col("column"))).otherwise(none))).alias("key"))
    right = concepts.select("target", "concept", F.explode(F.concat(words(F.col("concept")), by_letter(F.col("concept")))).alias("key"))
    pairs = left.join(right, "key").select("column", "target", "concept").distinct()
    a, b = split(F.col("column")), split(F.col("concept"))
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    x, y = squashed(F.col("column")), squashed(F.col("concept"))
    common = F.size(F.array_intersect(letters(ordered(F.col("column"))), letters(ordered(F.col("concept")))))
    able = one & (2 * common >= (floor - 1e-6) * (F.length(x) + F.length(y)))
    told = pairs.select("column", "target", jaccard.alias("jaccard"), F.when(able, x).alias("x"), F.when(able, y).alias("y"))
    alike = told.where("x is not null").select("x", "y").distinct().withColumn("ratio", block_ratio(F.col("x"), F.col("y")))
    told = told.join(alike, ["x", "y"], "left").withColumn("score", F.round(F.greatest("jaccard", F.coalesce("ratio", F.lit(0.0))), 6))
    scored = told.groupBy("column", "target").agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    order = Window.partitionBy("column").orderBy(F.col("score").desc(), "target")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("column", "name")
    return names.join(best, "name").select("feed", "column", "target", "score", "rank")


def with_policy(matches: DataFrame, canonical: DataFrame, precedents: DataFrame) -> DataFrame:
    """Illegal targets become unknown, precedents overrule, and lexical matches stay ambiguous at most."""
    ruled = matches.join(precedents.select("column", F.col("target").alias("ruled")), "column", "left")
    legal = canonical.select("target", F.lit(True).alias("legal"))
    named = ruled.withColumn("target", F.coalesce("ruled", "target")).join(legal, "target", "left")
    status = F.when(F.col("ruled").isNotNull() & F.col("legal"), "candidate").when(F.col("legal").isNull(), "unknown").when((F.col("basis") == "lexical") & (F.col("status") == "candidate"), "ambiguous").otherwise(F.col("status"))
    return named.select("feed", "column", F.when(F.col("legal"), F.col("target")).alias("target"), status.alias("status"))


def suggested_transform(inferred: Column, canonical_type: Column) -> Column:
    """What a column of an inferred type needs for its target's type, as ``op`` or ``cast`` words."""
    return F.when((canonical_type == "timestamp_utc") & (inferred == "date"), "parse_date").when((canonical_type == "bool") & (inferred != "bool"), "cast bool")


def roster(profile: DataFrame, candidates: DataFrame, spec: DataFrame, issues: DataFrame) -> DataFrame:
    """``(column, inferred_type, candidate, mapped_to, issues, placed)``: every profiled column once, with all that is known of it."""
    out = profile.select("column", "inferred_type").join(candidates.select("column", F.col("target").alias("candidate")), "column", "left")
    out = out.join(spec.select(F.col("source").alias("column"), F.col("target").alias("mapped_to")), "column", "left")
    out = out.join(issues.select("column", "issues"), "column", "left")
    return out.withColumn("issues", F.coalesce("issues", F.lit(0).cast("long"))).withColumn("placed", F.col("mapped_to").isNotNull())
