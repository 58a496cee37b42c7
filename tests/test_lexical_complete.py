"""Lexical matches against brute force over all pairs."""

import random
import re
from difflib import SequenceMatcher

from tessera.operators import matching


def split(name):
    return list(dict.fromkeys(w for w in re.sub("[^a-z0-9]+", "_", name.strip(" ").lower()).split("_") if w))


def squashed(name):
    return re.sub("[^a-z0-9]", "", name.lower())


def brute(columns, concepts, floor=0.55, k=3):
    out = set()
    for feed, column in set(columns):
        best, a = {}, split(column)
        for concept, target in concepts:
            b = split(concept)
            if a and b:
                score = len(set(a) & set(b)) / len(set(a) | set(b))
                if len(a) == 1:
                    score = max(score, SequenceMatcher(None, squashed(column), squashed(concept)).ratio())
                if round(score, 6) >= floor:
                    best[target] = max(best.get(target, 0), round(score, 6))
        out |= {(feed, column, t, s, r) for r, (t, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


def test_no_pair_of_the_floor_is_lost(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdxe1", k=rng.randint(1, 7)))
    name = lambda: rng.choice("_ -").join(word() for _ in range(rng.choice([1, 1, 1, 2, 2, 3])))
    columns = [("a", "dateofbirth"), ("a", "firstname"), ("a", "ab_ab"), ("a", "abxde"), ("a", "cd_dx"), ("b", "Abxde"), ("b", "ab_cd_ef"), ("b", "__"), ("c", ""), *((rng.choice("abc"), name()) for _ in range(150))]
    concepts = [("date_of_birth", "t.dob"), ("First Name", "t.first"), ("abab", "t.abab"), ("abcde", "t.abcde"), ("dx_cd", "t.dx_cd"), ("ef cd ab", "t.three"), ("", "t.none"), *((name(), f"t.{i % 90}") for i in range(120))]
    want = brute(columns, concepts)
    assert ("a", "dateofbirth", "t.dob", 1.0, 1) in want and ("a", "firstname", "t.first", 1.0, 1) in want and ("a", "abxde", "t.abcde", 0.8, 1) in want and any(r[1:3] == ("cd_dx", "t.dx_cd") for r in want)
    got = matching.lexical_matches(spark.createDataFrame(columns, "feed string, column string"), spark.createDataFrame(concepts, "concept string, target string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
