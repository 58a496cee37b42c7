import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dialogue

COLUMNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra's way over whole audits: the cheapest, of these the least. Exact, and slow."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}

    def of(state, i, budget=3):
        if (state, i) in best and budget == 3:
            return best[state, i]
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            role, text = rows[i]
            found.append(add(2, "D", (), of(state, i + 1)))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in step[state]:
                    found.append(add(more, "K", ((role, text),), of(role[:1], i + 1)))
                to = step[state][-1]
                found.append(add(more + 1, "R", (({"u": "user", "a": "assistant"}[to], text),), of(to, i + 1)))
        if budget:
            to = step[state][-1]
            found.append(add(5, "I", (({"u": "user", "a": "assistant"}[to], ""),), of(to, i, budget - 1)))
        found = [f for f in found if f]
        got = min(found, default=None)
        if got and budget == 3:
            best[state, i] = got
        return got

    def add(cost, letter, out, rest):
        return rest and (cost + rest[0], letter + rest[1], out + rest[2])

    for i in range(len(rows), -1, -1):
        for state in ("a", "u", "s", ""):
            of(state, i)
    cost, audit, out = best["", 0]
    return faults, cost, audit, out


def plainly(rows, ids):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    found = []
    for c in ids:
        of = sorted(convs[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        turns = [r[1] for r in of if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, cost, audit, out = cheapest([r[2:] for r in of])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(of))
        found.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return found


def check(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS)
    got = dialogue.audits(dialogue.damaged(table), table).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plainly(hurt(rows), {r[0] for r in rows})))


def made(rng, conversations, longest):
    out = []
    for c in range(conversations):
        for t in range(rng.choice([0, 1, 2, 5, longest])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unsure"])
            text = rng.choice(["Yes.", "No", "", " \n", "Why? ", "é!\x1c", None, f"word {t}.", f"word {t % 3}"])
            out.append((c, rng.choice([t, t, t, 2 * t, None, 3]), role, text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 150, 30)
    rows += [(None, t, "user", f"{t}.") for t in range(9)] + [(None, None, None, None)] * 3 + [(10**6, 5, "user", "Same.")] * 40
    check(spark, rows)


@pytest.mark.parametrize("block", [1, 4, 33])
def test_by_blocks(spark, block, monkeypatch):
    """Conversations of more than a block, as Spark tables: ``BLOCK`` goes to the workers by the functions' own module, so kernels are run here."""
    rng = random.Random(block)
    rows = made(rng, 12, 150) + [(99, t, rng.choice(["user", "assistant"]), f"{t % 90}.") for t in range(700)] + [(98, 7, "user", "Same.")] * 1300
    check(spark, rows)
    rows = [r[2:] for r in hurt(rows) if r[0] == 99][:300]
    initial = np.array(["sua".find(r[:1]) if r[:1] in "sua" else 3 for r, _ in rows], np.int64)
    fault = np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in rows])
    whole = dialogue.Solved(initial, fault, np.array([len(rows)]), dialogue.END[None])
    ends = np.append(np.arange(block, len(rows), block), len(rows))
    costs = dialogue.matrices(initial, fault, ends)
    exits = [dialogue.END]
    for m in costs[::-1]:
        exits.append((m + exits[-1]).min(axis=1))
    assert exits[-1][0] == whole.cost[0, 0]
    whole.least()
    parts = dialogue.Solved(initial, fault, ends, np.array(exits[-2::-1]))
    parts.least()
    entry, letters = 0, ""
    for i in range(len(ends)):
        states = np.zeros(len(ends), np.int64)
        states[i] = entry
        node, upto, left = parts.paths(states)
        letters += "".join(dialogue.LETTERS[x] for x in parts.letter[node[upto[i - 1] if i else 0 : upto[i]]])
        entry = left[i]
    node, _, left = whole.paths(np.zeros(1, np.int64))
    assert (letters, entry) == ("".join(dialogue.LETTERS[x] for x in whole.letter[node]), left[0])


def test_table_and_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    check(spark, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    extra = table.withColumn("key", F.lit(1)).withColumn("block", F.lit("x")).withColumn("place", F.lit(2.0))
    turns = dialogue.repair(extra).collect()
    assert len(turns) == table.count()
    empty = extra.limit(0)
    assert dialogue.repair(empty).count() == 0 and dialogue.audits(dialogue.damaged(empty), empty).count() == 0
