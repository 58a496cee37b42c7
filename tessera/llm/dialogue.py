"""Conversation structure repair: the cheapest edits that make roles alternate, and of these the first in order.

Costs are a shortest path over nodes (turn, what the output ends with), from the end. On the arcs of cheapest paths every node has at most one arc a
letter, so the least audit string is found by prefix doubling: nodes are ranked by their next 1, 2, 4, ... letters with pointers that
double along, ranks choose each node's arc, and the chosen arcs' doubled pointers lay out the whole path at once. Many conversations
are solved together.

A conversation of more than BLOCK turns is cut into blocks. Each block is a matrix of costs between what the output ends with before and
after it; suffix products of these, by doubling over Spark tables, give every block its costs to the end, and pointers doubled the same
way give the state in which the least path enters it. Blocks are then solved apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import written

#: Turns, and bytes of text, of a conversation that is solved in one piece, and turns of a block of a longer one.
BLOCK, BYTES = 512, 8_000_000
#: Turns of pieces that are solved together, and bytes.
TOGETHER, TOGETHER_BYTES = 8192, 16_000_000

#: States: nothing yet, ends with system, with user, with assistant. Where an inserted or re-roled turn leads, and where a turn with initial s, u, a or another does.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Letters in the order of their codes; costs of edits and of a truncated turn that stays.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COST, TRUNCATED_COST, NONE = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}, 5, 1 << 40
#: Costs from each state behind the last turn: insertions that close a pair.
END = np.array([0, 2 * COST[INSERT], COST[INSERT], 0], np.int64)
FAULTS = ["", "blank", "duplicate", "truncated"]
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Solved:
    """Cheapest edits of pieces in a row: ``initial`` and ``fault`` by turn, ``ends`` of the pieces, ``exits`` the costs from each state behind them."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, ends: np.ndarray, exits: np.ndarray):
        self.initial, self.fault = initial, fault
        self.sizes = np.diff(ends, prepend=0)
        # A piece of n turns has columns 0 to n of four nodes each; the last column is where it is left.
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        self.last = self.first + self.sizes
        self.columns = int(self.last[-1]) + 1 if len(self.last) else 0
        self.column_of = np.arange(len(initial)) + np.repeat(np.arange(len(ends)), self.sizes)
        self.cost = np.full((self.columns, 4), NONE, np.int64)
        self.cost[self.last] = exits
        self.stay = fault < BLANK
        self._costs()

    def _arcs(self, turn: np.ndarray, column: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each letter, costs to the end over it and nodes where it leads, by (turn, state)."""
        there = 4 * (column + 1)[:, None]
        truncated = np.where(self.fault[turn] == TRUNCATED, TRUNCATED_COST, 0)[:, None]
        gone = np.isin(self.fault[turn], (BLANK, DUPLICATE))[:, None]
        below = self.cost[column + 1]
        kept = KEPT.T[self.initial[turn]]
        keep = np.where(gone | (kept < 0), NONE, np.take_along_axis(below, np.maximum(kept, 0), 1) + truncated + COST[KEEP])
        rerole = np.where(gone, NONE, below[:, NEXT] + truncated + COST[REROLE])
        insert = self.cost[column][:, NEXT] + COST[INSERT]
        return [(below + COST[DELETE], there + np.arange(4)), (insert, 4 * column[:, None] + NEXT), (keep, there + np.maximum(kept, 0)), (rerole, there + NEXT)]

    def _costs(self) -> None:
        """From the last turns to the first, one turn of every piece at a time."""
        order = np.argsort(-self.sizes, kind="stable")
        begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        for back in range(1, longest + 1):
            some = order[: np.searchsorted(-self.sizes[order], -back, "right")]
            column = self.last[some] - back
            turn = begins[some] + self.sizes[some] - back
            arcs = self._arcs(turn, column)
            best = np.minimum.reduce([arcs[letter][0] for letter in (DELETE, KEEP, REROLE)])
            for _ in range(3):  # system, then user, then assistant are inserted at most
                best = np.minimum(best, best[:, NEXT] + COST[INSERT])
            self.cost[column] = np.minimum(best, NONE)

    def least(self) -> None:
        """``letter`` and ``leads`` by node: the arc of the least audit that costs least; nodes of last columns stay where they are."""
        n = 4 * self.columns
        self.letter, self.leads = np.full(n, -1, np.int8), np.arange(n)
        if not len(self.initial):
            return
        nodes = (4 * self.column_of[:, None] + np.arange(4)).ravel()
        cost, target = (np.stack([x.ravel() for x in of]) for of in zip(*self._arcs(np.arange(len(self.initial)), self.column_of), strict=True))
        mine = self.cost[self.column_of].ravel()
        optimal = (cost == mine) & (mine < NONE)
        alive = optimal.any(axis=0)
        first = np.argmax(optimal, axis=0)
        letter, leads = self.letter, self.leads
        letter[nodes[alive]] = first[alive]
        leads[nodes[alive]] = target[first[alive], np.flatnonzero(alive)]
        # Ranks of the next 1, 2, 4, ... letters; what ends is less than what goes on.
        rank, at = letter.astype(np.int64), leads.copy()
        while (at != at[at]).any():
            wide = rank.max() + 2
            rank = np.unique((rank + 1) * wide + rank[at] + 1, return_inverse=True)[1]
            at = at[at]
        # The arc of the least letter, then of the least rank behind it.
        order = np.where(optimal, np.arange(4)[:, None] * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
        chosen = np.argmin(order, axis=0)
        letter[nodes[alive]] = chosen[alive]
        leads[nodes[alive]] = target[chosen[alive], np.flatnonzero(alive)]

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of each piece's path from state ``entry``, its last column apart, in a row, and their ends by piece, and the states in which pieces are left."""
        powers, steps = [self.leads], (self.letter >= 0).astype(np.int64)
        while (powers[-1] != powers[-1][powers[-1]]).any():
            steps = steps + steps[powers[-1]]
            powers.append(powers[-1][powers[-1]])
        start = 4 * self.first + entry
        length = steps[start]
        ends = np.cumsum(length)
        node = np.repeat(start, length)
        place = np.arange(len(node)) - np.repeat(ends - length, length)
        for k, to in enumerate(powers):
            on = (place >> k & 1).astype(bool)
            node[on] = to[node[on]]
        return node, ends, powers[-1][powers[-1][start]] % 4


def matrices(initial: np.ndarray, fault: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each piece's costs (from, to): from a state before it to a state behind it."""
    out = np.empty((len(ends), 4, 4), np.int64)
    for to in range(4):
        exits = np.full((len(ends), 4), NONE, np.int64)
        exits[:, to] = 0
        found = Solved(initial, fault, ends, exits)
        out[:, :, to] = found.cost[found.first]
    return out


def coded(role: Column) -> Column:
    """A role's initial: 0 system, 1 user, 2 assistant, 3 any other."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def of_text(text: Column) -> Column:
    """The fault that a text has by itself."""
    truncated = ~F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(truncated, TRUNCATED).otherwise(0)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by the CRC of ``conv_id:turn``: turns dropped, emptied, robbed of their stops, repeated, or made the user's.

    Null roles, texts and parts of what is hashed are one space. Ids and turns stay null where they are.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _key(rows: DataFrame) -> Column:
    return F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast(dict(rows.dtypes)["conv_id"])).alias("id"))


def _turns(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key, what repair asks of role and text, and a digest that stands for the text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(_key(rows).alias("key"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    return out.select("*", coded(F.col("role")).alias("initial"), of_text(F.col("text")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))


#: The order of turns: nulls first; ties go by role and the text's digest.
ORDER = ["turn", "role", "digest"]


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """Where a piece begins: rows whose conversation or block is not that of the row before."""
    out = np.zeros(b.num_rows, bool)
    for column in (pc.struct_field(b.column("key"), "id"), pc.struct_field(b.column("key"), "none"), b.column("block")):
        code = column.dictionary_encode().indices.to_numpy()
        out |= np.diff(code, prepend=-1) != 0
    return out


def _by_pieces(work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    """Rows in the order of their pieces to ``work`` on whole pieces, some at a time: (rows, where pieces begin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            # Slices bound what is solved together where texts are long.
            rows = max(1, min(batch.num_rows, TOGETHER, TOGETHER_BYTES * max(batch.num_rows, 1) // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(x.num_rows for x in held) < TOGETHER and sum(x.nbytes for x in held) < TOGETHER_BYTES:
                    continue
                now = joined()
                whole = int(np.flatnonzero(_starts(now))[-1])
                if whole:
                    some = now.slice(0, whole)
                    yield work(some, np.flatnonzero(_starts(some)))
                held = [now.slice(whole)]
        if held:
            now = joined()
            yield work(now, np.flatnonzero(_starts(now)))

    return run


def _ints(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _faults(b: pa.RecordBatch, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initials, first faults and ends by piece: a row whose role and text stand earlier in its piece repeats them."""
    n = b.num_rows
    ends = np.append(begin[1:], n)
    fault = _ints(b, "own")
    columns = [np.repeat(np.arange(len(begin)), ends - begin), *[b.column(c).dictionary_encode().indices.to_numpy() for c in ("role", "digest")]]
    order = np.lexsort((np.arange(n), *columns))
    same = np.ones(n, bool)
    for c in columns:
        same[1:] &= np.diff(c[order]) == 0
    same[0] = False
    fault[order[same & (fault[order] != BLANK)]] = DUPLICATE
    return _ints(b, "initial"), fault, ends


def illegal_pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether initials may not follow each other: only su, ua and au may."""
    return ~(((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1)))


def _emitted(b: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
    """Turns with their edits: insertions before a turn, then its own letter, then those that close the conversation."""
    n = b.num_rows
    initial, fault, ends = _faults(b, begin)
    at = pa.array(begin)
    exits = np.array(b.column("exits").take(at).to_pylist(), np.int64)
    found = Solved(initial, fault, ends, exits)
    found.least()
    node, _, left = found.paths(_ints(b, "entry")[begin])
    letter, state = found.letter[node], found.leads[node] % 4
    column = node // 4
    turn = column - np.searchsorted(found.last, column, "left")
    # Insertions that close a pair, behind the last turn.
    closes = b.column("last").to_numpy(zero_copy_only=False)[begin].astype(bool)
    tails = np.where(closes, np.array([0, 2, 1, 0])[left], 0)
    piece = np.repeat(np.arange(len(tails)), tails)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(tails) - tails, tails)
    turn = np.concatenate((turn, ends[piece] - 1))
    letter = np.concatenate((letter, np.full(len(piece), INSERT, np.int8)))
    state = np.concatenate((state, np.where((left[piece] == SYSTEM) & (nth == 0), USER, ASSISTANT)))
    order = np.argsort(turn, kind="stable")
    turn, letter, state = turn[order], letter[order], state[order]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(turn, minlength=n)))).astype(np.int32)
    edits = pa.StringArray.from_buffers(n, pa.py_buffer(cuts), pa.py_buffer(np.frombuffer(LETTERS.encode(), np.uint8)[letter]))
    stays = (letter == KEEP) | (letter == REROLE)
    spent = np.array([COST[k] for k in range(4)], np.int64)[letter] + np.where(stays & (fault[turn] == TRUNCATED), TRUNCATED_COST, 0)
    cost = np.bincount(turn, spent, minlength=n).astype(np.int64)
    # What is not deleted comes out: its role and its text, or an empty one.
    out = letter != DELETE
    turn, letter, state = turn[out], letter[out], state[out]
    kept = np.concatenate(([0], np.cumsum(np.bincount(turn, minlength=n)))).astype(np.int32)
    roles = pc.if_else(pa.array(letter == KEEP), b.column("role").take(pa.array(turn)), pc.if_else(pa.array(state == USER), "user", "assistant"))
    texts = pc.if_else(pa.array(letter == INSERT), "", b.column("text").take(pa.array(turn)))
    repaired = pa.ListArray.from_arrays(pa.array(kept), pa.StructArray.from_arrays([roles, texts], names=["role", "text"]))
    # The row before: of a block's first row, the last one of the block before.
    before, said = np.concatenate(([-1], initial[:-1])), b.column("turn")
    value, null = pc.fill_null(said, 0).to_numpy().astype(np.int64), said.is_null().to_numpy(zero_copy_only=False)
    past, unknown = np.concatenate(([0], value[:-1])), np.concatenate(([True], null[:-1]))
    ahead = b.column("before").take(at)
    before[begin] = pc.fill_null(pc.struct_field(ahead, "initial"), -1).to_numpy()
    past[begin], unknown[begin] = pc.fill_null(pc.struct_field(ahead, "turn"), 0).to_numpy(), pc.struct_field(ahead, "turn").is_null().to_numpy(zero_copy_only=False)
    illegal = illegal_pairs(before, initial) & (before >= 0)
    gap = np.where(null | unknown, 0, np.maximum(value - past - 1, 0))
    place = _ints(b, "block") * BLOCK + np.arange(n) - np.repeat(begin, ends - begin)
    names = ["key", "place", "turn", "fault", "illegal", "gap", "cost", "edits", "repaired"]
    faults = pa.array(np.array(FAULTS, object)[fault], pa.string())
    return pa.RecordBatch.from_arrays([b.column("key"), pa.array(place), said, faults, pa.array(illegal), pa.array(gap), pa.array(cost), edits, repaired], names=names)


def _matrix(b: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
    """A row for each block: its costs, and what its neighbour must know of its last turn."""
    initial, fault, ends = _faults(b, begin)
    last = pa.array(ends - 1)
    costs = [x.ravel() for x in matrices(initial, fault, ends)]
    at = pa.array(begin)
    return pa.RecordBatch.from_arrays(
        [b.column("key").take(at), b.column("block").take(at), pa.array(costs, pa.list_(pa.int64())), b.column("initial").take(last), b.column("turn").take(last)],
        names=["key", "block", "costs", "initial", "turn"],
    )


def _leaves(b: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
    """For each block, the state in which the least path leaves it, by the state in which it is entered."""
    initial, fault, ends = _faults(b, begin)
    at = pa.array(begin)
    found = Solved(initial, fault, ends, np.array(b.column("exits").take(at).to_pylist(), np.int64))
    found.least()
    to = np.stack([found.paths(np.full(len(ends), s))[2] for s in range(4)], axis=1)
    return pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("block").take(at), pa.array(list(to), pa.list_(pa.int64()))], names=["key", "block", "to"])


def _doubled(blocks: DataFrame, value: str, combine: Callable[[Column, Column], Column], ahead: bool, most: int) -> DataFrame:
    """``(key, block, value)`` with the values of all blocks from there to the end (``ahead``) or from the first to there combined, in log2 rounds."""
    now, step = blocks.select("key", "block", value), 1
    while step < most:
        other = now.select("key", (F.col("block") + (-step if ahead else step)).alias("block"), F.col(value).alias("_other"))
        both = combine(F.col(value), F.col("_other")) if ahead else combine(F.col("_other"), F.col(value))
        now = written(now.join(other, ["key", "block"], "left").select("key", "block", F.when(F.col("_other").isNull(), F.col(value)).otherwise(both).alias(value)), "blocks")
        step *= 2
    return now


def _product(left: Column, right: Column) -> Column:
    """Of two matrices of costs in rows of four: the cheapest way over both."""
    four = F.array(*map(F.lit, range(4)))
    cell = lambda i: F.array_min(F.transform(four, lambda k: left[(F.floor(i / 4) * 4 + k).cast("int")] + right[(k * 4 + i % 4).cast("int")]))
    return F.transform(F.array(*map(F.lit, range(16))), cell)


def _long(turns: DataFrame) -> DataFrame:
    """Turns of conversations of any size to blocks that ``_emitted`` solves: no task sees more of one than a range of its turns."""
    types = dict(turns.dtypes)
    # Rows that are alike in all are spread by their number.
    given = written(turns, "turns").withColumn("salt", F.monotonically_increasing_id())
    order = ["key", *ORDER, "salt"]
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "turns").withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("key", "part").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    placed = ranged.join(parts, ["key", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    placed = placed.withColumn("block", F.floor(F.col("place") / BLOCK))
    # Role and text that stand in an earlier block: one row a block for each, whatever its copies there.
    placed = written(placed, "turns")
    each = placed.groupBy("key", "block", "role", "digest").agg(F.min("place").alias("place"))
    first = each.groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("blocks")).where("blocks > 1")
    again = each.join(first, ["key", "role", "digest"]).where("place > first").select("key", "place", F.lit(True).alias("again"))
    own = F.when(F.col("again") & (F.col("own") != BLANK), DUPLICATE).otherwise(F.col("own"))
    placed = written(placed.join(again, ["key", "place"], "left").withColumn("own", own).drop("again"), "turns")

    def by_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "block").sortWithinPartitions("key", "block", "place")

    narrow = placed.drop("text")
    where = f"key {types['key']}, block long"
    blocks = written(by_blocks(narrow).mapInArrow(_by_pieces(_matrix), f"{where}, costs array<long>, initial int, turn long"), "blocks")
    most = blocks.agg(F.max("block")).first()[0]
    most = 0 if most is None else most + 1
    rest = _doubled(blocks, "costs", _product, True, most)
    end = F.array(*[F.lit(int(x)) for x in END])
    exits = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("costs")[i * 4 + k] + end[k])))
    behind = rest.select("key", (F.col("block") - 1).alias("block"), exits.alias("exits")).where("block >= 0")
    known = blocks.join(behind, ["key", "block"], "left").select("key", "block", F.col("exits").isNull().alias("last"), F.coalesce("exits", end.cast("array<bigint>")).alias("exits"), "initial", "turn")
    known = written(known, "blocks")
    leaves = by_blocks(narrow.join(known.select("key", "block", "exits"), ["key", "block"])).mapInArrow(_by_pieces(_leaves), f"{where}, to array<long>")
    reached = _doubled(written(leaves, "blocks"), "to", lambda a, b: F.transform(a, lambda x: b[x.cast("int")]), False, most)
    after = reached.select("key", (F.col("block") + 1).alias("block"), F.col("to")[START].alias("entry"))
    said = known.select("key", (F.col("block") + 1).alias("block"), F.struct("initial", "turn").alias("before"))
    known = known.select("key", "block", "last", "exits").join(after, ["key", "block"], "left").join(said, ["key", "block"], "left")
    known = known.withColumn("entry", F.coalesce("entry", F.lit(START).cast("long")))
    return by_blocks(placed.join(written(known, "blocks"), ["key", "block"]))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Repaired turns of conversations that are solved whole, in their order within partitions, and of those that are solved by blocks."""
    turns = _turns(rows)
    given = dict(turns.dtypes)
    schema = f"key {given['key']}, place long, turn long, fault string, illegal boolean, gap long, cost long, edits string, repaired array<struct<role:string,text:string>>"
    sizes = turns.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("rows") > BLOCK) | (F.col("bytes") > BYTES)).select("key"), "long")
    some = bool(long.limit(1).count())
    short = turns.join(long, "key", "left_anti") if some else turns
    whole = {"block": F.lit(0).cast("long"), "entry": F.lit(START).cast("long"), "last": F.lit(True), "exits": F.array(*[F.lit(int(x)).cast("long") for x in END]), "before": F.lit(None).cast("struct<initial:int,turn:long>")}
    short = short.repartition("key").sortWithinPartitions("key", *ORDER).select("*", *[v.alias(k) for k, v in whole.items()]).mapInArrow(_by_pieces(_emitted), schema)
    if not some:
        return short, None
    return short, _long(turns.join(long, "key", "left_semi")).mapInArrow(_by_pieces(_emitted), schema)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, fault, illegal, gap, cost, edits, repaired)``: every turn of ``rows`` (conv_id, turn, role, text) with its cheapest edits.

    ``place`` numbers a conversation's turns from 0, in the order of ``turn`` (nulls first; ties by role, then by the text's SHA-256). ``fault`` is the turn's first:
    ``blank``, ``duplicate`` (role and text stood earlier) or ``truncated`` (does not end in . ! or ?). ``illegal`` says that its role's initial may not
    follow the one before, ``gap`` how many turn numbers are missing before it. ``edits`` are letters: I for each turn inserted before it, then K (keep), R (another role) or D (delete), and,
    at a conversation's last turn, I for each one inserted behind. ``repaired`` lists what comes out there, in order; ``cost`` is what the edits cost.

    Null roles and texts are one space; null ids are one conversation; a role that is empty, or has another initial than s, u, a, cannot be kept. Repeated rows are
    turns of their own, duplicates of the first. An empty table gives no row.
    """
    out = ["key.*", "place", "turn", "fault", "illegal", "gap", "cost", "edits", "repaired"]
    whole, blocks = _parts(rows)
    found = (whole.unionByName(blocks) if blocks is not None else whole).select(*out)
    return found.select(F.when(~F.col("none"), F.col("id")).alias("conv_id"), *out[1:])


AUDIT = {"gaps": "long", **dict.fromkeys(FAULTS[1:], "long"), "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversations and places to one row each: counts, letters in a row, and the hash of what comes out, taken as it passes."""
    now, sums, letters, digest, empty, kind = None, {}, [], hashlib.sha256(), True, None
    out: list[tuple] = []

    def close() -> None:
        if now is not None:
            out.append((dict(zip(("none", "id"), now, strict=True)), sums["gap"], *[sums[f] for f in FAULTS[1:]], sums["illegal"], sums["cost"], "".join(letters), digest.hexdigest()))

    def told() -> pa.RecordBatch:
        types = [kind, *[pa.string() if t == "string" else pa.int64() for t in AUDIT.values()]]
        of = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", *AUDIT])
        out.clear()
        return of

    for b in batches:
        kind = b.schema.field("key").type
        some = [b.column(c).to_pylist() for c in ("fault", "illegal", "gap", "cost", "edits")]
        keys = zip(*[pc.struct_field(b.column("key"), c).to_pylist() for c in ("none", "id")], strict=True)
        texts = b.column("repaired")
        cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False)))).tolist()
        flat = texts.flatten()
        lines = pc.binary_join_element_wise(pc.struct_field(flat, "role"), pc.struct_field(flat, "text"), ":").cast(pa.binary())
        for i, (key, fault, illegal, gap, cost, edits) in enumerate(zip(keys, *some, strict=True)):
            if key != now:
                close()
                now, sums, letters, digest, empty = key, dict.fromkeys(["gap", "illegal", "cost", *FAULTS], 0), [], hashlib.sha256(), True
            sums[fault] += 1
            sums["illegal"] += illegal
            sums["gap"] += gap
            sums["cost"] += cost
            letters.append(edits)
            for k in range(cuts[i], cuts[i + 1]):
                if not empty:
                    digest.update(b"\n")
                digest.update(lines[k].as_buffer())
                empty = False
        if out:
            yield told()
    close()
    if out:
        yield told()


def audits(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of ``repair``, one row a conversation.

    Conversations of ``of`` (conv_id; those of ``rows`` where it is not given) without a turn have zeros, no letters and the hash of nothing. A
    hash is made of a whole conversation in its order, so each passes through one task, turn by turn; nothing of it is held but its letters.
    """
    whole, blocks = _parts(rows)
    schema = f"key {dict(whole.dtypes)['key']}, " + ", ".join(f"{n} {t}" for n, t in AUDIT.items())
    found = whole.mapInArrow(_audit, schema)
    if blocks is not None:
        found = found.unionByName(blocks.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_audit, schema))
    conv_id = F.when(~F.col("key.none"), F.col("key.id")).alias("conv_id")
    if of is None:
        return found.select(conv_id, *AUDIT)
    every = of.select(_key(of).alias("key")).distinct()
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.join(found, "key", "left").select(conv_id, *[F.coalesce(n, nothing.get(n, F.lit(0).cast("long"))).alias(n) for n in AUDIT])
