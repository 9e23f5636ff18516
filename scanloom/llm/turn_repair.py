"""Repair of conversations at least cost: rows are kept, given another role or deleted and turns inserted until the roles
follow a grammar.

The edits of a conversation are the paths of a layered graph (rows by states of the grammar).  Least costs from its start
and to its end tell which arcs lie on a cheapest path; a walk over these tight arcs, with the set of states that the letters
so far can have reached, takes the least letter at each step.  Conversations are range-partitioned in their order: those
that lie within a part are solved where they have been sorted, those across parts by the parts' cost matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rt import Scratch, shuffle_partitions, text_or_empty

INF = 1 << 40
#: White space of ASCII.
SPACE = " \t\n\x0b\x0c\r"
#: The letters of the edits in the order in which ties are broken.
LETTERS = ("D", "I", "K", "R")


@dataclass(frozen=True)
class TurnGrammar:
    """moves: state -> first letter of a role -> state; roles: what a row's role may be set to, or an inserted turn has, by
    first letter; costs of the edits, and of leaving a truncated row."""

    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}})
    ends: tuple[str, ...] = ("", "a")
    roles: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    def __post_init__(self):
        if self.insert <= 0:
            raise ValueError("insertions must cost something")
        for state, by in self.moves.items():
            if sum(c in by for c in self.roles) > 1:
                raise ValueError(f"after {state!r} a letter could stand for several roles")

    @property
    def states(self) -> list[str]:
        return list(self.moves)

    @property
    def initials(self) -> list[str]:
        return sorted({c for by in self.moves.values() for c in by})

    def pairs(self) -> list[str]:
        """The pairs of initials that may follow each other."""
        return sorted({a + b for by in self.moves.values() for a, state in by.items() for b in self.moves[state]})


class _Graph:
    """The grammar as arrays.  A row's class is 3 times the place of its initial, plus 1 if truncated, 2 if it must go."""

    def __init__(self, g: TurnGrammar):
        states, initials = g.states, g.initials
        at = {s: i for i, s in enumerate(states)}
        n, classes = len(states), 3 * (len(initials) + 1)
        self.n = n
        #: Cost and next state of each letter for a class and a state (-1: none); INSERT for a state alone.
        self.cost = {x: np.full((classes, n), INF, np.int64) for x in "DKR"}
        self.to = {x: np.full((classes, n), -1) for x in "DKR"}
        self.insert_to, self.role_of = np.full(n, -1), np.full(n, None, object)
        for s, i in at.items():
            for c, state in g.moves[s].items():
                if c in g.roles:
                    self.insert_to[i], self.role_of[i] = at[state], g.roles[c]
        for k in range(classes):
            kind = k % 3
            for s, i in at.items():
                self.cost["D"][k, i], self.to["D"][k, i] = g.delete, i
                if kind < 2:
                    initial = initials[k // 3] if k // 3 < len(initials) else None
                    if initial in g.moves[s]:
                        self.cost["K"][k, i], self.to["K"][k, i] = g.keep + kind * g.truncated, at[g.moves[s][initial]]
                    if self.insert_to[i] >= 0:
                        self.cost["R"][k, i], self.to["R"][k, i] = g.rerole + kind * g.truncated, self.insert_to[i]
        self.insert = g.insert
        row = np.full((classes, n, n), INF, np.int64)
        for x in "DKR":
            for k in range(classes):
                for i in range(n):
                    if (j := self.to[x][k, i]) >= 0:
                        row[k, i, j] = min(row[k, i, j], self.cost[x][k, i])
        close = np.where(np.eye(n, dtype=bool), 0, INF)
        for _ in range(n):
            for i in range(n):
                if (j := self.insert_to[i]) >= 0:
                    close[i] = np.minimum(close[i], g.insert + close[j])
        #: Cheapest insertions between states; the same and then a row of each class.
        self.close = close
        self.step = np.stack([_times(close, row[k]) for k in range(classes)])
        self.end = np.array([0 if s in g.ends else INF for s in states], np.int64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of cost matrices: sums, and the least of them."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), INF)


def block_matrix(graph: _Graph, cls: np.ndarray) -> np.ndarray:
    """The cheapest costs from each state before these rows to each state behind them."""
    m = graph.step[cls]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([_times(m[: len(m) - len(odd) : 2], m[1 :: 2][: len(m) // 2]), odd])
    return m[0]


def walk(graph: _Graph, cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray, enter: np.ndarray, last: np.ndarray):
    """The edits of blocks of rows: (block, row or -1, row that it stands before or behind, letter, state) in order, and the
    set of states behind each block.

    before, after: the least costs of each state at the start of a block and behind it; enter: the set of states (bits) in
    which its walk starts; last: behind it the conversation ends, with insertions if need be."""
    g, n, blocks = graph, graph.n, len(starts)
    order = np.argsort(-sizes, kind="stable")
    s, size = starts[order], sizes[order]
    rows = len(cls)
    f, nxt, back = np.empty((rows, n), np.int64), np.empty((rows, n), np.int64), np.empty((rows, n), np.int64)
    most = int(size[0]) if blocks else 0
    here = [int(np.searchsorted(-size, -k, side="left")) for k in range(most)]  # how many blocks have a row k
    cur = before[order].copy()
    for k in range(most):
        m = here[k]
        at = s[:m] + k
        f[at] = cur[:m]
        cur[:m] = np.minimum((cur[:m, :, None] + g.step[cls[at]]).min(1), INF)
    ahead = np.empty_like(cur)
    ahead[order] = cur
    cur = np.where(last[order, None], np.minimum((g.close[None] + g.end[None, None]).min(2), INF), after[order])
    behind = np.empty_like(cur)
    behind[order] = cur
    for k in range(most):
        m = here[k]
        at = s[:m] + size[:m] - 1 - k
        nxt[at] = cur[:m]
        cur[:m] = np.minimum((g.step[cls[at]] + cur[:m, None, :]).min(2), INF)
        back[at] = cur[:m]
    whole = np.empty(blocks, np.int64)
    whole[order] = np.minimum((before[order] + cur).min(1), INF)
    close = lambda x: np.minimum((x[:, :, None] + g.close[None]).min(1), INF)
    f, tail = close(f), close(ahead)
    total = np.repeat(whole, sizes)[:, None] if rows else np.zeros((0, 1), np.int64)
    states = np.arange(n)
    if rows != sizes.sum():
        raise ValueError("blocks must cover the rows")

    def tight(cost, to, ahead_of, f, total):
        """Of each state the bit of the next one, where the arc is on a cheapest path."""
        there = np.where(to >= 0, np.take_along_axis(ahead_of, np.maximum(to, 0), 1), INF)
        return np.where((to >= 0) & (f < INF) & (f + cost + there == total), 1 << np.maximum(to, 0), 0)

    inserts = np.broadcast_to(g.insert_to, (rows, n))
    arcs = {x: tight(g.cost[x][cls], g.to[x][cls], nxt, f, total) for x in "DKR"}
    arcs["I"] = tight(g.insert, inserts, back, f, total)
    tail_arcs = tight(g.insert, np.broadcast_to(g.insert_to, (blocks, n)), behind, tail, whole[:, None])
    done_at = (g.end[None] == 0) & (tail == whole[:, None])

    def follow(masks, held):
        out = np.zeros(len(held), np.int64)
        for i in states:
            out |= np.where(held >> i & 1, masks[:, i], 0)
        return out

    place, held = np.zeros(blocks, np.int64), enter.astype(np.int64).copy()
    active, made = np.arange(blocks), []
    while len(active):
        inner = place[active] < sizes[active]
        b = active[inner]
        if len(b):
            r, q = starts[b] + place[b], held[b]
            letter, to = np.full(len(b), -1), np.zeros(len(b), np.int64)
            for j, x in enumerate(LETTERS):
                open_ = np.flatnonzero(letter < 0)
                if not len(open_):
                    break
                reach = follow(arcs[x][r[open_]], q[open_])
                hit = reach > 0
                letter[open_[hit]], to[open_[hit]] = j, reach[hit]
            if (letter < 0).any():
                raise RuntimeError("a cheapest path breaks off")
            made.append((b, np.where(letter == 1, -1, r), r, letter, to))
            held[b] = to
            place[b] += letter != 1
        b = active[~inner]
        b = b[last[b]]
        b = b[~((held[b, None] >> states & 1).astype(bool) & done_at[b]).any(1)]
        if len(b):
            to = follow(tail_arcs[b], held[b])
            if (to == 0).any():
                raise RuntimeError("a cheapest path breaks off")
            made.append((b, np.full(len(b), -1), starts[b] + sizes[b] - 1, np.full(len(b), 1), to))
            held[b] = to
        active = np.concatenate([active[inner], b]) if len(b) else active[inner]
    if not made:
        return tuple(np.zeros(0, np.int64) for _ in range(5)), held
    b, row, near, letter, to = (np.concatenate(x) for x in zip(*made, strict=True))
    turn = np.argsort(b, kind="stable")
    return (b[turn], row[turn], near[turn], letter[turn], to[turn]), held


def _cuts(column) -> np.ndarray:
    """Where the values of an Arrow column change, nulls being equal."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def _sections(batches):
    """(rows of whole conversations, whether they touch the border of the part) of a part's sorted rows."""
    import pyarrow as pa

    held, border = [], True
    key = lambda batch, i: batch.column("conv_id")[i].as_py()
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _cuts(batch.column("conv_id")).tolist()
        if held and key(batch, 0) != key(held[-1], held[-1].num_rows - 1):
            cuts.insert(0, 0)
        if not cuts:
            held.append(batch)
            continue
        if cuts[0]:
            held.append(batch.slice(0, cuts[0]))
        if held:
            yield pa.concat_batches(held), border
            border = False
        if cuts[-1] > cuts[0]:
            yield batch.slice(cuts[0], cuts[-1] - cuts[0]), False
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.concat_batches(held), True


def _edited(batch, graph: _Graph, before=None, after=None, enter=None, last=None):
    """The edits of a batch of whole blocks as rows of EDITS, and the states behind each block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    starts = np.concatenate(([0], _cuts(batch.column("conv_id"))))
    sizes = np.diff(np.concatenate((starts, [batch.num_rows])))
    n = len(starts)
    if before is None:
        before = np.tile(np.where(np.arange(graph.n) == 0, 0, INF), (n, 1))
        after, enter, last = np.full((n, graph.n), INF), np.ones(n, np.int64), np.ones(n, bool)
    (_, row, near, letter, to), held = walk(graph, batch.column("cls").to_numpy(), starts, sizes, before, after, enter, last)
    own = pa.array(row, mask=row < 0)
    state = np.log2(to & -to).astype(np.int64)  # the least of the set
    # the role that leads to a state, for edits that set one
    lead = np.full(graph.n, None, object)
    lead[graph.insert_to[graph.insert_to >= 0]] = graph.role_of[graph.insert_to >= 0]
    role = batch.column("role").take(own)
    sets = (letter == 1) | (letter == 3)
    role = pc.if_else(pa.array(sets), pa.array(lead[state], pa.string()), role)
    role = pc.if_else(pa.array(letter == 0), pa.scalar(None, pa.string()), role)
    text = pc.if_else(pa.array(letter == 1), pa.scalar("", batch.schema.field("text").type), batch.column("text").take(own))
    near = pa.array(near)
    first = np.concatenate(([True], np.asarray(near)[1:] != np.asarray(near)[:-1])) if len(near) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    step = np.arange(len(first)) - np.repeat(at, np.diff(np.concatenate((at, [len(first)]))))
    copies = pc.fill_null(batch.column("n").take(own), 0)
    columns = [batch.column("conv_id").take(near), batch.column("at").take(near), pa.array(step.astype(np.int32)), pa.array(np.array(LETTERS)[letter]), batch.column("turn").take(own), batch.column("kind").take(own), batch.column("role").take(own), role, text, copies]
    return pa.RecordBatch.from_arrays(columns, names=EDITS), held


#: Columns of the table of edits: rows and insertions in order of (at, step).
EDITS = ["conv_id", "at", "step", "edit", "turn", "kind", "was", "role", "text", "n"]


def faults(rows: DataFrame, grammar: TurnGrammar, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text, n, kind, cls: equal rows as one with their number, and the first fault of each: blank,
    duplicate (role and text stood earlier in the conversation), truncated, or none (an empty kind).

    A row is told a duplicate by the first place of its role and text, one aggregate and one join on the hash of the
    text."""
    text = F.rtrim("text", F.lit(SPACE))
    marked = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumns({"_h": F.sha2("text", 256), "_blank": text == "", "_cut": ~F.right(text, F.lit(1)).isin(".", "!", "?")})
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = marked.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_h").alias("_t")).agg(F.min(place).alias("_first"), F.count("*").alias("_many")).where("_many > 1").drop("_many")
    joined = marked.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_h") == F.col("_t")), "left")
    kind = F.when(F.col("_blank"), "blank").when(F.col("_first").isNotNull() & (F.col("_first") < place), "duplicate").when(F.col("_cut"), "truncated").otherwise("")
    initials = grammar.initials
    initial = F.array_position(F.array(*[F.lit(c) for c in initials]), F.substring("role", 1, 1)).cast("int")
    code = F.when(initial == 0, len(initials)).otherwise(initial - 1) * 3 + F.when(kind.isin("blank", "duplicate"), 2).when(kind == "truncated", 1).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "n", kind.alias("kind"), code.cast("int").alias("cls"))


def repair(rows: DataFrame, grammar: TurnGrammar = TurnGrammar(), scratch: Scratch | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """The cheapest edits that make conversations follow the grammar: conv_id, at, step, edit, turn, kind, was, role, text, n.

    Rows of a conversation are taken by turn (nulls first), those of one turn by role and text; at and step are their order
    and that of the insertions.  edit: K kept, R given another role, D deleted (a must for blank and duplicate rows), I
    inserted; role and text: of the repaired row (role null where it is deleted).  Of all cheapest edits those are given
    whose letters are least.  Equal rows are one row with their number n (times `copies`, if given); all but the first are
    deleted.  A null role or text is an empty one, rows with a null conv_id are one conversation.  No rows: no rows.
    Other columns are not read.

    A conversation may lie in any number of parts: only its cost matrices, one a part, meet on the driver."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    graph = _Graph(grammar)
    n = F.lit(1) if copies is None else F.col(copies)
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"), n.cast("bigint").alias("n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # the beginning of a text splits a crowded turn; whole texts would be too large as bounds
    ordered = faults(plain, grammar, scratch).repartitionByRange(4 * shuffle_partitions(spark), *order, F.substring("text", 1, 16)).sortWithinPartitions(*order, "text")
    ordered = ordered.withColumn("at", F.monotonically_increasing_id())
    key, when = (plain.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    kinds = f"conv_id {key}, at bigint, step int, edit string, turn {when}, kind string, was string, role string, text string, n bigint, cls int"

    def within(batches):
        import pyarrow as pa

        for batch, border in _sections(batches):
            if border:  # it may go on in another part: its rows as they are
                none = lambda t: pa.nulls(batch.num_rows, t)
                columns = [batch.column("conv_id"), batch.column("at"), none(pa.int32()), none(pa.string()), batch.column("turn"), batch.column("kind"), batch.column("role"), batch.column("role"), batch.column("text"), batch.column("n"), batch.column("cls")]
            else:
                out, _ = _edited(batch, graph)
                columns = [*out.columns, pa.nulls(out.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*EDITS, "cls"])

    stored = scratch.write(ordered.mapInArrow(within, kinds), "edits")
    blocks = stored.where("edit IS NULL").drop("step", "edit", "was").repartition(F.shiftright("at", 33)).sortWithinPartitions("at")
    return stored.where("edit IS NOT NULL").drop("cls").unionByName(_across(blocks, graph, kinds))


def _blocks(batches):
    """The blocks of a task: rows of one conversation in one part."""
    import pyarrow as pa

    held = []
    same = lambda a, b: a.column("conv_id")[-1].as_py() == b.column("conv_id")[0].as_py() and a.column("at")[-1].as_py() >> 33 == b.column("at")[0].as_py() >> 33
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("at").to_numpy() >> 33
        cuts = sorted({*_cuts(batch.column("conv_id")).tolist(), *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()})
        ends = [*cuts, batch.num_rows]
        for a, b in zip([0, *cuts], ends, strict=True):
            piece = batch.slice(a, b - a)
            if held and not same(held[-1], piece):
                yield pa.concat_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_batches(held)


def _across(blocks: DataFrame, graph: _Graph, kinds: str) -> DataFrame:
    """The edits of conversations at the borders of parts.  A part has two blocks at most: the driver holds, for each, a cost
    matrix and the states behind it for each state before it."""
    n = graph.n
    key = blocks.schema["conv_id"].dataType.simpleString()

    def costs(batches):
        import pyarrow as pa

        for block in _blocks(batches):
            m = block_matrix(graph, block.column("cls").to_numpy())
            yield pa.RecordBatch.from_arrays([block.column("conv_id").slice(0, 1), block.column("at").slice(0, 1), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], names=["conv_id", "at", "m"])

    found = sorted(((r["at"], r["conv_id"], np.array(r["m"], np.int64).reshape(n, n)) for r in blocks.mapInArrow(costs, f"conv_id {key}, at bigint, m array<bigint>").collect()), key=lambda x: x[0])
    chains: list[list[int]] = []
    for i, (_, conv, _) in enumerate(found):
        if i and found[i - 1][1] == conv:
            chains[-1].append(i)
        else:
            chains.append([i])
    close_end = np.minimum((graph.close + graph.end[None]).min(1), INF)
    start = np.where(np.arange(n) == 0, 0, INF)
    plan: dict[int, tuple] = {}
    for chain in chains:
        cur, before = start, {}
        for i in chain:
            before[i] = cur
            cur = np.minimum((cur[:, None] + found[i][2]).min(0), INF)
        cur = close_end
        for i in reversed(chain):
            plan[found[i][0]] = (before[i], cur, i == chain[-1])
            cur = np.minimum((found[i][2] + cur[None]).min(1), INF)

    def solved(block, enter):
        b, a, last = plan[block.column("at")[0].as_py()]
        return _edited(block, graph, b[None], a[None], np.array([enter]), np.array([last]))

    def behind(batches):
        import pyarrow as pa

        for block in _blocks(batches):
            at = block.column("at")[0].as_py()
            b, a, _ = plan[at]
            back = np.minimum((block_matrix(graph, block.column("cls").to_numpy()) + a[None]).min(1), INF)
            on = (b < INF) & (b + back == (b + back).min())
            ends = [int(solved(block, 1 << i)[1][0]) if on[i] else 0 for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ends], pa.list_(pa.int64()))], names=["at", "ends"])

    ends = {}
    if any(len(c) > 1 for c in chains):
        several = [found[i][0] for c in chains if len(c) > 1 for i in c]
        spark = blocks.sparkSession
        own = spark.createDataFrame([(x >> 33,) for x in several], "p bigint").distinct()
        some = blocks.join(F.broadcast(own), F.shiftright("at", 33) == F.col("p"), "left_semi").repartition(F.shiftright("at", 33)).sortWithinPartitions("at")
        ends = {r["at"]: r["ends"] for r in some.mapInArrow(behind, "at bigint, ends array<bigint>").collect()}
    enter = {}
    for chain in chains:
        held = 1
        for i in chain:
            at = found[i][0]
            enter[at] = held
            if i != chain[-1]:
                out = 0
                for k in range(n):
                    out |= ends[at][k] if held >> k & 1 else 0
                held = out

    def edits(batches):
        for block in _blocks(batches):
            yield solved(block, enter[block.column("at")[0].as_py()])[0]

    return blocks.mapInArrow(edits, kinds.removesuffix(", cls int"))


def audits(edits: DataFrame, grammar: TurnGrammar = TurnGrammar()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation that has rows.

    A task reads conversations row by row, sorted, and keeps of one only the hash so far and the letters."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    legal = set(grammar.pairs())
    price = {"K": grammar.keep, "R": grammar.rerole, "D": grammar.delete, "I": grammar.insert}

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        now = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "kind", "was", "role", "text", "n")]
            for conv, edit, turn, fault, was, role, text, n in zip(*columns, strict=True):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        done.append(now)
                    now = {"conv": conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "rows": 0, "initial": None}
                now["audit"] += edit.encode()
                now["cost"] += price[edit]
                if edit != "I":
                    if turn is not None and turn != now["high"]:
                        now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
                    initial = was[:1]
                    now["illegal"] += now["initial"] is not None and now["initial"] + initial not in legal
                    now["initial"] = initial
                    if fault:
                        now[fault] += 1
                    if fault == "truncated" and edit != "D":
                        now["cost"] += grammar.truncated
                    if n > 1:  # the copies of the row stand behind it, and go
                        now["audit"] += b"D" * (n - 1)
                        now["cost"] += grammar.delete * (n - 1)
                        now["blank" if fault == "blank" else "duplicate"] += n - 1
                        now["illegal"] += (n - 1) * (initial + initial not in legal)
                if edit != "D":
                    now["sha"].update((("\n" if now["rows"] else "") + role + ":" + text).encode())
                    now["rows"] += 1
            yield _audit_batch(done, names, batch.schema.field("conv_id").type)
            kind_of = batch.schema.field("conv_id").type
        if now is not None:
            yield _audit_batch([now], names, kind_of)

    def _audit_batch(done, names, conv_type):
        import pyarrow as pa

        gaps = [0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"] for x in done]
        counts = [pa.array([x[c] for x in done], pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return pa.RecordBatch.from_arrays(
            [pa.array([x["conv"] for x in done], conv_type), pa.array(gaps, pa.int64()), *counts, pa.array([x["audit"].decode() for x in done], pa.string()), pa.array([x["sha"].hexdigest() for x in done], pa.string())],
            names=names,
        )

    dealt = edits.select("conv_id", "at", "step", "edit", "turn", "kind", "was", "role", "text", "n").repartition(4 * shuffle_partitions(edits.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", "step")
    return dealt.mapInArrow(run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repaired(edits: DataFrame) -> DataFrame:
    """conv_id, at, step, role, text of the repaired conversations, a row a turn, in the order of (at, step)."""
    return edits.where("edit != 'D'").select("conv_id", "at", "step", "role", "text")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n of rows damaged by their place, nulls being one space: of twenty, one is dropped, one
    loses its text, one its ends of sentences, one is there twice, and one is a user's."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv), F.lit(":"), some(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some(text), "[.!?]", "")).otherwise(some(text))
    hurt = rows.where(kind != 0)
    return hurt.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(some(role)).alias("role"), body.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))
