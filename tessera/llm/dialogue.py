"""Cheapest repair of conversations by a lazily determinised weighted automaton.

The roles of a repaired conversation have initials ``(s?(ua)+)?``: four places of a small
automaton. Seen from a row, what the rest of the conversation costs from each place is a
vector of four numbers; less its own least, it is one of few vectors, and these are the states of a
deterministic automaton that reads rows from the last to the first. Its transitions,
(vector, kind of row) -> (vector before it, cost), are worked out when they first occur
and kept in a table, so that the scan is a look-up a row, for all conversations of a task
at once. The audit is then traced backward along the scan, from the first row to the last,
over arcs that are tight, the ASCII-least first; these steps are kept in a table as well.

Rows lie in stretches of (conversation, turn): a long conversation spans many tasks. A
stretch's map from each state at its end to that at its beginning, and from each place at
its beginning to that at its end, is all that the next ones need; two such maps a task go
to the driver, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._native import SPACES
from tessera.llm._store import bounded, cut, shared_dir, written

DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
#: Places: nothing yet, behind a system row, behind a user, behind an assistant. Where an initial leads; a place may end a conversation.
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
FREE = ["u", "u", "a", "u"]  # the role that an inserted or renamed row takes at each place
NAMES = {"u": "user", "a": "assistant"}
#: Kinds of rows: initials s, u, a and others, plain and cut short; the last must be deleted.
INITIALS, GONE = "sua?", 8
EDITS = "DKR"


class Automaton:
    """The determinised automaton as far as it was needed."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.index: dict[tuple[int, ...], int] = {}
        self.back = np.full((0, 9), -1, np.int32)  # the state before a row, -1: not yet known
        self.cost = np.zeros((0, 9), np.int64)
        self.steps = np.full((0, 9, 4, 3), -1, np.int8)  # (inserted, edit, place) of the trace
        self.end, self.rest = self._state(self._inserted([0 if q in ENDS else 1 << 40 for q in range(4)]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        v = tuple(c - low for c in costs)
        if v not in self.index:
            self.index[v] = len(self.vectors)
            self.vectors.append(v)
            self.back = np.concatenate((self.back, np.full((1, 9), -1, np.int32)))
            self.cost = np.concatenate((self.cost, np.zeros((1, 9), np.int64)))
            self.steps = np.concatenate((self.steps, np.full((1, 9, 4, 3), -1, np.int8)))
        return self.index[v], low

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        """The costs when rows may be inserted first."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[GOES[q, FREE[q]]]) for q, c in enumerate(costs)]
        return costs

    @staticmethod
    def arcs(kind: int, q: int) -> list[tuple[int, int, int]]:
        """(edit, its cost, place behind it) of a row at a place, by the edit's letter."""
        out = [(0, DELETE, q)]
        if kind != GONE:
            more, initial = CUT_SHORT * (kind >= 4), INITIALS[kind % 4]
            if (q, initial) in GOES:
                out.append((1, more, GOES[q, initial]))
            out.append((2, more + REROLE, GOES[q, FREE[q]]))
        return out

    def costs_before(self, state: int, kind: int) -> list[int]:
        v = self.vectors[state]
        return self._inserted([min(c + v[to] for _, c, to in self.arcs(kind, q)) for q in range(4)])

    def before(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state before the rows, cost)."""
        out = self.back[state, kind]
        if (out < 0).any():
            for s, k in set(zip(state[out < 0].tolist(), kind[out < 0].tolist())):
                at, low = self._state(self.costs_before(s, k))
                self.back[s, k], self.cost[s, k] = at, low
            out = self.back[state, kind]
        return out, self.cost[state, kind]

    def traced(self, state: np.ndarray, kind: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(rows inserted first, edit, place behind) of rows whose end is in ``state``, at places ``q``."""
        out = self.steps[state, kind, q]
        if (out < 0).any():
            miss = out[:, 0] < 0
            for s, k, p in set(zip(state[miss].tolist(), kind[miss].tolist(), q[miss].tolist())):
                self.steps[s, k, p] = self._step(s, k, p)
            out = self.steps[state, kind, q]
        return out

    def _step(self, state: int, kind: int, q: int) -> tuple[int, int, int]:
        costs, v, put = self.costs_before(state, kind), self.vectors[state], 0
        while True:
            tight = [(edit, to) for edit, c, to in self.arcs(kind, q) if c + v[to] == costs[q]]
            more = INSERT + costs[GOES[q, FREE[q]]] == costs[q]
            if tight and not (more and tight[0][0] > 0):  # D comes before I, I before K and R
                return put, *tight[0]
            q, put = GOES[q, FREE[q]], put + 1

    def last(self, q: int) -> int:
        """Rows inserted behind the last one."""
        return {0: 0, 1: 2, 2: 1, 3: 0}[q]

    def every(self) -> list[int]:
        """All states that any rows lead to."""
        seen, todo = {self.end}, [self.end]
        while todo:
            s = np.full(9, todo.pop())
            for t in set(self.before(s, np.arange(9))[0].tolist()) - seen:
                seen.add(t)
                todo.append(t)
        return sorted(seen)


def _scan(auto: Automaton, kind: np.ndarray, begin: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state behind each row, state before each run, cost of each run) of the runs [begin, end), which end in states ``last``."""
    behind, now, cost = np.zeros(len(kind), np.int32), last.astype(np.int32).copy(), np.zeros(len(begin), np.int64)
    order = np.argsort(begin - end, kind="stable")
    size = (end - begin)[order]
    for t in range(int(size.max(initial=0))):
        runs = order[: np.searchsorted(-size, -t, "left")]
        at = end[runs] - 1 - t
        behind[at] = now[runs]
        now[runs], more = auto.before(now[runs], kind[at])
        cost[runs] += more
    return behind, now, cost


def _trace(auto: Automaton, kind: np.ndarray, behind: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inserted, edit, place before) of each row, and the place behind each run, from the places that runs begin at."""
    out, at_place, q = np.zeros((len(kind), 2), np.int8), np.zeros(len(kind), np.int8), place.astype(np.int8).copy()
    order = np.argsort(begin - end, kind="stable")
    size = (end - begin)[order]
    for t in range(int(size.max(initial=0))):
        runs = order[: np.searchsorted(-size, -t, "left")]
        at = begin[runs] + t
        at_place[at] = q[runs]
        got = auto.traced(behind[at], kind[at], q[runs])
        out[at], q[runs] = got[:, :2], got[:, 2]
    return out, at_place, q


def _runs(conv: list) -> tuple[np.ndarray, np.ndarray]:
    change = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1])] if conv else []
    return np.array(change, np.int64), np.array([*change[1:], len(conv)] if conv else [], np.int64)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maps of a stretch's first and last conversation."""
    held = [b.select(["conv", "kind", "initial"]) for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    conv, kind, initial = t.column("conv").to_pylist(), t.column("kind").to_numpy(), t.column("initial")
    begin, end = _runs(conv)
    auto = Automaton()
    states = auto.every()
    rows = []
    for k in sorted({0, len(begin) - 1}):
        n = len(states)
        one = np.zeros(n, np.int64)
        part = kind[begin[k] : end[k]]
        tiled, first = np.tile(part, n), np.arange(n) * len(part)
        behind, now, cost = _scan(auto, tiled, first, first + len(part), np.array(states))
        to = [_trace(auto, tiled, behind, first, first + len(part), one + q)[2].tolist() for q in range(4)]
        vectors = [list(auto.vectors[s]) for s in states]
        rows.append({"stretch": TaskContext.get().partitionId(), "run": k, "runs": len(begin), "conv": conv[begin[k]], "initial": initial[int(end[k]) - 1].as_py(), "states": vectors, "before": [list(auto.vectors[s]) for s in now.tolist()], "places": [list(x) for x in zip(*to)]})
    kinds = {"stretch": pa.int32(), "run": pa.int32(), "runs": pa.int32(), "conv": t.schema.field("conv").type, "initial": pa.string(), "states": pa.list_(pa.list_(pa.int64())), "before": pa.list_(pa.list_(pa.int64())), "places": pa.list_(pa.list_(pa.int32()))}
    yield from pa.Table.from_pylist(rows, pa.schema(kinds)).to_batches()


def _joined(rows: list) -> dict[tuple[int, int], dict]:
    """For runs that go on in other stretches: the state at their end, the place and initial before them, whether they end there."""
    rows = sorted(rows, key=lambda r: (r.stretch, r.run))
    chains: list[list] = []
    for r in rows:
        if chains and chains[-1][-1].conv == r.conv and chains[-1][-1].stretch != r.stretch and r.run == 0:
            chains[-1].append(r)
        else:
            chains.append([r])
    out, auto = {}, Automaton()
    for chain in chains:
        if len(chain) < 2:
            continue
        state = auto.vectors[auto.end]
        for r in reversed(chain):
            out[r.stretch, r.run] = {"state": state, "goes_on": r is not chain[-1]}
            state = tuple(r.before[r.states.index(list(state))])
        place, initial = 0, None
        for r in chain:
            told = out[r.stretch, r.run]
            told |= {"place": place, "initial": initial, "begun": r is not chain[0]}
            place, initial = r.places[r.states.index(list(told["state"]))][place], r.initial
    return out


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, times, blank, repeats, cut_short, initial, kind): distinct rows, how often each comes and what is wrong with it."""
    name = lambda c: F.col(f"`{c}`")
    plain = rows.select(name(conv).alias("conv"), name(turn).cast("bigint").alias("turn"), F.coalesce(name(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(name(text).cast("string"), F.lit(" ")).alias("text"))
    once = plain.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("times"))
    once = once.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    first = once.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).turn.alias("first"))
    first = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first")
    met = once.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = body == ""
    new = F.col("turn").eqNullSafe(F.col("first"))
    repeats = F.when(blank, 0).otherwise(F.col("times") - new.cast("int"))
    short = ~blank & new & ~F.substring(body, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(blank | ~new, GONE).otherwise(place + 4 * short.cast("int"))
    return met.select("conv", "turn", "role", "text", "h1", "h2", "times", F.when(blank, F.col("times")).otherwise(0).alias("blank"), repeats.alias("repeats"), short.cast("bigint").alias("cut_short"), initial.alias("initial"), kind.cast("int").alias("kind"))


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_a_task: int = 200_000, bytes_a_task: int = 32 << 20) -> DataFrame:
    """(conv, place, edit, times, turn, role, text, blank, repeats, cut_short, illegal, cost): the cheapest edits of each conversation, by ``place``.

    An ``edit`` is K (kept), R (role changed to what the row has here), D (deleted) or I
    (inserted, with an empty text and no turn); equal rows that are deleted together have ``times``. The
    other columns count faults of the rows as they came: blank, repeats (role and text seen
    before), cut_short (no ``.!?`` at the end), illegal (a role that may not follow the one
    before); ``cost`` is the edit's share. Null roles and texts are one space. Rows go by turn, null
    first, rows of one turn by role and then by a hash of the text; the null conversation is one like
    others. A role without an initial of s, u or a, an empty one included, can't be kept. An
    empty table gives no rows; further columns are not looked at.
    """
    spark = rows.sparkSession
    bounded(spark)
    shared_dir(spark)
    made = prepared(rows, conv, turn, role, text)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))), F.lit(0))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // rows_a_task), -(-size // bytes_a_task))
    key = ["conv", "turn", "role", "h1", "h2"]
    ranged = cut(made.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("h1", "h2"))
    kind = made.schema["conv"].dataType.simpleString()
    edges = ranged.mapInArrow(_edges, f"stretch int, run int, runs int, conv {kind}, initial string, states array<array<bigint>>, before array<array<bigint>>, places array<array<int>>")
    sent = spark.sparkContext.broadcast(_joined(edges.collect()))  # at most two rows a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        conv, kinds, initial = t.column("conv").to_pylist(), t.column("kind").to_numpy(), t.column("initial").to_pylist()
        times = t.column("times").to_numpy()
        begin, end = _runs(conv)
        stretch, known, auto = TaskContext.get().partitionId(), sent.value, Automaton()
        told = [known.get((stretch, k), {}) for k in range(len(begin))]
        auto.every() if any(told) else None
        last = np.array([auto.index[x["state"]] if x else auto.end for x in told])
        place = np.array([x.get("place", 0) for x in told])
        behind, _, _ = _scan(auto, kinds, begin, end, last)
        step, at, q = _trace(auto, kinds, behind, begin, end, place)
        names = t.column("role").to_pylist()
        out = {c: [] for c in ("row", "seq", "edit", "times", "role", "illegal", "cost")}

        def put(row, edit, times, role, illegal, cost):
            for c, v in zip(out, (row, len(out["row"]), edit, times, role, illegal, cost)):
                out[c].append(v)

        for k in range(len(begin)):
            before, begun = told[k].get("initial"), told[k].get("begun", False)
            for i in range(begin[k], end[k]):
                p = int(at[i])
                for _ in range(step[i, 0]):
                    put(None, "I", 1, NAMES[FREE[p]], 0, INSERT)
                    p = GOES[p, FREE[p]]
                mine = initial[i]
                bad = int((begun or i > begin[k]) and f"{before}{mine}" not in ("su", "ua", "au"))
                bad += int(times[i] - 1) * (mine + mine not in ("su", "ua", "au"))
                before, edit = mine, EDITS[step[i, 1]]
                more = CUT_SHORT * (4 <= kinds[i] < GONE)
                if edit == "D":
                    put(i, "D", int(times[i]), names[i], bad, DELETE * int(times[i]))
                else:
                    put(i, edit, 1, names[i] if edit == "K" else NAMES[FREE[p]], bad, more + REROLE * (edit == "R"))
                    if times[i] > 1:
                        put(None, "D", int(times[i]) - 1, names[i], 0, DELETE * (int(times[i]) - 1))
            if not told[k].get("goes_on"):
                p = int(q[k])
                for _ in range(auto.last(p)):
                    put(None, "I", 1, NAMES[FREE[p]], 0, INSERT)
                    p = GOES[p, FREE[p]]
            out.setdefault("conv", []).extend([conv[begin[k]]] * (len(out["row"]) - len(out.get("conv", []))))
        row = pa.array(out["row"], pa.int64())
        took = t.take(row)
        texts = pa.array(["" if e == "I" else None for e in out["edit"]], took.schema.field("text").type)
        cols = {"conv": pa.array(out["conv"], t.schema.field("conv").type), "place": pa.array([(stretch << 40) + s for s in out["seq"]], pa.int64())}
        cols |= {"edit": pa.array(out["edit"], pa.string()), "times": pa.array(out["times"], pa.int64()), "turn": took.column("turn"), "role": pa.array(out["role"], pa.string()), "text": pa.chunked_array([pa.compute.coalesce(took.column("text").combine_chunks(), texts)])}
        cols |= {c: pa.compute.fill_null(took.column(c), 0) for c in ("blank", "repeats", "cut_short")} | {"illegal": pa.array(out["illegal"], pa.int64()), "cost": pa.array(out["cost"], pa.int64())}
        yield from pa.table(cols).to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(run, f"conv {kind}, place bigint, edit string, times bigint, turn bigint, role string, text string, blank bigint, repeats bigint, cut_short bigint, illegal bigint, cost bigint")


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, sha256) of each conversation of ``edits``: its edits' letters, and the hash of the repaired lines ``role:text``.

    A conversation streams through one task, as a hash over its text has to; of its text a batch is held, of its edits the letters.
    """
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    rows = edits.select("conv", "place", F.expr("repeat(edit, cast(times as int))").alias("letters"), line.alias("line"))
    kind = edits.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, sha, lines, done, type_ = None, [], None, 0, [], None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], type_), pa.array([x[1] for x in done]), pa.array([x[2] for x in done])], ["conv", "audit", "sha256"])

        for b in batches:
            type_ = b.schema.field("conv").type
            for conv, letters, text in zip(*(b.column(c).to_pylist() for c in ("conv", "letters", "line"))):
                if sha is None or conv != own:
                    if sha is not None:
                        done.append((own, "".join(audit), sha.hexdigest()))
                    own, audit, sha, lines = conv, [], hashlib.sha256(), 0
                audit.append(letters)
                if text is not None:
                    sha.update((("\n" if lines else "") + text).encode())
                    lines += 1
            if len(done) > 4096:
                yield flush()
                done.clear()
        if sha is not None:
            done.append((own, "".join(audit), sha.hexdigest()))
            yield flush()

    return rows.repartition("conv").sortWithinPartitions("conv", "place").drop("place").mapInArrow(run, f"conv {kind}, audit string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` (conv_id, turn, role, text) with the faults that the query repairs, by a hash of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fate == 4, "user").otherwise(blank("role"))
    kept = rows.where(fate != 0)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every conversation's faults after damage, its cheapest repair's cost and audit, and a hash of the repaired text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hurt = damaged(rows)
    edits = written(repaired(hurt), "edits")
    sums = edits.groupBy("conv").agg(*(F.sum(c).alias(to) for c, to in (("blank", "blank"), ("repeats", "duplicate"), ("cut_short", "truncated"), ("illegal", "illegal"), ("cost", "cost"))))
    turns = hurt.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("t")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    told = digests(edits).withColumnRenamed("conv", "d")
    every = rows.select("conv_id").distinct()
    wide = every.join(sums, same("conv_id", "conv"), "left").join(turns, same("conv_id", "t"), "left").join(told, same("conv_id", "d"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return wide.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
