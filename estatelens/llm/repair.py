"""Conversation structure repair by iterative-deepening A*.

A turn is kept, re-roled, deleted or preceded by inserted turns, so that the roles read ``(s?(ua)+)?``. The search is
depth first in the ASCII order of the edits (D, I, K, R) under cost bounds that rise to the least cost seen beyond
them; a table of failed states keeps, for each position and role state, the largest budget that led nowhere. The first
accepting path under the first bound that has one is the answer: cheapest, and the least of its equals. The estimate
of what is left comes from a table of the cheapest repairs of single turns and of pairs of neighbours, which holds at
any place of a conversation.

The search reads one letter per turn, never the text. Inserted turns belong to the turn after them, so that stretches
of a conversation can be searched apart: for each role state before and after a stretch of ``STRETCH`` turns the
search finds the cheapest edits, and the stretches are joined by the same order (cost, then ASCII). A conversation of
more than ``CHUNK`` turns is spread over tasks in chunks; a task sees all of a conversation only as one small table of
costs and ranks for each chunk.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import global_index, materialize
from .common import only

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns searched at once.
STRETCH = 24
#: Turns of one conversation in one row.
CHUNK = 4096
#: Role states: nothing yet, after system, after user, after assistant. First and last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
NEVER = 1 << 40
#: Whitespace and sentence ends, as the contract's patterns have them.
SEEN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# A turn's letter: its role's initial, or ``x`` for any other. Upper case: truncated. ``-``: blank or duplicate.


def _after(state: int, initial: str) -> int | None:
    """Role state after a role, or None where the role may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def _new(state: int) -> int:
    """Role state after a turn whose role may be chosen: an assistant answers a user, else a user speaks."""
    return ASSISTANT if state == USER else USER


def _edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of one turn, without insertions, in ASCII order."""
    out = [("D", DELETE, state)]
    if letter != "-":
        extra = TRUNCATED if letter.isupper() else 0
        kept = _after(state, letter.lower())
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, _new(state)))
    return out


@functools.cache
def _least(letters: str) -> int:
    """Cheapest repair of one turn or of two neighbours, from any role state to any."""
    best = dict.fromkeys(STATES, 0)
    for letter in letters:
        reach: dict[int, int] = {}
        for state, cost in best.items():
            for n in range(3):  # more insertions come back to a state seen
                for _, c, to in _edits(letter, state):
                    reach[to] = min(reach.get(to, NEVER), cost + n * INSERT + c)
                state = _new(state)
        best = reach
    return min(best.values())


def _estimates(letters: str, start: int, goals: tuple[int, ...]) -> list[int]:
    """What the turns from each position on cost at least: the best cover by single turns and pairs.

    A goal before any user turn means that all turns go, but for a system turn that leads there.
    """
    n = len(letters)
    if max(goals) <= SYSTEM:
        spare = 1 if start not in goals else 0
        return [DELETE * max(0, n - i - spare) for i in range(n + 2)]
    out = [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = max(out[i + 1] + _least(letters[i]), out[i + 2] + _least(letters[i : i + 2]) if i + 1 < n else 0)
    return out


def _possible(letters: str, start: int, goal: int) -> bool:
    """Whether any edits lead from one role state to another."""
    if goal == START:
        return start == START
    if goal == SYSTEM:
        return start == SYSTEM or start == START and "s" in letters.lower()
    return True


def search(letters: str, start: int = START, goals: tuple[int, ...] = ENDS, last: bool = True) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest repair of a stretch, the ASCII-least among equals; None if no goal can be met.

    ``last`` says that no turn follows, so that insertions may end the stretch.
    """
    goals = tuple(g for g in goals if _possible(letters, start, g))
    if not goals:
        return None
    if not letters and start in goals:
        return 0, ""
    estimate = _estimates(letters, start, goals)
    n, bound = len(letters), estimate[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = NEVER

        def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
            out = [(e, c, i + 1, to) for e, c, to in _edits(letters[i], state)] if i < n else []
            if i < n or last:
                out.insert(1 if out else 0, ("I", INSERT, i, _new(state)))
            return out

        # Depth first without recursion: each frame is a state, the cost so far and the moves left to try.
        path: list[str] = []
        frames = [(0, start, 0, iter(moves(0, start)))]
        while frames:
            i, state, cost, rest = frames[-1]
            for edit, c, j, to in rest:
                total = cost + c
                if total + estimate[j] > bound:
                    beyond = min(beyond, total + estimate[j])
                    continue
                if failed.get((j, to), -1) >= bound - total:
                    continue
                if j == n and to in goals:
                    return total, "".join(path) + edit
                path.append(edit)
                frames.append((j, to, total, iter(moves(j, to))))
                break
            else:
                failed[i, state] = bound - cost
                frames.pop()
                if path:
                    path.pop()
        bound = beyond


_stretch = functools.lru_cache(1 << 15)(search)
Table = list[list[tuple[int, str] | None]]


def _paths(letters: str, start: int, last: bool) -> list[tuple[int, str] | None]:
    """Cheapest edits of a chunk from one role state to each, stretch by stretch."""
    now: list = [None] * 4
    now[start] = (0, "")
    cuts = range(0, max(1, len(letters)), STRETCH)
    for at in cuts:
        part, end = letters[at : at + STRETCH], last and at + STRETCH >= len(letters)
        after: list = [None] * 4
        for state in STATES:
            if now[state] is None:
                continue
            for to in STATES:
                step = _stretch(part, state, (to,), end)
                if step is not None:
                    found = (now[state][0] + step[0], now[state][1] + step[1])
                    if after[to] is None or found < after[to]:
                        after[to] = found
        now = after
    return now


def solve(letters: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    if len(letters) <= STRETCH:
        return _stretch(letters)
    paths = _paths(letters, START, True)
    return min(paths[end] for end in ENDS if paths[end] is not None)


def _illegal(letters: str, before: str | None) -> int:
    """Neighbours whose roles may not follow each other; ``letters`` are role initials."""
    row = (before or "") + letters
    return sum(row[i : i + 2] not in ("su", "ua", "au") for i in range(len(row) - 1))


def _summaries(batches):
    """Costs and ranks of each chunk of a long conversation, for every role state before and after."""
    for b in batches:
        cost, rank = [], []
        for letters, last in zip(b.column("letters").to_pylist(), b.column("last").to_pylist(), strict=True):
            costs, ranks = [], []
            for start in STATES:
                paths = _paths(letters, start, last)
                order = sorted(range(4), key=lambda to: (paths[to] is None, paths[to][1] if paths[to] else ""))
                costs += [NEVER if p is None else p[0] for p in paths]
                ranks += [order.index(to) for to in STATES]
            cost.append(costs)
            rank.append(ranks)
        yield pa.record_batch({"conv": b.column("conv"), "chunk": b.column("chunk"), "cost": pa.array(cost, pa.list_(pa.int64())), "rank": pa.array(rank, pa.list_(pa.int32()))})


def _entries(batches):
    """Role states before and after each chunk on the best path through a whole long conversation."""
    for b in batches:
        conv, chunk, start, end = [], [], [], []
        for c, tables in zip(b.column("conv").to_pylist(), b.column("tables").to_pylist(), strict=True):
            left = [0 if s in ENDS else NEVER for s in STATES]
            rest = [left]
            for t in reversed(tables):
                left = [min(min(t["cost"][4 * s + to] + left[to] for to in STATES), NEVER) for s in STATES]
                rest.append(left)
            rest.reverse()
            state = START
            for k, t in enumerate(tables):
                best = [to for to in STATES if t["cost"][4 * state + to] + rest[k + 1][to] == rest[k][state]]
                to = min(best, key=lambda x: t["rank"][4 * state + x])
                conv.append(c)
                chunk.append(t["chunk"])
                start.append(state)
                end.append(to)
                state = to
        yield pa.record_batch({"conv": pa.array(conv, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})


def _edited(batches):
    """Cost and edits of each chunk; without a state before it, the chunk is a whole conversation."""
    for b in batches:
        out = []
        columns = [b.column(c).to_pylist() for c in ("letters", "last", "start", "end")]
        for letters, last, start, end in zip(*columns, strict=True):
            out.append(solve(letters) if start is None else _paths(letters, start, last)[end])
        illegal = [_illegal(r, p) for r, p in zip(b.column("roles").to_pylist(), b.column("before").to_pylist(), strict=True)]
        yield pa.record_batch(
            {
                "conv": b.column("conv"),
                "chunk": b.column("chunk"),
                "start": pa.array([s or START for s in columns[2]], pa.int32()),
                "letters": b.column("letters"),
                "cost": pa.array([o[0] for o in out], pa.int64()),
                "edits": pa.array([o[1] for o in out], pa.string()),
                "illegal": pa.array(illegal, pa.int64()),
            }
        )


def _turns(size):
    """One row per turn of a chunk: its edit, its new role, and the roles inserted before and after it."""

    def run(batches):
        for b in batches:
            conv, pos, edit, role, before, after = [], [], [], [], [], []
            for c, k, state, edits, letters in zip(*[b.column(x).to_pylist() for x in ("conv", "chunk", "start", "edits", "letters")], strict=True):
                at, new = 0, []
                for e in edits:
                    if e != "D" and e != "K":
                        state = _new(state)
                    said = "assistant" if state == ASSISTANT else "user"
                    if e == "I":
                        new.append(said)
                        continue
                    if e == "K":
                        state = _after(state, letters[at].lower())
                    conv.append(c)
                    pos.append(k * size + at)
                    edit.append(e)
                    role.append(said if e == "R" else None)
                    before.append(new)
                    after.append([])
                    at, new = at + 1, []
                after[-1] = new
            yield pa.record_batch(
                {
                    "idx": pa.array([c + p for c, p in zip(conv, pos, strict=True)], pa.int64()),
                    "edit": pa.array(edit, pa.string()),
                    "new_role": pa.array(role, pa.string()),
                    "before": pa.array(before, pa.list_(pa.string())),
                    "after": pa.array(after, pa.list_(pa.string())),
                }
            )

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations(conv_id, turn, role, text)`` with the damage that the contract sets by their key."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array().cast("array<int>")).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", F.explode(copies).alias("_copy")).drop("_copy")


def _letters(faults: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, n, letters, roles, before, last): the letters of each chunk and the role before it."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "letter", "initial")))
    text = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    chunks = faults.groupBy("conv", F.floor(F.col("pos") / size).alias("chunk")).agg(rows.alias("rows"), F.max("n").alias("n"))
    chunks = chunks.select("conv", "chunk", "n", text("letter").alias("letters"), text("initial").alias("roles"))
    before = F.lag(F.right("roles", F.lit(1))).over(Window.partitionBy("conv").orderBy("chunk"))
    return chunks.withColumn("before", before).withColumn("last", (F.col("chunk") + 1) * size >= F.col("n"))


def _states(chunks: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, start, end): role states around the chunks of conversations that have several."""
    long = chunks.where(F.col("n") > size).select("conv", "chunk", "letters", "last")
    tables = long.mapInArrow(_summaries, "conv long, chunk long, cost array<long>, rank array<int>")
    whole = tables.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "cost", "rank"))).alias("tables"))
    return whole.mapInArrow(_entries, "conv long, chunk long, start int, end int")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Repairs of the conversations of ``rows(conv_id, turn, role, text)``.

    First the conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit). Then their turns:
    (conv_id, idx, turn, role, text, edit, new_role, before, after), where idx orders the turns, ``before`` and
    ``after`` are the roles of empty turns inserted around the turn, and edit is K, R or D.

    Turns go by turn number, null first, then by role and text; a null role or text reads as one blank, and a
    repeated row is a duplicate. A null conv_id is a conversation of its own. A role that starts with another letter
    than s, u or a, or is empty, cannot be kept. Texts of any length stay in Spark's own functions. Other columns
    take no part. An empty table gives no rows.
    """
    rows = only(rows, conv_id="long", turn="long", role="string", text="string").na.fill(" ", ["role", "text"])
    rows = rows.withColumn("head", F.substring("text", 1, 32))
    rows = global_index(rows, "conv_id", "turn", "role", "head", within=("text",)).drop("head")
    same = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.length("role"), "role", "text"), 256))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    blank, cut = ~F.col("text").rlike(SEEN), ~F.col("text").rlike(ENDED)
    light = rows.select("conv_id", "turn", "idx", initial.alias("initial"), blank.alias("blank"), cut.alias("cut"), same.alias("same"))
    light = materialize(light, "repair-light")
    again = light.df.groupBy("same").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    head = light.df.groupBy("conv_id").agg(F.min("idx").alias("conv"), F.count(F.lit(1)).alias("n"))
    head = materialize(head, "repair-head")
    faults = light.df.join(again, "same", "left").withColumn("fault", F.when(F.col("blank"), "blank").when(F.col("idx") > F.col("first"), "duplicate").when(F.col("cut"), "truncated"))
    faults = faults.alias("f").join(head.df.alias("h"), F.expr("f.conv_id <=> h.conv_id")).select("conv", "n", "idx", "turn", "initial", "fault", (F.col("idx") - F.col("conv")).alias("pos"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    faults = materialize(faults.withColumn("letter", letter), "repair-faults")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    counts = faults.df.groupBy("conv").agg(*counts)
    distinct = faults.df.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv")
    gaps = distinct.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    chunks = materialize(_letters(faults.df, chunk), "repair-chunks")
    edited = chunks.df.join(_states(chunks.df, chunk), ["conv", "chunk"], "left").select("conv", "chunk", "letters", "roles", "before", "last", "start", "end")
    edited = materialize(edited.mapInArrow(_edited, "conv long, chunk long, start int, letters string, cost long, edits string, illegal long"), "repair-edits")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "edits")))
    whole = edited.df.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit"))
    out = head.df.join(whole, "conv").join(counts, "conv").join(gaps, "conv", "left")
    out = out.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    summary = materialize(out, "repair-conversations").df
    turns = edited.df.mapInArrow(_turns(chunk), "idx long, edit string, new_role string, before array<string>, after array<string>").join(rows, "idx")
    turns = turns.select("conv_id", "idx", "turn", "role", "text", "edit", "new_role", "before", "after")
    for done in (light, head, faults, chunks):
        done.drop()
    return summary, turns


def repaired_digest(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns: the digest is of a whole conversation, so its text meets in one row."""
    empty = lambda roles: F.transform(roles, lambda r: F.concat(r, F.lit(":")))
    kept = F.array(F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    lines = F.concat(empty("before"), F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(kept), empty("after"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", lines.alias("lines")))), lambda t: t["lines"]))
    return turns.groupBy("conv_id").agg(F.sha2(F.array_join(whole, "\n").cast("binary"), 256).alias("repaired_sha256"))
