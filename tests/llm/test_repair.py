"""Conversation repair against an exhaustive search and plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from estatelens.llm import repair
from estatelens.llm.queries import op12_conversation_repair
from estatelens.llm.repair import damaged, repaired, repaired_digest


def _cheapest(letters):
    """Cheapest edits, ASCII-least among equals, by uniform-cost search over all edit sequences."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        last = roles[-1:]
        if at == len(letters) and (not roles or re.fullmatch("s?(ua)+", roles)):
            return cost, edits
        if (at, last) in done:
            continue
        done.add((at, last))
        new = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, edits + "I", at, roles + new))
        if at < len(letters):
            x = letters[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, roles))
            if x != "-":
                more = 3 if x.isupper() else 0
                heapq.heappush(heap, (cost + 3 + more, edits + "R", at + 1, roles + new))
                if re.fullmatch("(s?(ua)*u?)", roles + x.lower()):
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, roles + x.lower()))


def _letters(size, rng):
    return "".join(rng.choice("suaxSUAX-uuaaua") for _ in range(rng.randint(0, size)))


def test_search_is_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(500):
        x = _letters(9, rng)
        assert repair.search(x) == _cheapest(x), x


def test_stretches_and_chunks_change_nothing(monkeypatch):
    rng = random.Random(2)
    for _ in range(100):
        x = _letters(20, rng)
        whole = repair.search(x)
        for size in (3, 5):
            monkeypatch.setattr(repair, "STRETCH", size)
            assert repair.solve(x) == whole
            monkeypatch.undo()


def test_estimate_never_exceeds_the_cost():
    rng = random.Random(3)
    for _ in range(200):
        x = _letters(9, rng)
        for start in repair.STATES:
            for goal in repair.STATES:
                found = repair.search(x, start, (goal,))
                assert found is None or repair._estimates(x, start, (goal,))[0] <= found[0]


def _plain(rows):
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        convs[c] += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, letters, roles, count = set(), "", "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, r, x in turns:
            i = r[:1] if r[:1] in ("s", "u", "a") else "x"
            roles += i
            fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", x) else "duplicate" if (r, x) in seen else None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", x) else "truncated"
            seen.add((r, x))
            if fault:
                count[fault] += 1
            letters += {None: i, "truncated": i.upper()}.get(fault, "-")
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
        cost, audit = _cheapest(letters)
        last, at, lines = "", 0, []
        for e in audit:
            new = "assistant" if last == "u" else "user"
            if e == "I":
                lines.append(f"{new}:")
            elif e != "D":
                lines.append(f"{turns[at][1] if e == 'K' else new}:{turns[at][2]}")
            last = lines[-1][0] if e != "D" else last
            at += e != "I"
        out[c] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df, chunk):
    summary, turns = repaired(damaged(df), chunk)
    digests = {r.conv_id: r.repaired_sha256 for r in repaired_digest(turns).collect()}
    return {r.conv_id: (*list(r)[1:], digests[r.conv_id]) for r in summary.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, sf).collect()}
    assert got == _plain(rows)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_odd_rows(spark, chunk):
    rng = random.Random(4)
    texts = ["a. ", "b", "", None, " \n\t", "c?", "Ünd!", "x.y", "long words " * 3000 + "."]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(7)]), rng.choice(["user", "assistant", "system", None, "", "tool", "admin"]), rng.choice(texts)) for _ in range(45)]
    rows += [(9, 3, "user", "hi."), (9, 3, "user", "hi."), (9, 3, "assistant", "hi.")]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA + ", idx int, edit string").repartition(5)
    # A conversation that lost all its rows has no repair.
    assert _got(df, chunk) == {c: v for c, v in _plain(rows).items() if v[6]}


def test_long_conversation_over_many_chunks(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{rng.randint(0, 400)}" + rng.choice([".", ".", ""])) for k in range(700)] + [(2, 1, "user", "hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert _got(df, 16) == _got(df, 4096)


def test_empty_table(spark):
    summary, turns = repaired(damaged(spark.createDataFrame([], SCHEMA)))
    assert summary.count() == 0 and turns.count() == 0
