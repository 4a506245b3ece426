"""Conversation repair against a search through all edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from syllabica.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, n int, cost string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def cheapest(rows):
    """Least cost, then least letters, by a search that tries every edit everywhere."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, lines
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        state = (i, audit, roles)
        if state in done or len(audit) > 3 * len(rows) + 3:
            continue
        done.add(state)
        for name in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", i, roles + name[0], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, roles + name[0], (*lines, f"{name}:{text}")))


def expected(rows, damage=True):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine = list(damaged(mine)) if damage else [tuple(" " if v is None and i > 1 else v for i, v in enumerate(r)) for r in mine]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            last = text.rstrip(SPACES)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in mine} - {None}
        n = [sum(f == name for _, _, f in faulty) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = cheapest(faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 5, 9, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in repair.repair(table, **options).select(COLUMNS).collect()), key=str)


def conversations(seed, n, longest=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One. ", "Two!\n", "Three", "Four?", " \t", "", None, "É.", "five ", f"x{turn}."])
            rows.append((conv, None if rng.random() < 0.1 else rng.choice([turn, turn, turn * 2, -1]), role, text))
    return rows


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("per_block", [512, 2])
def test_against_all_edits(spark, damage, per_block):
    rows = conversations(per_block, 60) + [(None, 1, "user", "a."), (None, None, None, None)]
    assert found(spark, rows, damage=damage, rows_per_block=per_block) == expected(rows, damage)


@pytest.mark.parametrize("seed", range(30))
def test_letters_of_blocks(seed):
    rng = random.Random(seed)
    codes = [rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 7))]
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    rows = [("user", "", "blank") if c == "x" else (names[c.lower()], f"t{i}", "truncated" if c.isupper() else "") for i, c in enumerate(codes)]
    cost, audit, _ = cheapest(rows)
    for size in (1, 2, 3, 7):
        blocks = ["".join(codes[i: i + size]) for i in range(0, len(codes), size)]
        got, path = repair.joined(blocks)
        assert (got, "".join(letters for _, letters in path)) == (cost, audit)


def test_long_conversation_in_many_blocks(spark):
    rows = [(1, i // 2, ("user", "assistant")[i % 2], f"{i % 700}.") for i in range(3000)]
    rows += [(1, 5000, "user", "again and again.")] * 1500
    assert found(spark, rows, rows_per_block=64) == found(spark, rows, rows_per_block=10_000)


def test_dropped_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(dropped, 0, "user", "a.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, []) == []
