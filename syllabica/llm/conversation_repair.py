"""Repair of conversations by the cheapest edits, as integers on a directed acyclic graph.

A node is a place between two rows together with what the roles so far allow; an
edge is one edit. The weight of a path is one big integer: its high digits are the
cost, below them a fixed number of places holds the edit letters from left to
right, with zeros after the last. Smaller integers are cheaper paths and, at one cost,
letters that come first in ASCII, so plain ``min`` decides everything. Paths grow from
the last row to the first: a letter put in front keeps the order of what follows.

A conversation is any number of blocks of consecutive rows. Each block becomes a
small matrix of integers, the cheapest way through it between any two states, and the matrices are
joined from the last to the first. Texts take part only as hashes until the
chosen edits meet them in one pass per conversation, which its SHA-256 needs in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import slices, staged

# What a user of the repair pays for each edit, and the digits of its letter.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
LETTERS = "\0DIKR"
_BITS = 3
#: After nothing, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_ENDS = (START, ASSISTANT)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLES = {"u": "user", "a": "assistant"}
#: The role that a state lets an inserted or relabelled row have, and the state after it.
_MADE = {state: next((role, _NEXT[state, role]) for role in "ua" if (state, role) in _NEXT) for state in STATES}
_RUN = "array<struct<turn:long,role:string,key:binary,n:int>>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
          _RUN: pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()), ("n", pa.int32())]))}


class Weights:
    """Integers of ``places`` letters below a cost."""

    def __init__(self, places: int) -> None:
        self.shift, self.top = _BITS * places, _BITS * (places - 1)
        self.mask = (1 << self.shift) - 1

    def before(self, letter: str, cost: int, rest: int) -> int:
        """The path ``rest`` with one more edit in front of it."""
        low = rest & self.mask
        return (rest ^ low) + (cost << self.shift) + (LETTERS.index(letter) << self.top) + (low >> _BITS)

    def read(self, weight: int) -> tuple[int, str]:
        """Cost and letters of a path."""
        digits = f"{weight & self.mask:0{self.shift // _BITS}o}".rstrip("0")
        return weight >> self.shift, "".join(LETTERS[int(d)] for d in digits)

    def write(self, cost: int, letters: str) -> int:
        low = int("".join(str(LETTERS.index(c)) for c in letters) or "0", 8)
        return (cost << self.shift) + (low << (self.shift - _BITS * len(letters)))


def _inserted(weights: Weights, after: list[int | None]) -> list[int | None]:
    """Weights before a place where up to two rows may be inserted."""
    best = list(after)
    for _ in range(2):
        tried = [best[_MADE[state][1]] for state in STATES]
        best = [min((w for w in (own, None if rest is None else weights.before("I", COSTS["I"], rest)) if w is not None), default=None)
                for own, rest in zip(after, tried, strict=True)]
    return best


def _step(weights: Weights, code: str, after: list[int | None]) -> list[int | None]:
    """Weights before a row. A code is the role's initial, in capitals if truncated, or ``x`` for a row that must go."""
    extra = TRUNCATED_COST if code.isupper() else 0
    found = []
    for state in STATES:
        ways = []
        if code != "x":
            kept = _NEXT.get((state, code.lower()))
            if kept is not None and after[kept] is not None:
                ways.append(weights.before("K", COSTS["K"] + extra, after[kept]))
            made = after[_MADE[state][1]]
            if made is not None:
                ways.append(weights.before("R", COSTS["R"] + extra, made))
        if after[state] is not None:
            ways.append(weights.before("D", COSTS["D"], after[state]))
        found.append(min(ways, default=None))
    return found


@functools.lru_cache(maxsize=20_000)
def _short_matrix(codes: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    return _matrix(codes)


def _matrix(codes: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    weights = Weights(3 * len(codes) + 3)
    columns = []
    for end in STATES:
        # rows are inserted before each row of the block; those after its last row belong to the next block
        best: list[int | None] = [0 if state == end else None for state in STATES]
        for code in reversed(codes):
            best = _inserted(weights, _step(weights, code, best))
        columns.append([None if w is None else weights.read(w) for w in best])
    return tuple(zip(*columns, strict=True))


def matrix(codes: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """Cost and letters of the cheapest edits of a block, from each state to each, or None."""
    return _short_matrix(codes) if len(codes) <= 64 else _matrix(codes)


def joined(blocks: list[str]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest edits of consecutive blocks; the state before each block, and its letters.

    A block after the last stands for the rows inserted at the end.
    """
    ways = [matrix(codes) for codes in blocks]
    places = sum(3 * len(codes) + 3 for codes in blocks) + 3
    weights = Weights(places)
    best = _inserted(weights, [0 if state in _ENDS else None for state in STATES])
    tail = [None if w is None else weights.read(w)[1] for w in best]
    chosen = []
    for way in reversed(ways):
        step = []
        for state in STATES:
            found = [(_through(weights, way[state][end], best[end]), end) for end in STATES
                     if way[state][end] is not None and best[end] is not None]
            step.append(min(found, default=(None, None)))
        chosen.append([end for _, end in step])
        best = [w for w, _ in step]
    state, path = START, []
    for way, ends in zip(ways, reversed(chosen), strict=True):
        path.append((state, way[state][ends[state]][1]))
        state = ends[state]
    return best[START] >> weights.shift, [*path, (state, tail[state])]


def _through(weights: Weights, way: tuple[int, str], rest: int) -> int:
    """The path ``rest`` with the letters of a block in front of it."""
    low = rest & weights.mask
    return (rest ^ low) + weights.write(*way) + (low >> _BITS * len(way[1]))


def edited(state: int, letters: str, roles: list[str]) -> list[tuple[str, list[str], str | None]]:
    """For each row its letters, the roles inserted before it, and the role it has in the end; last what follows the rows."""
    out, inserted, before = [], [], ""
    row = iter(roles)
    for letter in letters:
        if letter == "I":
            made, state = _MADE[state]
            inserted.append(_ROLES[made])
            before += "I"
            continue
        role = next(row)
        if letter == "R":
            made, state = _MADE[state]
            role = _ROLES[made]
        elif letter == "K":
            state = _NEXT[state, role[0]]
        else:
            role = None
        out.append((before + letter, inserted, role))
        inserted, before = [], ""
    return [*out, (before, inserted, None)]


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn; ``n`` rows alike at one place.

    Nulls become one space, also in the checksum's ``conv_id:turn``. One row in twenty
    each is dropped, emptied, robbed of its sentence ends, repeated, or given to the user.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.sha2("text", 256)))


def _fault(text: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def coded(rows: DataFrame) -> DataFrame:
    """One line per place and distinct row: its hash, number of copies and fault, and whether an earlier turn has it too.

    Rows of one turn are in order of role and then of the SHA-256 of their text. Copies are counted before they are shuffled.
    """
    same = ["conv_id", "turn", "role", "key"]
    found = _keyed(rows).withColumn("fault", _fault(F.col("text"))).groupBy(*same, "fault").agg(F.sum("n").cast("int").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = (found.groupBy("conv_id", "role", "key").agg(F.min(turn).alias("first"), F.count("*").alias("places"))
             .where("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first"))
    seen = found.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    return seen.select(*same, "n", "fault", (F.col("first").isNotNull() & (turn != F.col("first"))).alias("seen"))


def _code(role: str, fault: str, seen: bool) -> str:
    if fault == "blank" or seen:
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "truncated" else initial


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class _Open:
    """A block that is being filled, and what its rows amount to."""

    def __init__(self, conv_id: int | None, seq: int) -> None:
        self.conv_id, self.seq, self.codes, self.rows = conv_id, seq, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def line(self, part: int) -> tuple:
        first, last = self.rows[0], self.rows[-1]
        return (self.conv_id, part, self.seq, "".join(self.codes), self.rows, first["turn"], last["turn"], first["role"], last["role"],
                *(getattr(self, name) for name in FIGURES))


FIGURES = ("blank", "duplicate", "truncated", "illegal", "turns")
_FIGURES = ", ".join(f"{name} long" for name in FIGURES)
_BLOCKS = f"conv_id long, part int, seq int, codes string, rows {_RUN}, first_turn long, last_turn long, first_role string, last_role string, {_FIGURES}"


def blocks(codes: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` consecutive rows of a conversation, numbered by task and within it."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, full = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "key", "n", "fault", "seen")]
            for conv_id, turn, role, key, n, fault, seen in zip(*columns, strict=True):
                for copy in range(n):
                    if current is None or current.conv_id != conv_id or len(current.codes) >= most:
                        if current:
                            full.append(current)
                        current = _Open(conv_id, current.seq + 1 if current else 0)
                    _add(current, turn, role, key, fault, seen or copy > 0, copy == 0)
                    if len(full) >= 1000:
                        yield _batch([block.line(part) for block in full], _BLOCKS)
                        full = []
        if current:
            yield _batch([block.line(part) for block in [*full, current]], _BLOCKS)

    ordered = codes.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, _BLOCKS)


def _add(block: _Open, turn: int | None, role: str, key: bytes, fault: str, seen: bool, fresh: bool) -> None:
    block.blank += fault == "blank"
    block.duplicate += fault != "blank" and bool(seen)
    block.truncated += fault == "truncated" and not seen
    if block.rows:
        last = block.rows[-1]
        block.illegal += not legal(last["role"], role)
        block.turns += turn is not None and turn != last["turn"]
    else:
        block.turns += turn is not None
    block.codes.append(_code(role, fault, seen))
    if fresh or not block.rows:
        block.rows.append({"turn": turn, "role": role, "key": bytes(key), "n": 0})
    block.rows[-1]["n"] += 1


def legal(one: str, other: str) -> bool:
    return one[:1] + other[:1] in ("su", "ua", "au")


_CHOICE = f"conv_id long, part int, seq int, state int, letters string, cost long, gaps long, {_FIGURES.replace(', turns long', '')}"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    """Consecutive rows of one conversation, with the small columns alone."""
    conv_id, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != conv_id:
                yield conv_id, held
                held = []
            conv_id = row["conv_id"]
            held.append(row)
    if held:
        yield conv_id, held


def chosen(found: DataFrame) -> DataFrame:
    """State and letters of every block, and one more line per conversation for its end and its figures.

    A task holds the codes of one conversation at a time, a letter per row, as its audit does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, rows in _grouped(batches):
            cost, path = joined([row["codes"] for row in rows])
            total = {name: sum(row[name] for row in rows) for name in FIGURES}
            for one, other in zip(rows, rows[1:], strict=False):
                total["illegal"] += not legal(one["last_role"], other["first_role"])
                total["turns"] -= one["last_turn"] is not None and one["last_turn"] == other["first_turn"]
            turns = [row[c] for row in rows for c in ("first_turn", "last_turn") if row[c] is not None]
            # nulls come first: a block's first known turn may stand behind them
            least = next((row["least_turn"] for row in rows if row["least_turn"] is not None), None)
            gaps = max(turns) - least + 1 - total["turns"] if least is not None else 0
            out += [(conv_id, row["part"], row["seq"], state, letters, None, None, None, None, None, None)
                    for row, (state, letters) in zip(rows, path, strict=False)]
            out.append((conv_id, None, None, path[-1][0], path[-1][1], cost, gaps, *(total[name] for name in FIGURES[:-1])))
            if len(out) >= 10_000:
                yield _batch(out, _CHOICE)
                out = []
        if out:
            yield _batch(out, _CHOICE)

    small = found.withColumn("least_turn", F.array_min("rows.turn")).drop("rows")
    small = small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return small.mapInArrow(run, _CHOICE)


_EDIT = "conv_id long, part int, seq int, i int, turn long, role string, key binary, letters string, lines array<string>, final string"


def decisions(found: DataFrame, choice: DataFrame) -> DataFrame:
    """The edits of every distinct row: letters of all its copies, lines inserted before it, and its role if it stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                edits = iter(edited(row["state"], row["letters"], [r["role"] for r in row["rows"] for _ in range(r["n"])]))
                for i, r in enumerate(row["rows"]):
                    letters, lines, final = "", [], None
                    for own, inserted, role in (next(edits) for _ in range(r["n"])):
                        # a kept row is the first of its copies: what is inserted after it comes with a later row
                        letters, final = letters + own, final or role
                        lines += [f"{name}:" for name in inserted]
                    out.append((row["conv_id"], row["part"], row["seq"], i, r["turn"], r["role"], r["key"], letters, lines, final))
            if out:
                yield _batch(out, _EDIT)

    of = choice.where("part IS NOT NULL").select(F.col("part").alias("p"), F.col("seq").alias("s"), "state", "letters")
    rows = found.select("conv_id", "part", "seq", "rows")
    return rows.join(of, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s").mapInArrow(run, _EDIT)


_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


class _Repaired:
    """One conversation while its rows pass by."""

    def __init__(self) -> None:
        self.hash, self.lines, self.audit, self.figures, self.waiting = hashlib.sha256(), 0, [], None, None

    def add(self, line: str) -> None:
        self.hash.update(b"\n" * bool(self.lines) + line.encode())
        self.lines += 1

    def take(self, row: dict) -> None:
        if row["kind"] == 2:
            place = (row["turn"], row["role"], row["key"])
            if self.waiting and self.waiting[0] == place:
                self.add(f"{self.waiting[1]}:{row['text']}")
                self.waiting = None
        elif row["kind"]:
            self.audit.append(row["letters"])
            for line in row["lines"] or []:
                self.add(line)
            if row["final"] is not None:
                self.waiting = (row["turn"], row["role"], row["key"]), row["final"]
            if row["last"]:
                self.figures = tuple(row[name] for name in ("gaps", *FIGURES[:-1], "cost"))

    def line(self, conv_id: int | None) -> tuple:
        return conv_id, *(self.figures or (0,) * 6), "".join(self.audit), self.hash.hexdigest()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, conv_id, current = [], None, None
    for batch in batches:
        for part in slices(batch):
            for row in part.to_pylist():
                if current is None or row["conv_id"] != conv_id:
                    if current:
                        out.append(current.line(conv_id))
                    conv_id, current = row["conv_id"], _Repaired()
                current.take(row)
            if len(out) >= 1000:
                yield _batch(out, _RESULT)
                out = []
    if current:
        yield _batch([*out, current.line(conv_id)], _RESULT)


def _ends(choice: DataFrame) -> DataFrame:
    """The line of each conversation's end, with the rows inserted there."""
    names = F.when(F.col("state") == USER, F.array(F.lit("assistant:"), F.lit("user:"))).otherwise(F.array(F.lit("user:"), F.lit("assistant:")))
    ends = choice.where("part IS NULL")
    return ends.select("conv_id", F.lit(True).alias("last"), F.lit(1).alias("kind"), "letters",
                       F.slice(names, 1, F.length("letters")).alias("lines"), "cost", "gaps", *FIGURES[:-1])


def repair(conversations: DataFrame, damage: bool = True, rows_per_block: int = 512, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One line per conversation: its faults, the cheapest edits that repair it, and a hash of what they give.

    ``damage`` first puts faults in (see ``damaged``); without it, rows are taken as they are, nulls as
    one space. Rows stand by turn, nulls first; those of one turn by role and by the SHA-256 of their text, so
    equal rows stand together. ``gaps`` counts turns missing between the first and the last
    known one. A row is blank without a character other than white space, else a duplicate if its role and text
    stood earlier, else truncated without ``.!?`` at its end. ``illegal`` counts neighbours whose roles can't follow each other.
    ``audit`` has a letter per edit: Keep, Rerole to the role that may stand there, Delete, Insert an empty row.
    Rows whose role begins with none of s, u and a, an empty role too, are never kept. A null id is a conversation
    of its own; conversations whose rows were all dropped have zeros, no audit and the hash of nothing. An empty table gives
    none; other columns are ignored.

    Any number of tasks share a conversation until its text is hashed: that is one pass over its rows in order,
    since SHA-256 has no other way, in memory of one row and the audit.
    """
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                 F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    rows = damaged(turns) if damage else turns.withColumn("n", F.lit(1)).fillna(" ", ["role", "text"])
    found = staged(blocks(coded(rows), rows_per_block), "conversation-blocks")
    choice = staged(chosen(found), "conversation-choices")
    edits = decisions(found, choice).select("*", F.lit(1).alias("kind"), F.lit(False).alias("last"))
    texts = _keyed(rows).select("conv_id", "turn", "role", "key", "text", F.lit(2).alias("kind"), F.lit(False).alias("last"))
    everyone = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(False).alias("last"))
    union = functools.partial(DataFrame.unionByName, allowMissingColumns=True)
    passing = functools.reduce(union, [edits, texts, everyone, _ends(choice)]).drop("i")
    passing = passing.repartition("conv_id").sortWithinPartitions("conv_id", "last", "turn", "role", "key", "kind", "part", "seq")
    return passing.mapInArrow(_told, _RESULT)
