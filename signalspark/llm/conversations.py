"""Repair of conversations: the cheapest edits that make the roles alternate.

Rows may be kept, given another role, deleted, and empty ones inserted, so that the
roles read ``(s?(ua)+)?`` by their initials. Blank and repeated rows have to go, cut-off
ones cost more to keep. An item (rows used, role reached) is derived from a shorter one
and the fate of one row; the lightest derivation (``lightest``) gives cost and audit,
the ASCII-least string of edits among the cheapest.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length
is many tasks. One that lies within a range is repaired where it lies. Of others every
block of ``BLOCK`` rows gives the lightest edits from each role to each role; these
tables, a few bytes per row, are combined per conversation in pairs. Only the hash
over the repaired text is taken by one task per conversation, in a stream.

Rows of a conversation go by turn (nulls first), then role, then digest of the text.
Null roles and texts are read as one space. Null conversation ids are one conversation.
An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.lightest import Value, lightest
from signalspark.operators.joins import lookup_join
from signalspark.storage import materialize

#: Rows of a block, the unit in which long conversations are repaired.
BLOCK = 512
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 3), ("D", 4), ("I", 3)
TRUNCATED_COST = 3
#: Roles by initial, and the initials that may follow one; "" is the beginning.
ROLES = {"u": "user", "a": "assistant"}
NEXT = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
ENDS = ("", "a")
SPACE = " \t\n\x0b\x0c\r"
#: Faults by the order in which they count.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
RESULT = f"ckey string, {COUNTS}, cost bigint, audit string, repaired_sha256 string"
PIECE = (f"{RESULT}, piece int, block int, edges array<string>, roles array<string>, texts array<string>, "
         "table array<struct<start:string,end:string,cost:bigint,audit:string>>")
#: Adjacent initials that are legal.
LEGAL = frozenset(("su", "ua", "au"))
Row = tuple[str, str | None]  # initial, fault


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) with planted faults, by the checksum of ``conv_id:turn``.

    Of 20 rows one is dropped, one loses its text, one its sentence ends, one is repeated
    and one becomes the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (conversations.filter(kind != 0)
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")))


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: faults, cost and audit of its repair, hash of the repaired text.

    ``rows`` (conv_id, turn, role, text) are repaired if given, else the conversations
    themselves; a conversation without rows is repaired at no cost.
    """
    source = conversations if rows is None else rows
    plain = materialize(source.select(
        _key(F.col("conv_id")).alias("ckey"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("uid"))
        .withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    same = ["ckey", "role", "digest"]
    groups = plain.groupBy(*same).agg(F.min(F.struct("turn", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(groups.filter("n > 1").select(*same, F.col("first.uid").alias("first_uid")), "first_turns")
    marked = lookup_join(plain, firsts, same, "left", salt_by=["uid"])
    marked = marked.withColumn("seen", F.coalesce(F.col("first_uid") != F.col("uid"), F.lit(False)))
    order = ["ckey", "turn", "role", "digest", "uid"]
    dealt = (marked.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
             .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]))
    pieces = materialize(dealt.select("ckey", "turn", "role", "text", "seen").mapInArrow(_pieces(block), PIECE), "pieces")
    names = [f.split()[0] for f in RESULT.split(", ")]
    cut = pieces.filter("piece >= 0")
    long_ones = materialize(cut.drop("roles", "texts").repartition("ckey").sortWithinPartitions("ckey", "piece", "block")
                            .mapInArrow(_combined, RESULT), "long_conversations")
    # the audit goes ahead of its conversation's rows
    empty = {c: F.lit(None).cast(cut.schema[c].dataType) for c in cut.columns if c not in names}
    ahead = long_ones.withColumns({**empty, "piece": F.lit(-1), "block": F.lit(-1)}).select(cut.columns)
    hashed = (ahead.unionByName(cut).drop("table").repartition("ckey").sortWithinPartitions("ckey", "piece", "block")
              .mapInArrow(_hashed, RESULT))
    done = pieces.filter("piece < 0").select(names).unionByName(hashed)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    every = conversations.groupBy("conv_id").agg(F.lit(None).alias("_")).select("conv_id", _key(F.col("conv_id")).alias("ckey"))
    return every.join(done, "ckey", "left").select(
        "conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def fault_of(text: str, seen: bool) -> str | None:
    """First fault of a row."""
    words = text.strip(SPACE)
    if not words:
        return BLANK
    if seen:
        return DUPLICATE
    return None if words[-1] in ".!?" else TRUNCATED


def _steps(row: Row, state: str) -> Iterator[tuple[str, str, int]]:
    """(role reached, edit, cost) of what may become of a row after role ``state``."""
    initial, fault = row
    yield state, *DELETE
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    for reached in NEXT[state]:
        if initial == reached:
            yield reached, KEEP[0], KEEP[1] + more
        elif reached in ROLES:
            yield reached, REROLE[0], REROLE[1] + more


def _deductions(rows: list[Row], goal: bool):
    """Deductions over items (rows used, role reached); the goal is one more row that only an end has."""
    def using(item: tuple[int, str], final: dict) -> Iterator[tuple[tuple[int, str], Value]]:
        used, state = item
        cost, audit = final[item]
        if used > len(rows):
            return
        for reached in NEXT[state]:
            if reached in ROLES:
                yield (used, reached), (cost + INSERT[1], audit + INSERT[0])
        if used < len(rows):
            for reached, letter, weight in _steps(rows[used], state):
                yield (used + 1, reached), (cost + weight, audit + letter)
        elif goal and state in ENDS:
            yield (used + 1, ""), (cost, audit)
    return using


def repair(rows: list[Row]) -> Value:
    """Cost and audit of the repair of a whole conversation."""
    goal = (len(rows) + 1, "")
    return lightest({(0, ""): (0, "")}, _deductions(rows, True), [goal])[goal]


def repair_table(rows: list[Row]) -> dict[tuple[str, str], Value]:
    """Lightest edits of a part of a conversation, from each role to each role."""
    found = {}
    for start in NEXT:
        ends = [(len(rows), end) for end in NEXT]
        final = lightest({(0, start): (0, "")}, _deductions(rows, False), ends)
        found |= {(start, end): final[len(rows), end] for _, end in ends if (len(rows), end) in final}
    return found


def joined_tables(tables: list[dict[tuple[str, str], Value]]) -> dict[tuple[str, str], Value]:
    """Table of consecutive parts, combined in pairs so that no audit is copied often."""
    while len(tables) > 1:
        paired = []
        for k in range(0, len(tables) - 1, 2):
            joint: dict[tuple[str, str], Value] = {}
            for (start, middle), (cost, audit) in tables[k].items():
                for (begin, end), (more, rest) in tables[k + 1].items():
                    if begin == middle and ((start, end) not in joint or cost + more <= joint[start, end][0]):
                        value = (cost + more, audit + rest)
                        joint[start, end] = min(value, joint.get((start, end), value))
            paired.append(joint)
        tables = paired + tables[len(tables) // 2 * 2:]
    return tables[0]


class Rewriter:
    """Hash of the repaired rows of one conversation, fed in order with rows and their edits."""

    def __init__(self, audit: str):
        self.edits, self.state, self.first, self.sha = iter(audit), "", True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.state, self.first = role[:1], False

    def _other(self) -> str:
        return ROLES["a" if self.state == "u" else "u"]

    def feed(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == INSERT[0]:
                self._write(self._other(), "")
                continue
            if edit != DELETE[0]:
                self._write(role if edit == KEEP[0] else self._other(), text)
            return

    def digest(self) -> str:
        for _ in self.edits:
            self._write(self._other(), "")
        return self.sha.hexdigest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _pieces(block_rows: int):
    """Arrow mapper: whole conversations repaired (piece -1); blocks of others with their tables and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(PIECE)
        piece = TaskContext.get().partitionId()
        held: list[tuple] = []
        block, first_run = 0, True
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("ckey", "turn", "role", "text", "seen"))):
                other = held and held[0][0] != row[0]
                if other or len(held) == block_rows:
                    out.append(_piece(held, piece, block, whole=bool(other) and block == 0 and not first_run))
                    block = 0 if other else block + 1
                    first_run = first_run and not other
                    held.clear()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            # the next range may go on with this conversation
            yield pa.RecordBatch.from_pylist([_piece(held, piece, block, whole=False)], schema=schema)

    return run


def _piece(held: list[tuple], piece: int, block: int, whole: bool) -> dict:
    """Row of a whole conversation or of one block of it."""
    ckeys, turns, roles, texts, seen = (list(c) for c in zip(*held))
    rows = [(role[:1], fault_of(text, s)) for role, text, s in zip(roles, texts, seen)]
    faults = [fault for _, fault in rows]
    known = {t for t in turns if t is not None}
    done = {"ckey": ckeys[0], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED), "illegal": _illegal([i for i, _ in rows]), "turns": len(known),
            "low": min(known, default=None), "high": max(known, default=None)}
    if whole:
        cost, audit = repair(rows)
        writer = Rewriter(audit)
        for role, text in zip(roles, texts):
            writer.feed(role, text)
        return done | {"piece": -1, "block": -1, "cost": cost, "audit": audit, "repaired_sha256": writer.digest()}
    table = [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in repair_table(rows).items()]
    return done | {"piece": piece, "block": block, "edges": [roles[0][:1], roles[-1][:1]], "roles": roles, "texts": texts,
                   "table": table}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """Rows by conversation from a sorted stream, a row at a time."""
    rows = (row for batch in batches for k in range(len(batch)) for row in batch.slice(k, 1).to_pylist())
    return itertools.groupby(rows, key=lambda r: r["ckey"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of conversations from their blocks, without the hash."""
    for _, blocks in _runs(batches):
        total: dict = {}
        tables = []
        for b in blocks:
            tables.append({(t["start"], t["end"]): (t["cost"], t["audit"]) for t in b["table"]})
            if not total:
                total = b
                continue
            total["illegal"] += b["illegal"] + _illegal([total["edges"][1], b["edges"][0]])
            total["turns"] += b["turns"] - (b["turns"] > 0 and total["high"] == b["low"])
            for name in (BLANK, DUPLICATE, TRUNCATED):
                total[name] += b[name]
            total["low"] = b["low"] if total["low"] is None else total["low"]
            total["high"] = total["high"] if b["high"] is None else b["high"]
            total["edges"] = [total["edges"][0], b["edges"][1]]
        table = joined_tables(tables)
        cost, audit = min(table["", end] for end in ENDS if ("", end) in table)
        schema = _arrow(RESULT)
        yield pa.RecordBatch.from_pylist([{**{n: total.get(n) for n in schema.names}, "cost": cost, "audit": audit,
                                           "repaired_sha256": None}], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The combined rows with the hash over the repaired rows of all blocks."""
    schema = _arrow(RESULT)
    for _, rows in _runs(batches):
        head = next(rows)
        writer = Rewriter(head["audit"])
        for block in rows:
            for role, text in zip(block["roles"], block["texts"]):
                writer.feed(role, text)
        yield pa.RecordBatch.from_pylist([{**{n: head[n] for n in schema.names}, "repaired_sha256": writer.digest()}], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    """Arrow schema of the tables above."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()),
             "array<struct<start:string,end:string,cost:bigint,audit:string>>": pa.list_(pa.struct(
                 [("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])
