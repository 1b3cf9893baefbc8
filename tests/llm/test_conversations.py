"""Repair of conversations against all edits of short ones and a plain table of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from signalspark.llm import conversations as c
from signalspark.llm.lightest import lightest

KINDS = "conv_id long, turn long, role string, text string, ckey string, uid int, first int"
WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def by_rule(rows):
    """Damage of the contract, row by row: (conv, turn, role, text) in order per conversation."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def faults_of(rows):
    found = []
    for k, (_, role, text) in enumerate(rows):
        if not WORD.search(text):
            found.append("blank")
        elif any((r, t) == (role, text) for _, r, t in rows[:k]):
            found.append("duplicate")
        else:
            found.append(None if WORD.findall(text)[-1] in ".!?" else "truncated")
    return found


def edited(rows, faults, edits):
    """(cost, audit, rows) of (edit, role) pairs, or None if they do not fit the rows."""
    cost, out, left = 0, [], iter(zip(rows, faults))
    for edit, role in edits:
        if edit == "I":
            cost, _ = cost + 3, out.append((role, ""))
            continue
        (_, own, text), fault = next(left)
        cost += {"K": 0, "R": 3, "D": 4}[edit]
        if edit != "D":
            if fault in ("blank", "duplicate"):
                return None
            cost += 3 * (fault == "truncated")
            out.append((own if edit == "K" else role, text))
    if not GOOD.fullmatch("".join(r[:1] for r, _ in out)) or any(not r for r, _ in out):
        return None
    return cost, "".join(e for e, _ in edits), out


def cheapest_of_all(rows, faults):
    """Every choice of fates with up to two insertions at every place."""
    inserts = [()] + [tuple(("I", r) for r in combo) for n in (1, 2) for combo in itertools.product(("user", "assistant"), repeat=n)]
    fates = [("K", None), ("R", "user"), ("R", "assistant"), ("D", None)]
    best = None
    for chosen in itertools.product(fates, repeat=len(rows)):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            edits = [e for k in range(len(rows)) for e in (*put[k], chosen[k])] + list(put[-1])
            found = edited(rows, faults, edits)
            if found and (best is None or found[:2] < best[:2]):
                best = found
    return best


def cheapest_by_table(rows, faults):
    """The same for longer conversations: best edits per place and last role, a row at a time."""
    def more(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in {"": "u", "s": "u", "u": "a", "a": "u"}[state]:
                        found = (cost + 3, audit + "I", [*out, (role, "")])
                        if role[0] not in table or found < table[role[0]]:
                            table[role[0]] = found
        return table
    table = more({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, out) in table.items():
            options = [(state, 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for to in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    if role[:1] == to:
                        options.append((to, extra, "K", [*out, (role, text)]))
                    if to != "s":
                        options.append((to, 3 + extra, "R", [*out, ({"u": "user", "a": "assistant"}[to], text)]))
            for to, w, letter, then in options:
                found = (cost + w, audit + letter, then)
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        table = more(new)
    return min((table[s] for s in ("", "a") if s in table), key=lambda f: f[:2])


def expected(rows, cheapest):
    for conv, mine in by_rule(rows).items():
        faults = faults_of(mine)
        turns = {t for t, _, _ in mine if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, out = cheapest(mine, faults)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS)


def drawn(rng, convs, length):
    texts = ["Yes.", "No", "What?", "", " \n", "é!", "a\nb.", None, "Long " * 5000]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(conv if conv else None, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts))
            for conv in range(convs) for turn in range(rng.randint(1, length))]
    return rows + rows[:3]  # repeated rows: ties within a turn


def test_agenda_stops_at_the_goal():
    looked = []

    def using(item, final):
        looked.append(item)
        cost, audit = final[item]
        if item < 9:
            yield item + 1, (cost + 1, audit + "b")
            yield item + 2, (cost + 2, audit + "a")
    assert lightest({0: (0, "")}, using, [4])[4] == (4, "aa")
    assert max(looked) == 4 and lightest({0: (0, "")}, using, [99]).keys() == set(range(11))


def test_repair_equals_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "Ah.", ""]))
                for k in range(rng.randint(0, 2))]
        rows += [(9, "system", "x.")] * rng.randint(0, 1)
        faults = faults_of(rows)
        got = c.repair([(r[1][:1], f) for r, f in zip(rows, faults)])
        assert got == cheapest_of_all(rows, faults)[:2]
        assert got == cheapest_by_table(rows, faults)[:2]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_conversations(spark, block):
    rows = drawn(random.Random(block), 30, 12) + [(77, k // 2, "user" if k % 3 else "assistant", f"{k % 50}.") for k in range(300)]
    given = table_of(spark, rows).repartition(3)
    got = c.repaired(given, c.damaged(given), block=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows, cheapest_by_table), key=str)


def test_without_damage_and_empty(spark):
    given = table_of(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (None, None, None, None)])
    got = {r.conv_id: r for r in c.repaired(given).collect()}
    assert (got[1].cost, got[1].audit) == (0, "KK") and (got[None].cost, got[None].audit, got[None].gaps) == (4, "D", 0)
    assert got[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    assert c.repaired(table_of(spark, [])).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    alone = table_of(spark, [(5, dropped, "user", "Hi.")])
    assert [tuple(r) for r in c.repaired(alone, c.damaged(alone)).collect()] == [
        (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
