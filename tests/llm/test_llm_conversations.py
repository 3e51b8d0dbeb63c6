"""Operator 13 against a search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import conversations
from tidewell.llm.conversations import Repairer, Row


def all_edits(rows):
    """The cheapest repair, found by trying every sequence of edits."""
    best = [None]

    def go(i, cost, audit, out):
        initials = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch("(s|s?(ua)*u?)", initials) or (best[0] and cost > best[0][0]):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            found = cost, audit, out
            if best[0] is None or found[:2] < best[0][:2]:
                best[0] = found
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")])
        if i == len(rows):
            return
        row = rows[i]
        go(i + 1, cost + 2, audit + "D", out)
        if row.fault not in ("blank", "duplicate"):
            more = 5 * (row.fault == "truncated")
            go(i + 1, cost + more, audit + "K", [*out, (row.role, row.text)])
            for role in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", [*out, (role, row.text)])

    go(0, 0, "", [])
    return best[0]


def repaired(rows):
    out, audit = [], []

    def emit(letter, row, role, n):
        audit.append(letter * n)
        if letter != "D":
            out.append((role, row.text if row else ""))

    repairer = Repairer(emit)
    for row in rows:
        repairer.add(row)
    return repairer.finish(), "".join(audit), out


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]


@pytest.mark.parametrize("seed", range(4))
def test_repairs_equal_the_search_over_all_edits(seed):
    rnd = random.Random(seed)
    for _ in range(100):
        faults = ["", "", "", "blank", "duplicate", "truncated"]
        rows = [Row(rnd.choice(ROLES), f"t{i}", rnd.choice(faults)) for i in range(rnd.randint(0, 5))]
        assert repaired(rows) == all_edits(rows)


@pytest.mark.parametrize("kind", ["whole", "blank", "mixed"])
def test_long_conversations_leave_few_edits_open(kind):
    rnd, counted, most = random.Random(1), [0], 0
    repairer = Repairer(lambda letter, row, role, n: counted.__setitem__(0, counted[0] + n))
    faults = {"whole": [""], "blank": ["blank"], "mixed": ["", "", "blank", "duplicate", "truncated"]}[kind]
    for i in range(20_000):
        repairer.add(Row("user" if i % 2 == 0 else "assistant", "x", rnd.choice(faults)))
        most = max(most, repairer.open_edits)
    repairer.finish()
    assert counted[0] >= 20_000 and most < 300


def plain(table):
    """The contract, row by row."""
    blank = lambda c: " " if c is None else str(c)
    out, by = {}, {}
    for conv_id, turn, role, text in table:
        by.setdefault(conv_id, [])
        draw = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        by[conv_id] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for conv_id, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for turn, role, text in rows:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append(Row(role, text, fault, turn))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(r.fault == f for r in judged) for f in ("blank", "duplicate", "truncated")]
        initials = [r.role[:1] for r in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, fixed = all_edits(judged) if len(judged) <= 3 else repaired(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv_id] = (gaps, *counts, illegal, cost, audit, sha, fixed)
    return out


def awkward():
    rnd, table = random.Random(7), []
    for conv_id in [*range(150), None]:
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "Über"])
            text = rnd.choice(["Yes.", "No!", "  ", "", None, "half a", "What? \n", "日本.\x0b", "end. ", "a.", "x\t.  "])
            at = rnd.choice([turn, turn, turn, turn * 3, None])
            table += [(conv_id, at, role, text)] * rnd.choice([1, 1, 1, 2])
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Dropped."))
    table += [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." + "long " * (20_000 if t == 4 else 1) + ".") for t in range(300)]
    return table


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(awkward(), "conv_id long, turn long, role string, text string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("draw", "copy", "digest", "fault", "at", "edit", "audit", "cost", "same")})


def test_digest_equals_the_contract(table):
    want = plain(awkward())
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digest(conversations.damage(table)).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    assert any(v[5] == 0 and v[6] == "" for v in got.values())  # all of a conversation's rows dropped


def test_repair_gives_the_repaired_rows(table):
    want = plain(awkward())
    rows = conversations.repair(conversations.damage(table)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.at):
        by.setdefault(r.conv_id, []).append(r)
    for conv_id, found in by.items():
        assert [r.at for r in found] == list(range(len(found)))
        assert "".join(r.edit * max(r.n_rows, 1) for r in found) == want[conv_id][6]
        assert [(r.role, r.text) for r in found if r.edit != "D"] == want[conv_id][8]


def test_no_rows_and_undamaged_rows(spark, table):
    assert conversations.digest(conversations.damage(table.where("false"))).collect() == []
    assert conversations.repair(table.where("false")).collect() == []
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert [(r.edit, r.role, r.text) for r in conversations.repair(df).orderBy("at").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Hello.")]


def test_one_shuffle(table):
    plan = conversations.digest(conversations.damage(table))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- Repartition")[0].count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan
