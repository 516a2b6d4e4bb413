"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from gleanery.llm import conversations, queries

FOLDER = "/root/testdata/sf0.001"


def text_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def plain(rows):
    """What `repair` returns for the rows (turn, role, text) of one conversation, and the repaired lines."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), text_key(r[1], r[2])))
    seen, faults = set(), []
    for _, r, x in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not ends else "duplicate" if (r, x) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((r, x))

    @lru_cache(None)
    def best(i, done):
        """Cheapest (cost, audit, lines) of rows i onwards behind a repaired initial (or none yet: '')."""
        out = [(0, "", ())] if i == len(rows) and done in ("", "a") else []
        follow = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if i < len(rows):
            _, r, x = rows[i]
            late = 3 if faults[i] == "truncated" else 0
            options = [(4, "D", done, ())]
            if faults[i] not in ("blank", "duplicate"):
                if r[:1] == follow or (r[:1] == "s" and done == ""):
                    options.append((late, "K", r[:1], (f"{r}:{x}",)))
                options.append((3 + late, "R", follow, (f"{name}:{x}",)))
            for cost, letter, to, line in options:
                c, a, lines = best(i + 1, to)
                out.append((cost + c, letter + a, line + lines))
        elif done in ("s", "u"):
            c, a, lines = best(i, follow)
            out.append((3 + c, "I" + a, (f"{name}:", *lines)))
        if i < len(rows):  # one insertion, then a row: two in a row only serve a state that a deletion keeps
            for n in (1, 2):
                state, put = done, ()
                for _ in range(n):
                    state = "a" if state == "u" else "u"
                    put += ({"u": "user:", "a": "assistant:"}[state],)
                _, r, x = rows[i]
                late = 3 if faults[i] == "truncated" else 0
                options = []
                if faults[i] not in ("blank", "duplicate"):
                    nxt = "a" if state == "u" else "u"
                    if r[:1] == nxt:
                        options.append((late, "K", nxt, (f"{r}:{x}",)))
                    options.append((3 + late, "R", nxt, ({"u": "user", "a": "assistant"}[nxt] + f":{x}",)))
                options.append((4, "D", state, ()))
                for cost, letter, to, line in options:
                    c, a, lines = best(i + 1, to)
                    out.append((3 * n + cost + c, "I" * n + letter + a, put + line + lines))
        return min(out)

    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), lines


def harmed(rows):
    """The rows (conv, turn, role, text) of the registered query after its damage."""
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h:
            x = "" if h == 1 else re.sub(r"[.!?]", "", x) if h == 2 else x
            out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def by_conv(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = by_conv(harmed(rows))
    want = sorted((c, *plain(after.get(c, []))[0]) for c in {r[0] for r in rows})
    got = queries.op12_conversation_repair(spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[6] for r in want)


def some(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "us", "Ärger"]
    texts = ["Yes.", "No!", "open", " \t", "", None, "Why? \n", "é…", "x."]
    return [(rng.choice([None, *range(6)]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)) for _ in range(n)]


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(3)
    convs = {c: some(rng, rng.randrange(1, 14)) for c in [None, *range(-20, 150)]}
    # one of all rows' half, and one that goes away whole
    convs[1000] = [(t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(800)]
    convs[1001] = [(5, "user", " ")] * 40
    rows = [(c, *r) for c, own in convs.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("conv", "known", "dig", "kind", "audit", "_conv")})
    sys.setrecursionlimit(10000)
    want = {c: plain(own) for c, own in convs.items()}
    for held, parts in ((conversations.HELD, 3), (conversations.HELD, 40), (20, 7)):
        got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, held=held, parts=parts).collect()}
        assert got == {c: w for c, (w, _) in want.items()}, (held, parts)
    lines = {}
    for r in conversations.repaired(df).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {c: list(x) for c, (_, x) in want.items() if x}
    assert conversations.repair(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0


def test_one_row_of_each_kind(spark):
    """Every row, and every pair of rows, by name: string ids too."""
    kinds = [(r, x) for r in ("user", "assistant", "system", "tool") for x in ("Yes.", "No", "")]
    convs = {f"{i}-{j}": [(0, *a), (1, *b)] for i, a in enumerate(kinds) for j, b in enumerate(kinds)} | {str(i): [(None, *a)] for i, a in enumerate(kinds)}
    df = spark.createDataFrame([(c, *r) for c, own in convs.items() for r in own], "c string, t int, r string, x string")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, "c", "t", "r", "x").collect()}
    assert got == {c: plain(own)[0] for c, own in convs.items()}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_give_one_audit(block):
    rng = random.Random(block)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3]) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(rng.randrange(12)))
        assert conversations.audit(codes, block) == conversations.audit(codes, 5)
