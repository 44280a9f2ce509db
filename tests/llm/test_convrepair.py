"""Conversation repair against a plain-Python search over all cheapest edits."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import convrepair as C
from tidewatch.llm import queries
from tidewatch.operators.ordering import SIZES, Sizes

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 0:
            continue
        x = "" if how == 1 else "".join(ch for ch in x if ch not in ".!?") if how == 2 else x
        out += [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    return out


def least_edits(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault), least first: all ways from the end, a row at a time."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for s, t in step.items():
                if t in best:
                    cost, audit, turns = best[t]
                    way = (cost + 5, "I" + audit, [(names[t], "")] + turns)
                    if s not in best or way[:2] < best[s][:2]:
                        best[s] = way
        return best

    best = inserted({"": (0, "", []), "a": (0, "", [])})
    for role, text, fault in reversed(rows):
        now = {}
        for s in step:
            ways = []
            if s in best:
                cost, audit, turns = best[s]
                ways.append((cost + 2, "D" + audit, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                first = role[:1]
                if (first == "s" and s == "" or first == step[s]) and first in best:
                    cost, audit, turns = best[first]
                    ways.append((cost + more, "K" + audit, [(role, text)] + turns))
                if step[s] in best:
                    cost, audit, turns = best[step[s]]
                    ways.append((cost + 1 + more, "R" + audit, [(names[step[s]], text)] + turns))
            if ways:
                now[s] = min(ways, key=lambda w: w[:2])
        best = inserted(now)
    return best[""]


def brute_report(rows):
    held = collections.defaultdict(list)
    for c, *rest in brute_damage(rows):
        held[c].append(tuple(rest))
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(held[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], collections.Counter()
        for _, role, text in turns:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, fixed = least_edits(judged) if judged else (0, "", [])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def awkward(seed=3, conversations=120):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "unknown", "tool", "", None, "Assistant", "écho"]
    texts = ["Fine.", "Fine.", "Ends here!", "open end", "", "  \t\n", None, "x?\x0c", "Multi\nline. ", "é.", "."]
    rows = []
    for c in [None, *range(conversations)]:
        for k in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((c, rng.choice([k, k, k, k + 1, None, -k]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"turn {k} of {c}."))
    return rows + rows[:5]


@pytest.mark.parametrize(("block_turns", "super_blocks", "sizes"), [(C.BLOCK_TURNS, C.SUPER_BLOCKS, Sizes()), (3, 2, Sizes(slice_rows=300, block_rows=7, group_rows=50))])
def test_repair_is_the_cheapest_and_least(spark, block_turns, super_blocks, sizes):
    rows = awkward() + [(500, k, ("user", "assistant")[k * 7 % 3 % 2], f"long {k % 90}.") for k in range(400)]
    more = [r + (1, "x") for r in rows]
    table = spark.createDataFrame(more, SCHEMA + ", pos long, _key string").repartition(3)
    held = SIZES.set(sizes)
    try:
        got = result(C.repair_report(table, block_turns, super_blocks))
    finally:
        SIZES.reset(held)
    want = brute_report(rows)
    assert got == want
    assert all(any(letter in w[6] for w in want.values()) for letter in "DKR")  # an insert never beats a delete at these costs


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No! Why?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = C.damaged(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_damage(rows), key=str)


def test_nothing_and_extremes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(empty).collect() == []
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b."), (2, None, None, None), (3, 7, "assistant", "w " * 300_000)]
    got = result(C.repair_report(spark.createDataFrame(rows, SCHEMA)))
    want = brute_report(rows)
    assert {c: w[1:] for c, w in got.items()} == {c: w[1:] for c, w in want.items()}
    dropped = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(C.repair_report(spark.createDataFrame([(dropped, 0, "user", "x")], SCHEMA))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ranked_paths_agree_with_a_greedy_walk():
    """Every entry state of blocks with and without an end, against strings built letter by letter."""
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 12, n) for n in (1, 2, 3, 7, 8, 9, 31, 64)]
    ends = np.array([C.LAST if i % 2 else rng.integers(0, 9, 4) for i in range(len(blocks))])
    last = np.arange(len(blocks)) % 2 == 1
    found = C.least_audits(blocks, ends, last, [C.ENTRY.tolist()] * len(blocks))
    for codes, end, final, ways in zip(blocks, ends, last, found):
        best = {s: (int(end[s]), "", s) for s in range(4)}
        if final:
            best = {0: (0, "", 0), 3: (0, "", 3), 2: (5, "I", 3), 1: (10, "II", 3)}
        for code in reversed(codes.tolist()):
            kind, burden = divmod(code, 3)
            now = {}
            for s in range(4):
                ways_on = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
                if burden != 1:
                    extra = 5 if burden == 2 else 0
                    t = int(C.NEXT[s])
                    ways_on.append((best[t][0] + 1 + extra, "R" + best[t][1], best[t][2]))
                    if C.KEEPS[kind][s]:
                        t = int(C.KEPT_AS[kind])
                        ways_on.append((best[t][0] + extra, "K" + best[t][1], best[t][2]))
                now[s] = min(ways_on)
            for _ in range(2):
                for s in range(4):
                    cost, audit, leave = now[int(C.NEXT[s])]
                    now[s] = min(now[s], (cost + 5, "I" + audit, leave))
            best = now
        assert [(a, c) for a, _, c in ways] == [(best[s][1], best[s][0]) for s in range(4)]
        assert [e for _, e, _ in ways] == [best[s][2] for s in range(4)]


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, path)
    assert result(got) == brute_report(rows)
    assert got.where(F.col("cost") > 0).count() > 0
