"""The prefix trie against a trie of dictionaries."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from rankloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        if p:
            children[p[:-1]] += 1
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()}


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 9, "own") for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = trie.op12_prefix_trie(spark, str(tmp_path)).collect()
    out = {(r[0], r[1]): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, ties of equal rows, conversations without a base or without turns, negative ids."""
    rows = [(20, None, "user", "hi there"), (20, 1, None, None), (20, 2, "user", "a b c"), (None, 1, "user", "lost"), (23, 7, "user", None), (23, 7, "user", None), (24, 3, "user", "x"), (-3, 1, "user", "m"), (-45, 1, "user", "m n")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} word") for c in range(25, 60) for t in range(c % 6)] + [(61 + i, 0, "user", "y" * 200_000 + " z") for i in range(5)]
    rows += [(100 + i, t, "u", "same text") for i in range(40) for t in range(3)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_least_tables(spark, tmp_path, n):
    rows = [(5, 0, "user", "a")][:n]
    assert run(spark, tmp_path, rows) == (brute(rows) if n else {})


def test_one_conversation_of_very_many_turns(spark, tmp_path):
    """Blocks of places: a conversation that holds most rows, and its copy to the half."""
    rows = [(40, t, "user", f"{t % 7} w") for t in range(3000)] + [(41, t, "user", f"{t % 7} w") for t in range(1500)] + [(43, 0, "user", "0 w")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_very_many_members_that_end_together(spark, tmp_path):
    """End lists of several thousand ids, beyond one partial list."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 200_000, 20) for t in range(2)] + [(7 + 20 * c, 0, "user", "alone") for c in range(50)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and max(v[1] for v in got.values()) > 9_000
