"""The trie of rebuilt conversations against one built from whole paths."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, said, role, text))
    original = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(original.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own + sum(saved[k] for k in children[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()}


def check(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, ROWS)).collect()
    want = plain_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("held", [prefix_trie.HELD, 3])
def test_trie_matches_whole_paths(spark, held, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HELD", held)  # the workers see it only where they run in this process; the builder is tested below
    rng = random.Random(12)
    says = ["a b", "c", "", "hello there  you", "é x", None]
    rows = []
    for c in [*range(0, 130), -1, -7, -20, -39, 1000, 1003, 40_000]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 2, 3, 4, 9, 20])):
            rows.append((c, rng.choice([turn, turn, turn, None]), ["user", "assistant", None][min(turn % 2 + (rng.random() < 0.05), 2)], rng.choice(says[:3] if turn < 3 else says)))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    check(spark, rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"x {t % 5}") for t in range(3000)] + [(100 + 20 * k, t, "user", f"y {t}") for k in range(300) for t in range(2)]
    check(spark, rows)


def test_flushing_keeps_counts():
    """Nodes passed on in parts add up to the same."""
    rows = [(40, 40, b"a", 1), (40, 40, b"b", 2), (40, 41, b"a", 1), (40, 41, b"c", 3), (60, 60, b"a", 1)]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[k] for r in rows]) for k in range(4)], names=["base", "conv_id", "said", "words"])

    def sums():
        n, ends = defaultdict(int), set()
        for out in prefix_trie._families(iter([batch])):
            for r in out.to_pylist():
                if r["depth"] is None:
                    ends.add((r["node"], r["conv_id"]))
                else:
                    n[r["node"], r["depth"], tuple(r["up"])] += r["n"]
        return dict(n), ends

    whole, prefix_trie.HELD, held = sums(), 1, prefix_trie.HELD
    try:
        assert sums() == whole
    finally:
        prefix_trie.HELD = held


def test_empty_nulls_and_other_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], ROWS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, None, None, None)], ROWS)).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, 1, "x")], ROWS + ", node int, base string")
    got = prefix_trie.trie(rows).orderBy("depth").collect()
    h = zlib.crc32(b"1") % 4  # the base conversation is absent, so the first h turns are none
    assert [(r.depth, r.n_convs, r.n_leaves) for r in got] == ([(0, 1, 1), (1, 1, 1)] if not h else [(0, 1, 1)])
