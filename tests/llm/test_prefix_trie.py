"""Prefix trie against a trie built turn by turn."""

import collections
import hashlib
import random
import zlib

import pytest

from parcelflow.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, x string, depth string, part string"


def brute(rows, heads=True):
    turns = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        full[c] = own.get(base, [])[:h] + seq[h:]
    members = collections.defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(full[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    said = [f"say {k} " * (k % 4) for k in range(5)] + ["é", None]
    rows = []
    for c in range(n):
        first = rng.choice([0, 0, 0, 1])
        for t in range(rng.randint(1, longest)):
            word = said[(first + t) % 3] if rng.random() < 0.8 else rng.choice(said)
            rows.append((c * rng.choice([1, 1, 7]), t, rng.choice(["user", "user", None]) if t % 2 == 0 else "assistant", word))
    rows += [(100, None, "system", "before all"), (-5, 0, "user", "negative"), (-205, 1, "user", "negative"), (None, 0, "user", "no conversation"), (10**12, 0, "user", "far"), (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, 1, "a", "tie")]
    return rows


def told(spark, rows):
    df = spark.createDataFrame([(*r, "x", "d", "p") for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in pt.prefix_trie(df).collect()], key=str)


@pytest.mark.parametrize("block, ids", [(1024, 1024), (3, 4)])
def test_trie_matches_brute_force(spark, monkeypatch, block, ids):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "IDS", ids)
    rows = conversations(1, 260, 9)
    assert told(spark, rows) == brute(rows)


def test_one_very_long_conversation_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 64)
    rows = [(c, t, "user", f"turn {t}" if t < 700 or c == 100 else f"other {t}") for c in (100, 101) for t in range(800)]
    rows += [(102, 0, "user", "turn 0")]
    assert told(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_tables(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 100)}
    gone = [c for c in h if h[c] >= 2][:5]  # all their turns are replaced by those of an absent conversation
    rows = [(c, t, "user", "a") for c in gone for t in range(2)]
    assert told(spark, rows) == brute(rows) == [(min(gone), 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())]
    assert told(spark, []) == []
