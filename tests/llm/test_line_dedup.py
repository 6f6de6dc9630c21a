"""Line dedup against a plain version, with small filters and with the filter in a shuffled join."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import line_dedup as ld

from .test_operators import docs_of

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UPPER)
    holders = collections.defaultdict(set)
    ident = lambda i: float("inf") if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(ident(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == ident(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"Common line number {k} of all the documents" for k in range(12)] + ["é" * 20, "é" * 19, "x" * 20, "short"]
    rows = []
    for i in range(n):
        own = [f"only in document {i} at {j} some words" for j in range(rng.randint(0, 4))]
        lines = own + [rng.choice([str, str.upper, lambda x: f" \t{x}\r"])(rng.choice(common)) for _ in range(rng.randint(0, 3))] + ([common[0]] * 2 if i % 3 == 0 else [])
        rng.shuffle(lines)
        rows.append((i * 5, "\n".join(lines)))
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "one line"), (2004, " " + common[1]), (2005, "y" * 20_000 + "\n" + common[2])]
    rows += [rows[3], rows[3], (5, "a second row of document five\n" + common[4])]
    return rows


@pytest.mark.parametrize("mode", ["plain", "slices", "shuffled", "runs"])
def test_line_dedup_matches_brute_force(spark, monkeypatch, mode):
    if mode != "plain":
        monkeypatch.setattr(ld, "LINES", 8)
    if mode == "shuffled":
        monkeypatch.setattr(ld, "BROADCAST_SLICES", 0)
    rows = corpus(3, 150)
    docs = docs_of(spark, rows).repartition(6 if mode == "runs" else 1)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_dedup(docs).collect())
    want = brute(rows)
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    assert sum(d for _, _, d, _ in want) > 50


def test_texts_are_rewritten_and_other_columns_stay(spark):
    rows = corpus(5, 40)
    docs = docs_of(spark, rows).withColumn("drop", F.lit("d")).withColumn("doc", F.lit(3)).withColumn("kept", F.lit("k"))
    out = ld.without_common_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text or "", r.drop, r.doc, r.kept) for r in out.collect())
    assert got == sorted((i, t, "d", 3, "k") for i, _, _, t in brute(rows))
    assert out.where("doc_id = 2000").first().text is None


def test_null_ids_and_empty_tables(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, line + "\nx"), (1, line), (2, line), (3, "z")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in ld.line_dedup(docs_of(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 0)]  # rows without an id are one document, the largest
    assert ld.line_dedup(docs_of(spark, rows).where("false")).collect() == []
