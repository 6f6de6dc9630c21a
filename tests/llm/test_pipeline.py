"""The pipeline's stages on a small corpus against brute-force versions, and the registered queries' columns."""

import collections
import math

import __spark_entry__
import corpus_pipeline

from .test_operators import contaminated, corpus, docs_of, repeated, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut_texts(rows, length=100):
    """Texts without the bytes that a string of ``length`` bytes covers which also starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = b"\x01" * length
            seen.add(data[a : a + length])
        out[i] = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    return out


def check_schedule(rows):
    """Every slot of every source is within one block of its weight (root of its documents), and blocks and places are gapless."""
    by = collections.defaultdict(list)
    for i, source, block, place, slot in rows:
        by[source].append((slot, block, place, i))
    total = sum(math.sqrt(len(v)) for v in by.values())
    slots = {}
    for source, own in by.items():
        assert sorted(b * 16 + p for _, b, p, _ in own) == list(range(len(own)))
        at = {b: {s for s, k, _, _ in own if k == b} for _, b, _, _ in own}
        assert all(len(v) == 1 for v in at.values())
        share = math.sqrt(len(own)) / total
        for b, (slot,) in ((b, tuple(v)) for b, v in at.items()):
            assert slots.setdefault(slot, source) == source
            assert (b + 1) - 1 < share * (slot + 1) + 1e-6 and share * slot - b < 1 + 1e-6  # less than one block early or late


def test_stages(spark, tmp_path):
    rows = corpus(9, 40)[:-2]
    texts = {i: t for i, t, *_ in rows}
    bench = [(1, " ".join(texts[max(texts, key=lambda i: (len(set((texts[i] or "").split())), -i))].split()[5:20]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(spark, rows).select(*COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns[:5] == COLUMNS
    first = kept["language_id"]
    assert set(first) == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    second = kept["minhash_near_dedup"]
    alike = lambda a, b: bool(shingles(a)) and bool(shingles(b)) and 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b))
    reach = {i: i for i in first}  # smallest document of each component, by repeated passes over all pairs
    links = [(i, j) for i in first for j in first if i < j and alike(first[i], first[j])]
    for _ in range(len(first)):
        for i, j in links:
            reach[i] = reach[j] = min(reach[i], reach[j])
    assert set(second) == set(reach.values()) and set(second) != set(first)
    gone = repeated([(i, t) for i, t in second.items()])
    third = kept["suffix_array_dedup"]
    assert set(third) == {i for i, t in second.items() if gone[i][0] < len(t.encode()) or not t}
    left = cut_texts([(i, t) for i, t in second.items()])
    assert third == {i: left[i] for i in third} and any(left[i] != second[i] for i in third)
    bad = contaminated([(i, t) for i, t in third.items()], bench)
    fourth = kept["benchmark_decontamination"]
    assert set(fourth) == {i for i in third if not bad[i][4]} and set(fourth) != set(third)
    assert kept["source_mixing"] == fourth
    check_schedule([(r.doc_id, r.source, r.mix_block, r.mix_place, r.mix_slot) for r in docs.collect()])


def test_run_over_the_smallest_folder(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"mix_slot", "mix_place", *COLUMNS} <= set(out.columns)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
