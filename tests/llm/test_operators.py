"""Each text operator against a brute-force version or the library, with nulls, empty and long texts, ties, repeats,
empty tables and clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import components, decontaminate, language_id, license_scan, linear_svm, lm_scoring, mixing, near_dedup, quality, suffix_dedup, token_counts, topk

UPPER = {i: i + 32 for i in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, label string, score string, g string"


def docs_of(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns that clash with inner names."""
    full = [(*r, *([None] * (4 - len(r))))[:4] for r in rows]
    return spark.createDataFrame([(i, t, lang, src, None, "r", "s", "l", "sc", "g") for i, t, lang, src in full], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "be", "Ti", "on", "é", "st", "ou"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append(t)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
        if i % 5 == 0:
            rows.append(t + "\n" + passage)
        if i % 7 == 0:
            rows.append(t)
    rows += [None, "", " ", "a", "one two three", "x" * 5000, "ab " * 3000, "The the THE the the the", "12 34 !!"]
    rng.shuffle(rows)
    out = [(i * 3, t, "en" if i % 2 else "fr", f"src{i % 3}") for i, t in enumerate(rows)]
    return out + [out[4], out[4]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def shingles(t):
    w = SPACED.findall((t or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("large", [False, True])
def test_near_duplicates_match_brute_force(spark, rows, monkeypatch, large):
    if large:  # most lists and groups are cut into blocks
        monkeypatch.setattr(near_dedup, "POSTING_BLOCK", 3)
        monkeypatch.setattr(near_dedup, "SET_BLOCK", 300)
        monkeypatch.setattr(near_dedup, "CENTRES", 2)
        rng = random.Random(12)
        base = [f"w{i}" for i in range(60)]
        more = []
        for i in range(90):  # a chain of edits, edits of one text, and texts that share a passage only
            step = [*base[: 60 - i % 30], *[f"n{j}" for j in range(i % 30)]] if i < 30 else [w if rng.random() > 0.01 else f"e{rng.random()}" for w in base] if i < 60 else base[:8] + [f"u{i}x{j}" for j in range(rng.randint(2, 60))]
            more.append((5000 + i, " ".join(step)))
        rows = rows + more
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_null_id_and_empty(spark):
    df = docs_of(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, 2, 5, False), (5, 2, 5, True), (None, 0, None, False)}
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_link_rows_of_repeated_ids(spark):
    w = [f"w{i}" for i in range(41)]
    near = w[:40] + ["other"]
    own = [(5, "x y z a b c d e f g"), (5, " ".join(w)), (9, " ".join(near)), (None, " ".join(w)), (None, " ".join(w[:39] + ["p", "q"])), (9, "one"), (None, "one"), (None, "lone row here")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, own)).collect())
    assert got == collections.Counter([(5, 6, 5, True), (5, 37, 5, True), (9, 37, 5, False), (None, 37, 5, False), (None, 37, 5, False), (9, 1, 9, True), (None, 1, 9, False), (None, 1, None, False)])
    left = near_dedup.deduplicated(docs_of(spark, own + [own[1], own[7], (None, ""), (None, "")]))
    assert left.columns == docs_of(spark, own).columns
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([own[0], own[1], own[5], own[7], (None, ""), (None, "")])


def test_words_of_regular_patterns_have_different_hashes(spark):
    thue, size = b"a", []
    for _ in range(12):
        thue += bytes(195 - x for x in thue)  # a polynomial modulo 2^64 cannot tell this from its mirror image
        size.append(len(thue))
    words = [w for n in size for w in (thue[:n], bytes(195 - x for x in thue[:n]))] + [b"a" * n for n in range(1, 60)] + [b"\0" * n for n in range(1, 20)]
    text = b" ".join(words)
    hashes, _ = near_dedup.t.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), near_dedup.t.NON_SPACE)
    assert len(set(hashes.tolist())) == len(set(words))
    long = [thue[:1024].decode(), bytes(195 - x for x in thue[:1024]).decode()]
    got = near_dedup.near_duplicates(docs_of(spark, list(enumerate(long)))).collect()
    assert all(r.kept for r in got)


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long"), "t").collect())
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}}


def repeated(rows, n=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(w)
        out[i] = (sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup_matches_brute_force(spark, rows, monkeypatch, heavy):
    if heavy:  # every repeated gram takes the path of frequent ones
        monkeypatch.setattr(suffix_dedup, "HEAVY_SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", 2)
        monkeypatch.setattr(suffix_dedup, "HEAVY_SHARE", 0.0)
    own = rows[:-2]
    want = repeated(own)
    got = suffix_dedup.suffix_dedup(docs_of(spark, own)).collect()
    assert len(got) == len(own)
    for r in got:
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_suffix_dedup_cuts_whole_characters_and_takes_empty_tables(spark):
    t = "é" * 80 + "z"
    got = {r.doc_id: r.text for r in suffix_dedup.suffix_dedup(docs_of(spark, [(1, t), (2, "y" + t)]), texts=True).collect()}
    assert got[1].startswith("é") and got[2] == "y"
    assert suffix_dedup.suffix_dedup(docs_of(spark, [(1, "a")]).limit(0)).collect() == []
    same = suffix_dedup.suffix_dedup(docs_of(spark, [(1, t * 2), (1, t * 2)])).collect()
    assert len(same) == 2


def repeated_by_row(rows, n):
    """(doc_id, text left) of every row; only rows with a smaller doc_id (null: largest) and earlier starts of the row itself count."""
    key = lambda i: (i is None, i or 0)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        before = {x[p : p + n] for j, u, *_ in rows if key(j) < key(i) for x in [(u or "").encode()] for p in range(len(x) - n + 1)}
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in before:
                gone[p : p + n] = b"\1" * n
            before.add(b[p : p + n])
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return collections.Counter(out)


@pytest.mark.parametrize("length, heavy", [(100, False), (100, True), (20, False), (33, True), (400, False)])
def test_suffix_dedup_with_null_and_repeated_ids(spark, monkeypatch, length, heavy):
    if heavy:
        monkeypatch.setattr(suffix_dedup, "HEAVY_SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", 2)
        monkeypatch.setattr(suffix_dedup, "HEAVY_SHARE", 0.0)
        monkeypatch.setattr(suffix_dedup, "COMBINED", 50)
    rng = random.Random(length)
    shared = ["".join(rng.choice("abcd é") for _ in range(rng.randint(30, 700))) for _ in range(6)]
    own = []
    for i in range(40):
        t = "".join(rng.choice(shared)[rng.randint(0, 20) :] + rng.choice(["", "x", "".join(rng.choice("abcd") for _ in range(50))]) for _ in range(rng.randint(1, 3)))
        at = rng.randrange(len(t))
        own.append((rng.choice([None, 3, 3, 7, *range(8, 30)]), t[:at] + rng.choice("ab é") + t[at + 1 :]))
    own += [(None, "q" * 900), (None, "r" * 50 + "q" * 250), (3, ""), (3, None), own[0], own[0], own[1]]
    got = suffix_dedup.suffix_dedup(docs_of(spark, own), length, texts=True).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == repeated_by_row(own, length)
    whole = suffix_dedup.without_repeats(docs_of(spark, own), length)
    assert whole.columns == docs_of(spark, own).columns
    want = repeated_by_row(own, length)
    assert collections.Counter((r.doc_id, r.text or "") for r in whole.collect() if r.text) == collections.Counter({k: n for k, n in want.items() if k[1]})


def contaminated(rows, items, n=10):
    wins = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add(item)
    out = {}
    for d, t, *_ in rows:
        w, hit, found = ALNUM.findall((t or "").translate(UPPER)), set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in wins}:
                if tuple(w[i : i + k]) in wins and i + k <= len(w):
                    hit.update(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        found.discard(None)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_matches_brute_force(spark, rows, block):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 25]
    items = [(k, " ".join(texts[k].split()[3 : 3 + n])) for k, n in enumerate([14, 10, 9, 3, 22])] + [(8, None), (9, ""), (None, " ".join(texts[7].split()[:12])), (4, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    want = contaminated(rows[:-2], items)
    got = decontaminate.contamination(docs_of(spark, rows[:-2]), bench, block=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert decontaminate.contamination(docs_of(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_keeps_every_row_in_several_blocks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    own = docs_of(spark, [(1, text), (1, text), (1, other), (None, text), (None, other), (2, "few words")])
    bench = spark.createDataFrame([(7, " ".join(text.split()[4:18]))], "item_id long, text string")
    for block in (500_000, 2):
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(own, bench, block=block).collect())
        assert got == collections.Counter([(1, 30, 14), (1, 30, 14), (1, 30, 0), (None, 30, 14), (None, 30, 0), (2, 2, 0)])
        cut = collections.Counter((r.doc_id, " ".join(r.text.split())) for r in decontaminate.remove_contaminated(own, bench, spans=True, block=block).collect())
        kept = decontaminate.remove_contaminated(own, bench, block=block)
        assert kept.columns == own.columns
        assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(1, other), (None, other), (2, "few words")])
        left = " ".join(text.split()[:4] + text.split()[18:])
        assert cut == collections.Counter([(1, left), (1, left), (1, other), (None, left), (None, other), (2, "few words")])


def test_token_counts_match_the_library(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    letters = [chr(c) for c in range(128)] * 2 + list("éα中😀‍ ̀\x85\xa0٣½") + ["'s", "  ", "the", " don't", "<|endoftext|>", "aaaa"]
    own = rows + [(10_000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(3000)] + [(20_000 + n, "a" * n) for n in range(0, 400, 7)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(spark, own)).collect()}
    for i, t, *_ in own:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_prefix_counts_and_truncation(spark):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.counter(path)
    for word in ("internationalization", "aaaaaaaaab", "Zusammenhang"):
        assert own.prefix_counts(word.encode()) == [len(lib.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]
    text = "One two, three don't   stop\n\n  now " * 9
    for r in token_counts.truncate_to_budget(docs_of(spark, [(1, text), (2, None)]), 17).collect():
        assert r.n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids) <= 17 and text.startswith(r.text)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, (rng.normal(size=16) * 0.4 + (i % 4)).tolist()) for i in range(700)]
    vecs += [(700 + i, [0.5] * 16) for i in range(90)] + [(900, None), (901, [float("nan")] * 16), (902, [0.1, None]), (903, [float("inf")]), (None, [1.0] * 16), (920, [1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("node", F.lit("x"))
    ints = {i: np.array([math.floor(64 * float(np.float32(x))) for x in v] + [0] * (16 - len(v)), np.int64) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ints if i % 20 == 0}
    for q, have in got.items():
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:20]
        assert have == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id in (0, 3)")).collect()[0].vec_id == 3


def test_top_k_over_many_nodes_matches_brute_force(spark, monkeypatch):
    """Small blocks: many tree nodes, pairs that are pruned, a second round and nodes dealt in parts."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 12)) * 3
    vecs = [(i, (middles[i % 12] + rng.normal(size=12) * 0.2).tolist()) for i in range(1500)] + [(2000 + i, middles[0].tolist()) for i in range(150)]
    seen = []
    pairs = topk.NodeTree.pairs
    monkeypatch.setattr(topk.NodeTree, "pairs", lambda self, *a: seen.append(len(out := list(pairs(self, *a)))) or out)
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in vecs}
    for q in (i for i in ints if i % 20 == 0):
        assert got[q] == [(i, -s) for s, i in sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:20]]
    nodes = len(vecs) // 40
    assert len(seen) == 2 and seen[1] < nodes * nodes / 2  # most node pairs are pruned


def test_lm_base_score_and_progress(spark):
    rng = random.Random(8)
    vocab = {"a": ["the", "of", "red"] + [f"w{i}" for i in range(30)], "b": ["le", "de", "bleu"] + [f"m{i}" for i in range(30)]}
    own = [(i, " ".join(rng.choice(vocab["ab"[i % 2]]) for _ in range(rng.randint(1, 60)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "zzz ÄÖ unseen"), (1003, "Q" * 3000), (1003, "w1")]
    tok = [(i, SPACED.findall((t or "").translate(UPPER)) + [None]) for i, t in own]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, ws in tok if not held(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    got = lm_scoring.lm_scores(docs_of(spark, own), sample=40).collect()
    assert len(got) == len(own)
    want = collections.Counter((i, len(ws), sum(w in count for w in ws), round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in tok)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.held_out == held(r.doc_id) and r.score < 0 for r in got)
    normal = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in normal) > sum(r.base_score for r in normal)
    assert lm_scoring.lm_scores(docs_of(spark, own).limit(0)).collect() == []


def test_lm_counts_beyond_16_bits_are_summed_in_full(monkeypatch):
    pa = lm_scoring.pa
    counts = np.zeros((2, 2 * lm_scoring.SLICE), np.uint32)
    counts[0, :2], counts[1, 2:4] = (2_000_000, 100_000), (70_000, 3)
    both = list(lm_scoring._slices(counts)) + list(lm_scoring._slices(counts))
    got = next(lm_scoring._votes(iter(both))).column("votes")[0].as_buffer()
    votes = np.frombuffer(got, np.float32).reshape(2, lm_scoring.SLICE)
    assert votes[0, 0] == pytest.approx(math.log(200_000.4 / 4_000_000.4), abs=1e-4)
    assert votes[1, 1] == pytest.approx(math.log(6.4 / 140_000.4), abs=1e-4)

    class Known:
        value = lm_scoring.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, np.zeros(256, np.int64), 1, 1)

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 200_000, "b a"])], names=["text"])
    want = lm_scoring._summed(lm_scoring._gather(Known)(iter([batch])))
    assert max(int(n.max()) for n in want.values()) > 65535
    monkeypatch.setattr(lm_scoring, "HELD_DECISIONS", 10)
    monkeypatch.setattr(lm_scoring, "SEND_DECISIONS", 10)
    sent = lm_scoring._summed(lm_scoring._gather(Known)(iter([batch, batch])))
    assert set(sent) == set(want) and all((sent[i] == 2 * want[i]).all() for i in want)


def test_lm_model_counts_all_training_documents(spark, monkeypatch):
    rng = random.Random(6)
    own = [(i, " ".join(rng.choice(["red", "green", "blue", f"x{i}q"]) for _ in range(30))) for i in range(120)] + [(None, "null id")]
    train = [(i, t) for i, t in own if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    models, tables = [], []

    init, of = lm_scoring.Model.__init__, lm_scoring._tables
    monkeypatch.setattr(lm_scoring.Model, "__init__", lambda self, *args: models.append((self, args[3])) or init(self, *args))
    monkeypatch.setattr(lm_scoring, "_tables", lambda slices: tables.append(of(slices)) or tables[-1])
    lm_scoring.lm_scores(docs_of(spark, own)).collect()
    (model, byte_count), = models
    assert (byte_count == np.bincount(np.frombuffer("".join(t for _, t in train).lower().encode(), np.uint8), minlength=256)).all()
    one, two = (np.zeros((1 << lm_scoring.TABLE_BITS, 2)) for _ in range(2))
    for _, t in train:
        buf = np.frombuffer(t.encode(), np.uint8)
        for _, _, _, bit, a, b in lm_scoring.streams(model, buf, np.array([0, len(buf)]))[0]:
            np.add.at(one, (a, bit), 1)
            np.add.at(two, (b, bit), 1)
    for votes, n in zip(model.votes, (one, two)):
        seen = n.any(axis=1)
        assert ((votes != 0) == seen).all()
        assert np.allclose(votes[seen].view(np.float32), np.log((n[seen, 1] + 0.4) / (n[seen, 0] + 0.4)), atol=1e-4)
    assert len(tables) == 2 and 0 < (tables[0] != 0).sum() < (tables[1] != 0).sum()
    assert (model.weights[:, :, 1:] != 0).any()


def plain_lm_score(model, counts, text, once, again, outside):
    """log10 probability of a text, decision by decision, from dictionaries of counts for each slot."""
    words = [w.encode() for w in SPACED.findall(text.translate(UPPER))] + [None]
    known = {int(h): i for i, h in enumerate(model.head)}
    hashed = lambda w: int(lm_scoring.END) if w is None else int(lm_scoring.t.hash_runs(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    slot = lambda context, node, salt: int(lm_scoring._slots(np.array([context], np.uint32), np.array([node], np.int64), salt)[0])
    streams, spelled = ([], []), []
    topic, last = lm_scoring.FREQUENT, 0
    for w in words:
        h = hashed(w)
        symbol = known.get(h, len(known))
        back = (last ^ (last >> 32)) & 0xFFFFFFFF
        at, n = int(model.words.start[symbol]), int(model.words.size[symbol])
        streams[0].append([(model.words, int(model.words.nodes[i]), int(model.words.bits[i]), slot(topic, model.words.nodes[i], 0x11111111), slot(back, model.words.nodes[i], 0x22222222)) for i in range(at, at + n)])
        if symbol == len(known):
            path = []
            letters = list(w or b"") + [0x20]
            for d, c in enumerate(letters):
                prior = [letters[d - k] + 1 if d >= k else 0 for k in range(1, 5)]
                two, four = prior[0] * 257 + prior[1], ((prior[0] * 257 + prior[1]) * 257 + prior[2]) * 257 + prior[3]
                at, n = int(model.bytes.start[c]), int(model.bytes.size[c])
                path += [(model.bytes, int(model.bytes.nodes[i]), int(model.bytes.bits[i]), slot(two & 0xFFFFFFFF, model.bytes.nodes[i] + (1 << 24), 0x33333333), slot(four & 0xFFFFFFFF, model.bytes.nodes[i] + (1 << 24), 0x44444444)) for i in range(at, at + n)]
            streams[1].append(path)
            spelled.append(h)
        if symbol < len(known) and model.mark[symbol] >= 0:
            topic = int(model.mark[symbol])
        last = h
    total = []
    for k, runs in enumerate(streams):
        own, block, size, done, costs = model.weights[k].copy(), [], lm_scoring.FIRST_BLOCK, 0, []
        for run in runs:
            cost = 0.0
            for code, node, bit, one, two in run:
                a, b = (int(model.votes[j][x]) for j, x in ((0, one), (1, two)))
                x = np.array([code.vote[node], *np.array([a, b], np.uint32).view(np.float32)], np.float64)
                g = (a & 3) * 4 + (b & 3)
                odds = min(30.0, max(-30.0, float(own[g] @ x)))
                p = 1 / (1 + math.exp(-odds))
                cost -= math.log(p if bit else 1 - p)
                block.append((g, x, bit - p))
                if len(block) == size:
                    for gate in range(lm_scoring.GATES):
                        mine = [(x, miss) for at, x, miss in block if at == gate]
                        if mine:
                            own[gate] += sum(x * miss for x, miss in mine) / (lm_scoring.EASE + len(mine))
                    block, size = [], min(2 * size, lm_scoring.BLOCK)
            costs.append(-cost / math.log(10))
        total.append(costs)
    new = (once + 1) / (once + again + 2) if outside else 1.0
    out = sum(total[0])
    for h, letters in zip(spelled, total[1]):
        c = counts.get(h, 0)
        out += math.log10(new) + letters if not c else math.log10(c * (1 - new) / outside + new * 10**letters)
    return out


def test_lm_score_matches_a_plain_scorer_however_rows_are_dealt(spark, monkeypatch):
    rng = random.Random(16)
    own = [(i, " ".join(rng.choice(["red", "green", "Blue", "the", f"x{i % 9}q", f"y{rng.randint(0, 40)}", f"z{rng.random()}"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    own += [(200, None), (201, "the red " * 400 + "longunseenword" * 30), (None, "no id here"), own[3]]
    models = []
    init = lm_scoring.Model.__init__
    monkeypatch.setattr(lm_scoring.Model, "__init__", lambda self, *args: models.append(self) or init(self, *args))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for i, t in own:
        if not held(i):
            text = (t or "").translate(UPPER).encode()
            counts.update(int(h) for h in lm_scoring._tokenised(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
    for head in (1 << 17, 20):
        results = []
        for parts in (1, 13):
            rows = lm_scoring.lm_scores(docs_of(spark, own).repartition(parts), head=head, sample=30).collect()
            results.append(sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in rows))
        assert results[0] == results[1]
        model = models[-1]
        outside, once = sum(counts.values()) - int(model.count.sum()), sum(c == 1 for c in counts.values())
        edge = int(model.count.min()) if len(model.head) == head else 1
        again = sum(c for c in counts.values() if 1 < c <= edge + 1)
        want = sorted((str(i), len(SPACED.findall((t or "").translate(UPPER))) + 1, plain_lm_score(model, counts, t or "", once, again, outside)) for i, t in own)
        for (i, n, score), (j, m, expected) in zip(results[1], want):
            assert (i, n) == (j, m) and score == pytest.approx(expected, rel=2e-4, abs=2e-3)


def test_lm_sample_is_gathered_where_it_is_read(spark, monkeypatch):
    """The tables of the fitting sample come from as many tasks as the input has partitions."""
    seen = {}
    true = lm_scoring.written

    def keep(df, label):
        seen[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return true(df, label)

    monkeypatch.setattr(lm_scoring, "written", keep)
    docs = docs_of(spark, [(i, f"some words of text {i % 9}") for i in range(60)]).repartition(6)
    assert lm_scoring.lm_scores(docs, sample=10).count() == 60
    assert "lm-sample" in seen and "Repartition 1," not in seen["lm-sample"] and "Coalesce" not in seen["lm-sample"]


def test_lm_weights_are_fitted_on_every_training_document(spark, monkeypatch):
    rng = random.Random(3)
    own = [(i, " ".join(rng.choice(["red", "green", "blue", f"x{i}q"]) for _ in range(8))) for i in range(700)]
    models, fits = [], []
    init, fit = lm_scoring.Model.__init__, lm_scoring._fit_weights
    monkeypatch.setattr(lm_scoring.Model, "__init__", lambda self, *args: models.append(self) or init(self, *args))
    monkeypatch.setattr(lm_scoring, "_fit_weights", lambda cells: fits.append(cells) or fit(cells))
    assert lm_scoring.lm_scores(docs_of(spark, own)).count() == 700
    ones = np.zeros((2, 2), np.int64)
    for i, t in own:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            buf = np.frombuffer(t.encode(), np.uint8)
            for k, s in enumerate(lm_scoring.streams(models[0], buf, np.array([0, len(buf)]))[0]):
                ones[k] += np.bincount(s[3], minlength=2)
    (cells,) = fits
    assert ones.all() and (cells.reshape(2, -1, 2).sum(axis=1) == ones).all()


def test_lm_work_on_a_decision_is_shared():
    """Head words are looked up by their top bits, a context's nodes of one subtree lie in eight neighbouring slots, and
    pieces of text reuse their arrays."""
    rng = np.random.default_rng(5)
    head = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64), np.uint64((1 << 64) - 2) - np.arange(50, dtype=np.uint64)]))
    model = lm_scoring.Model(head, rng.integers(2, 1000, len(head)), 5, np.arange(256), 1, 1)
    asked = np.concatenate([head, head + np.uint64(1), head - np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    at = {int(h): i for i, h in enumerate(model.head)}
    assert model.tokens(asked).tolist() == [at.get(int(h), len(head)) for h in asked]
    assert lm_scoring.Model(head[:0], head[:0].astype(np.int64), 1, np.arange(256), 1, 1).tokens(asked).max() == 0

    code = model.words
    for symbol in (0, 17, len(head)):
        nodes = code.nodes[code.start[symbol] :][: code.size[symbol]]
        slots = lm_scoring._slots(np.full(len(nodes), 77, np.uint32), nodes, 0x11111111)
        for i in range(0, len(nodes), 3):
            assert len({int(x) for x in slots[i : i + 3]}) == len(slots[i : i + 3]) and len({int(x) >> 3 for x in slots[i : i + 3]}) == 1

    room = lm_scoring.Room()
    text = np.frombuffer(b"some words and more words", np.uint8)
    one, two = (lm_scoring.streams(model, text, np.array([0, 10, len(text)]), room)[0] for _ in range(2))
    assert all(np.shares_memory(a, b) for x, y in zip(one, two) for a, b in zip(x[2:], y[2:]))
    kept = len(room.kept)
    assert len(room("long", lm_scoring.HELD_DECISIONS + 1, np.uint8)) == lm_scoring.HELD_DECISIONS + 1 and len(room.kept) == kept
    n = np.array([0, 2, 0, 0, 3, 1, 0])
    assert lm_scoring._owners(n, np.empty(6, np.intp)).tolist() == np.repeat(np.arange(7), n).tolist()


def test_lm_codes_are_a_distribution():
    code = lm_scoring.Code(np.array([5, 1, 1, 9, 3, 0]))
    assert sum(2.0 ** -int(n) for n in code.size) == pytest.approx(1.0)


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "thing", "would"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "et", "chose", "être"], "es": ["el", "cosa", "señor", "pero"], "tlh": ["qapla", "nuqneh", "vagh"]}
    own = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(4, 40))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(600))]
    own += [(900, None, "en"), (901, "", "en"), (902, "12 !! ³", "en"), (903, "the thing", None)]
    got = {r.doc_id: r for r in language_id.languages(docs_of(spark, own)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [(got[i].lang_pred, k) for i, _, k in own if i < 900 and got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    alone = language_id.languages(docs_of(spark, [(1, "abc", None)])).first()
    assert alone.lang_pred == "und"
    assert language_id.family("de-AT") == "germanic" and language_id.family("tlh") == "tlh"


def test_quality(spark):
    rng = random.Random(4)
    text = lambda good: " ".join(rng.choice(["plain", "words", "here", "and"]) + ("" if good else "|###") for _ in range(rng.randint(3, 40)))
    own = [(i, text(i % 4 > 0)) for i in range(500)] + [(600, None), (601, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 500)] + [(600, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs_of(spark, own), labels).collect()}
    assert len(got) == len(own) and got[600].score == got[601].score
    held = [i for i in range(500) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 > 0) for i in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    none = quality.quality_scores(docs_of(spark, own), labels.limit(0)).first()
    assert none.score == pytest.approx(0.5)


def plain_buckets(text, orders, bits):
    """Buckets of all byte n-grams, one at a time."""
    b, out = text.encode(), []
    for n in orders:
        for i in range(len(b) - n + 1):
            x = 0
            for c in b[i : i + n]:
                x = (x * 0x01000193 + c + 1) & 0xFFFFFFFF
            out.append((((x ^ (n * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits))
    return out


def mixed_texts(rng, n):
    words = {"en": ["the", "and", "thing", "would"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "et", "chose", "être"], "es": ["el", "cosa", "señor", "pero"], "tlh": ["qapla", "nuqneh"]}
    own = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 20))), k) for i, k in ((i, rng.choice(list(words))) for i in range(n))]
    return own + [(n, "the thing " * 40_000, "en"), (None, "der und nicht", "de"), (None, "chose être", None), own[3], own[3], (n + 1, "", "en"), (n + 2, None, "en"), (n + 3, "!!", None)]


def test_quality_scores_match_a_plain_scorer(spark):
    rng = random.Random(14)
    own = [(i, t) for i, t, _ in mixed_texts(rng, 120)]
    labels = [(i, int("thing" in t or "chose" in t), 0) for i, t in own[:100]] + [(5, 1, 0), (None, 1, 0)]
    given = [(i, q) for i, q, _ in labels]
    docs, labels = docs_of(spark, own), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    ratio, w, a, b = quality.fit(docs, labels)
    got = quality.quality_scores(docs, labels).collect()
    want = collections.Counter()
    for i, t in own:
        seen = set(plain_buckets(t or "", quality.ORDERS, quality.BITS))
        norm = max(math.sqrt(sum(float(ratio[x]) ** 2 for x in seen)), 1e-9)
        margin = sum(float(ratio[x]) * float(w[x]) for x in seen) / norm + float(w[-1])
        want[i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0, round(1 / (1 + math.exp(-(a * margin + b))), 4)] += 1
    assert collections.Counter((r.doc_id, r.held_out, round(r.score, 4)) for r in got) == want
    # The ratios are those of smoothed document counts of each bucket.
    learned = [(t or "", q) for i, t in own for j, q in given if i == j and i is not None and zlib.crc32(str(i).encode()) % 5]
    count = {q: collections.Counter(x for t, label in learned if label == q for x in set(plain_buckets(t, quality.ORDERS, quality.BITS))) for q in (0, 1)}
    total = {q: sum(count[q].values()) + (1 << quality.BITS) for q in (0, 1)}
    for x in list(count[0] | count[1])[:500]:
        assert ratio[x] == pytest.approx(math.log((count[1][x] + 1) / total[1]) - math.log((count[0][x] + 1) / total[0]), abs=1e-4)


def test_languages_match_a_plain_predictor(spark):
    rng = random.Random(15)
    own = mixed_texts(rng, 150)
    docs = docs_of(spark, [(i, t, k) for i, t, k in own])
    model = language_id.fit(docs)
    got = language_id.languages(docs).collect()
    want = collections.Counter()
    for i, t, _ in own:
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
        if not t or not any(c.isalpha() for c in t):
            want[i, held, "und", 0.0] += 1
            continue
        grams = plain_buckets(t.lower() if t.isascii() else t.translate(UPPER), language_id.ORDERS, language_id.BITS) if len(t) < 5000 else None
        if grams is None:  # the long text repeats one phrase: its shares are those of a shorter repetition
            want[i, held, "en", None] += 1
            continue
        share = {x: math.sqrt(n / len(grams)) for x, n in collections.Counter(grams).items()}
        p = lambda m: 1 / (1 + math.exp(-(m[1] * (sum(m[0][x] * v for x, v in share.items()) + m[0][-1]) + m[2])))
        of_family = {f: p(m) for f, m in model["family"].items()}
        best = max(of_family, key=lambda f: (of_family[f], f))
        langs = model["families"][best]
        duel = lambda a, b: p(model["pair"][a, b]) if (a, b) in model["pair"] else 1 - p(model["pair"][b, a])
        wins = {a: (sum(duel(a, b) >= 0.5 if a < b else duel(a, b) > 0.5 for b in langs if b != a), sum(duel(a, b) for b in langs if b != a), a) for a in langs}
        lang = max(langs, key=wins.get)
        want[i, held, lang, round(of_family[best] * min([1.0, *(duel(lang, b) for b in langs if b != lang)]), 4)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.lang_pred, None if r.doc_id == 150 else round(r.score, 4)) for r in got) == want
    kept = language_id.with_languages(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.lang) for r in kept.collect()) == collections.Counter((r.doc_id, t, r.lang_pred) for r in got for t in {t for i, t, _ in own if i == r.doc_id and i is not None} if r.lang_pred != "und") + collections.Counter([(None, "der und nicht", "de"), (None, "chose être", "fr")])
    assert language_id.with_languages(docs.limit(0)).count() == 0


def test_hinge_fit_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x, cost = rng.normal(size=(60, 5)), np.full(60, 0.7)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    ptr = np.arange(0, 301, 5)
    w = linear_svm.fit_hinge(ptr, np.tile(np.arange(5), 60), x.ravel(), y, 5, cost, epochs=2000)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:5] + v[5]))).sum()
    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=6)) + 1e-3 for _ in range(200))


def test_license_scan(spark):
    mit = dict(license_scan.whole_licenses())["MIT"]
    own = [(1, "Copyright (c) 2020 A. Person\n" + mit.replace(",", " ;").upper()), (2, "A text.\nReleased under the MIT Licence!\nmore"), (3, mit + " and more"), (4, None), (5, ""), (5, ""), (6, "!!!"), (7, "Licensed under CC BY-NC 4.0.\nlicensed UNDER cc by nc 4 0")]
    got = collections.Counter((r.doc_id, r.license, r.n_notice_lines, r.notices, r.licensed) for r in license_scan.license_scan(docs_of(spark, own), license_scan.known_licenses(spark)).collect())
    assert got == collections.Counter([(1, "MIT", 0, "", True), (2, None, 1, "MIT", True), (3, None, 0, "", False), (4, None, 0, "", False), (5, None, 0, "", False), (5, None, 0, "", False), (6, None, 0, "", False), (7, None, 2, "CC-BY-NC-4.0", True)])


def test_license_scan_knows_unedited_entire_licences(spark):
    folder = license_scan.Path(license_scan.__file__).parent / "licenses"
    texts = {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}
    assert {"MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    mit = texts["MIT"]
    assert "The above copyright notice and this permission notice" in mit and "COPYRIGHT HOLDERS BE LIABLE" in mit
    other = mit.replace("Copyright (c) 2018 Alex Grönholm", " * Copyright 2020-2022, A. Person\n   (c) 2023 B. Person").replace("The MIT License (MIT)", "MIT License")
    own = [*texts.values(), other, " ".join(mit.split("\n\n")[2:]), mit.replace("The above copyright notice and", ""), mit.replace("OR\nCOPYRIGHT HOLDERS", "")]
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs_of(spark, list(enumerate(own))), license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(own))] == [n.removesuffix(".regents") for n in texts] + ["MIT", "MIT", None, None]


def test_license_scan_drops_statements_but_no_clauses(spark):
    texts = dict(license_scan.whole_licenses())
    mit, bsd = texts["MIT"], texts["BSD-3-Clause"]
    body = mit[mit.index("Permission is hereby") :]
    terms = bsd[bsd.index("Redistribution and use") :]
    own = [
        "Copyright Jane Doe\n\n" + body, "MIT License\n\nCopyright Jane Doe and others\n\n" + body, "MIT License\nCopyright: The Authors\n\n" + body,
        "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + terms, "Copyright Jane Doe\n  All Rights Reserved\n\n" + terms,
        "Copyright Jane Doe forbids every use, sale and copy of this work without a licence\n\n" + body, "Jane Doe keeps the copyright\n\n" + body, body.replace("copyright holders", "holders").replace("COPYRIGHT HOLDERS", "HOLDERS"),
    ]
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs_of(spark, list(enumerate(own))), license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(own))] == ["MIT", "MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", None, None, None]


def test_license_scan_of_empty_tables_long_texts_and_clashing_columns(spark):
    known = license_scan.known_licenses(spark)
    assert license_scan.license_scan(docs_of(spark, [(1, "x")]).where("false"), known).collect() == []
    mit = dict(license_scan.whole_licenses())["MIT"]
    docs = docs_of(spark, [(1, "word " * 400_000), (2, mit), (2, mit)]).withColumns({"lines": F.lit("l"), "license": F.lit("l"), "digest": F.lit("d"), "_canonical_low": F.lit("c")})
    assert sorted((r.doc_id, r.license) for r in license_scan.license_scan(docs, known).collect()) == [(1, None), (2, "MIT"), (2, "MIT")]


def test_mixing_stays_within_one_block(spark):
    own = [(i, "t", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(5000 + i, None, None, None) for i in range(40)]
    df = docs_of(spark, own)
    weights = spark.createDataFrame([("hot", 0.5), ("s0", 0.2), ("s1", 0.1), ("s2", 0.1), ("s3", 0.05), (None, 0.05)], "source string, weight double")
    plan = mixing.schedule(weights, 200).collect()
    q = {r.source: r.q for r in plan}
    assert sum(q.values()) == 200 and len(plan) == 200 and sorted(r.slot for r in plan) == list(range(200))
    done = collections.Counter()
    for r in sorted(plan, key=lambda r: r.slot):
        done[r.source] += 1
        assert all(abs(done[s] - q[s] * (r.slot + 1) / 200) < 1 for s in q)
    out = mixing.mix(df, weights, 200, block=4).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in own) and set(df.columns) < set(out[0].asDict())
    assert len({(r.mix_slot, r.mix_place) for r in out}) == len(out)
    full = [r for r in out if r.mix_full]
    assert full and collections.Counter(r.mix_slot for r in full).most_common()[-1][1] == 4
    missing = mixing.mix(df, weights.where("source = 'hot'"), 10).where("source = 's1'").first()
    assert missing.mix_slot is None and missing.mix_full is False
    assert mixing.mix(df.limit(0), weights).collect() == []


def test_exact_mixing_follows_the_weights_over_all_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FRAME", 200)
    weight = {"hot": 0.3, None: 0.1037, **{f"s{i}": 0.5963 / 28 for i in range(28)}}
    weights = spark.createDataFrame(list(weight.items()), "source string, weight double")
    own = [(i, "t", "en", "hot") for i in range(3000)] + [(5000 + i, None, None, None) for i in range(900)] + [(9000 + i, "t", "en", f"s{i % 28}") for i in range(5000)]
    docs = docs_of(spark, own + [(20_000, "t", "en", "other")])
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    plan = sorted(mixing.exact_schedule(weights, sizes, 4).collect(), key=lambda r: r.slot)
    assert [r.slot for r in plan] == list(range(len(plan))) and len(plan) > 2000
    total, done = sum(weight.values()), collections.Counter()
    for r in plan:
        assert r.k == done[r.source]
        done[r.source] += 1
        assert all(abs(done[s] - w / total * (r.slot + 1)) < 1 for s, w in weight.items())
    slot = {(r.source, r.k): r.slot for r in plan}
    out = mixing.mix(docs, weights, None, block=4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    assert all(r.mix_slot == slot[r.source, r.mix_block] for r in out if r.source != "other")
    assert [(r.mix_slot, r.mix_full) for r in out if r.source == "other"] == [(None, False)]
    full = collections.Counter(r.mix_slot for r in out if r.mix_full)
    assert full and set(full) == set(range(len(full))) and set(full.values()) == {4}
    assert mixing.mix(docs.limit(0), weights, None).collect() == []


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["slot", "k", "q", "period", "rows", "weight", "_s", "f", "state", "mix_full"]
    own = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(100)], "doc_id long, source string").select("*", *[F.lit(n).alias(n) for n in names])
    for period in (None, 20):
        out = mixing.mix(own, mixing.natural_weights(own), period, block=3)
        rows = out.collect()
        assert len(rows) == 100 and len({(r.mix_slot, r.mix_place) for r in rows}) == 100
        assert all(r[n] == n for r in rows for n in names[:-1])


def test_mixing_blocks_do_not_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 4, raising=False)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, source string")
    out = mixing.mix(docs, mixing.natural_weights(docs)).collect()
    assert {s: max(r.mix_block for r in out if r.source == s) for s in "ab"} == {"a": 199 // 16, "b": 99 // 16} and {r.mix_place for r in out} == set(range(16))


def plain_schedule(weights, slots):
    """(source number, block, slot) by simulation: of the released blocks the earliest deadline, ties to the earlier source."""
    q = [max(1, round(w / sum(weights) * mixing.SHARES)) for w in weights]
    q[q.index(max(q))] += mixing.SHARES - sum(q)
    done, out = [0] * len(q), []
    for t in range(slots):
        i = min((-(-(done[i] + 1) * mixing.SHARES // x), i) for i, x in enumerate(q) if done[i] * mixing.SHARES < (t + 1) * x)[1]
        out.append((i, done[i], t))
        done[i] += 1
    return out


@pytest.mark.parametrize("weights, rows, frame", [([0.989, 0.01, 0.001], [300, 3, 2], 7), ([0.25] * 4, [100] * 4, 5), ([1.0], [50], 3), ([1.0, 2.0, 0.5, 0.125, 3.0, 3.0, 0.01], [20] * 7, 11)])
def test_frames_run_side_by_side_give_the_simulated_schedule(spark, monkeypatch, weights, rows, frame):
    monkeypatch.setattr(mixing, "FRAME", frame)
    names = [f"s{i}" for i in range(len(weights))]
    sizes = spark.createDataFrame(list(zip(names, rows)), "source string, rows long")
    plan = mixing.exact_schedule(spark.createDataFrame(list(zip(names, weights)), "source string, weight double"), sizes, 2)
    got = sorted(((int(r.source[1:]), r.k, r.slot) for r in plan.collect()), key=lambda r: r[2])
    assert len(got) > 20 and got == plain_schedule(weights, len(got))
