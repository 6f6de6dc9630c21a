"""Token alignment against the two libraries, pair by pair."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import alignment as al
from parcelflow.llm.token_counts import _byte_letters, tokenizer_path

from .test_operators import corpus, docs_of

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HARD = [
    "e▁f g", "▁", " lead", "trail ", "two  spaces and   three", "tab\tand\nline\n\n next", "<s> </s> <|endoftext|> <unk> <0x41>", "ﬁ ａ　b c", "café á", "\x00\x01 a", "😀 😀😀 x", "語 日本語 の 文",
    "\x1c x \x1d y", "a" * 3000 + " " + "b c " * 500, "don't we'll  'tis 12 345", " x   y",
]


@pytest.fixture(scope="module")
def texts():
    return [(i, x) for i, x, *_ in corpus(4, 30)] + [(1000 + i, x) for i, x in enumerate(HARD)] + [(None, "a null id"), (1003, "trail "), (7777, HARD[4])]


def brute(rows):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by walking both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(tokenizer_path(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    a_tok.encode_special_tokens = True
    letters = _byte_letters()
    a_bytes = {i: bytes(letters[c] for c in k) for k, i in a_tok.get_vocab().items() if all(c in letters for c in k)}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    found, docs = [], collections.Counter()
    for _, x in rows:
        raw = (" " + x).encode() if x else b""
        a, b = (a_tok.encode(" " + x, add_special_tokens=False).ids, b_tok.encode(x)) if x else ([], [])
        if not x or b"".join(map(a_bytes.get, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            found.append(None)
            continue
        links, groups, i, j, i0, j0, at_a, at_b = [], [], 0, 0, 0, 0, len(a_bytes[a[0]]), len(b_bytes(b[0]))
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = at_a <= at_b, at_b <= at_a
            if step_a and step_b:
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                i0, j0 = i + 1, j + 1
            if i + step_a == len(a):
                break
            if step_a:
                i += 1
                at_a += len(a_bytes[a[i]])
            if step_b:
                j += 1
                at_b += len(b_bytes(b[j]))
        found.append((len(a), len(b), groups, links))
        docs.update(set(links))
    top = collections.defaultdict(int)
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    out = [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (f[0], f[1], len(f[2]), len(f[3]), sum(docs[k] == top[k[0]] for k in f[3]), sum(docs[k] for k in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]
    return out, docs, collections.Counter(k for f in found if f for k in f[3])


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_the_libraries(spark, texts, monkeypatch, small):
    docs = docs_of(spark, texts)
    if small:  # forgetful workers; few postings a block do not change a thing either, as blocks follow the partitions
        docs = docs.repartition(40)
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLS)) for r in al.alignment(docs).collect())
    want = brute(texts)[0]
    assert got == sorted((i is None, i or 0, *w) for (i, _), w in zip(texts, want))
    assert any(w[0] == 0 for w in want) and any(w[0] for w in want)


def test_pair_counts(spark, texts):
    _, docs, links = brute(texts)
    got = {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in al.aligned_pairs(docs_of(spark, texts).repartition(5)).collect()}
    assert got == {k: (docs[k], links[k]) for k in docs}


def test_empty_table(spark):
    assert al.alignment(docs_of(spark, [(1, "x")]).where("false")).collect() == []
    only = al.alignment(docs_of(spark, [(1, None), (2, "")])).collect()
    assert [tuple(r[c] for c in COLS) for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_a_worker_that_forgets_gives_the_same_chunks(monkeypatch):
    own = al.Aligner(tokenizer_path(A), tokenizer_path(B))
    texts = [f"word{i} and some more {i % 7}" for i in range(300)]
    want = own.documents(texts)
    monkeypatch.setattr(al, "CHUNKS", 40)
    again = al.Aligner(tokenizer_path(A), tokenizer_path(B))
    got = [again.documents([x])[0][0] for x in texts]
    assert got == want[0]


def test_packed_postings_round_trip():
    import numpy as np

    rng = random.Random(2)
    for width in (1, 7, 64, 4096):
        post = {(p, d): rng.choice([1, 1, 1, 2, 5, 300]) for p in range(40) for d in range(width) if rng.random() < (0.9 if p % 5 == 0 else 0.01)}
        post[99, width - 1] = 7
        keys = sorted(post)
        pair, doc, times = (np.array(x) for x in ([k[0] for k in keys], [k[1] for k in keys], [post[k] for k in keys]))
        p = al.Postings(al.pack(pair, doc, times, width))
        assert list(zip(np.repeat(p.pairs, p.counts()).tolist(), p.docs().tolist(), p.times().tolist())) == [(*k, post[k]) for k in keys]
