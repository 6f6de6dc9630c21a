"""Token counts by prefix dynamic programming over byte-pair encodings.

For every prefix of a pre-token the encoding's last token is unique, and it fits behind the last token of the
shorter prefix exactly if no merge across their border would have run before their own merges.  So one pass over the
end positions, longest token first, finds the last token of every prefix, and count[end] = count[start] + 1 is the
exact number of tokens of each prefix.  Truncation and budget questions are read from those counts.  Many distinct
pre-tokens run in step as numpy arrays; long ones run alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spark_util import with_text

#: Fixed value: the pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 96
CACHE = 400_000
TABLE_BITS = 21
NEVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 is itself, the rest follows U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Lookup:
    """64-bit keys -> values in one open table (linear probing, built once)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.shift = np.uint64(64 - TABLE_BITS)
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.values = np.full(1 << TABLE_BITS, missing, np.int64)
        self.used = np.zeros(1 << TABLE_BITS, bool)
        self.probes = 1
        for k, v in zip(keys.tolist(), values.tolist()):
            at, n = k >> int(self.shift), 1
            while self.used[at]:
                at, n = (at + 1) & ((1 << TABLE_BITS) - 1), n + 1
            self.keys[at], self.values[at], self.used[at] = k, v, True
            self.probes = max(self.probes, n)
        self.missing = missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        out = np.where((self.keys[at] == keys) & self.used[at], self.values[at], self.missing)
        open_ = np.flatnonzero((out == self.missing) & self.used[at])
        for n in range(1, self.probes):
            if not len(open_):
                break
            a = (at[open_] + n) & ((1 << TABLE_BITS) - 1)
            hit = (self.keys[a] == keys[open_]) & self.used[a]
            out[open_[hit]] = self.values[a[hit]]
            open_ = open_[~hit & self.used[a]]
        return out


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return t.mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


class PrefixCounter:
    """Exact token counts of every prefix for a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        size = max(vocab.values()) + 1
        self.rank = np.zeros(size, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        pairs_a, pairs_b = [], []
        for i, m in enumerate(merges):
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if not self.rank[c]:
                self.rank[c], self.left[c], self.right[c] = i + 1, a, b
            pairs_a.append(a)
            pairs_b.append(b)
        self.bytes_of = {i: bytes(letters[ch] for ch in tok) for tok, i in vocab.items() if all(ch in letters for ch in tok)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.longest = max(map(len, self.id_of))
        toks = list(self.id_of)
        buf = np.frombuffer(b"".join(toks), np.uint8)
        size_of = np.array([len(x) for x in toks])
        ends = np.cumsum(size_of)
        self.tokens = _Lookup(t.span_hash(t.prefix_hash(buf), ends - size_of, ends), np.array([self.id_of[x] for x in toks]), -1)
        self.cross = _Lookup(_pair_key(np.array(pairs_a), np.array(pairs_b)), np.arange(1, len(merges) + 1), NEVER)
        self.cross_of = {(a, b): i for i, (a, b) in reversed(list(enumerate(zip(pairs_a, pairs_b), 1)))}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        self.cache: dict[str, int] = {}

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may stand right behind token a: undo both tokens' merges from the latest to the earliest and
        see that no merge over the border would have come first (of equal merges the left one comes first)."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NEVER)
        while len(at):
            ok = self.cross(_pair_key(a, b)) >= limit
            ra, rb = self.rank[a], self.rank[b]
            base = (ra == 0) & (rb == 0)
            out[at[ok & base]] = True
            go = ok & ~base
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def fits_one(self, a: int, b: int) -> bool:
        limit = NEVER
        while True:
            if self.cross_of.get((a, b), NEVER) < limit:
                return False
            ra, rb = int(self.rank[a]), int(self.rank[b])
            if not ra and not rb:
                return True
            if ra > rb:
                limit, a = ra, int(self.right[a])
            else:
                limit, b = rb + 1, int(self.left[b])

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for every i, data being one pre-token."""
        count, last, known = [0] * (len(data) + 1), [-1] * (len(data) + 1), {}
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                tok = self.id_of.get(data[start:end])
                if tok is None:
                    continue
                if start:
                    pair = (last[start], tok)
                    if pair not in known:
                        known[pair] = self.fits_one(*pair)
                    if not known[pair]:
                        continue
                last[end], count[end] = tok, count[start] + 1
                break
        return count

    def _many(self, data: list[bytes]) -> np.ndarray:
        """Token counts of many short pre-tokens in step."""
        size = np.array([len(x) for x in data])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        buf = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
        begin = np.cumsum(size) - size
        prefix = t.prefix_hash(buf)
        count = np.zeros((int(size[0]) + 1, len(data)), np.int32)
        last = np.full((int(size[0]) + 1, len(data)), -1, np.int64)
        for end in range(1, int(size[0]) + 1):
            left = np.arange(int(np.searchsorted(-size, -end, "right")))
            for start in range(max(0, end - self.longest), end):
                if not len(left):
                    break
                tok = self.tokens(t.span_hash(prefix, begin[left] + start, begin[left] + end))
                hit = np.flatnonzero(tok >= 0)
                if start and len(hit):
                    hit = hit[self.fits(last[start, left[hit]], tok[hit])]
                if len(hit):
                    who = left[hit]
                    last[end, who], count[end, who] = tok[hit], count[start, who] + 1
                    keep = np.ones(len(left), bool)
                    keep[hit] = False
                    left = left[keep]
        out = np.empty(len(data), np.int64)
        out[order] = count[size, np.arange(len(data))]
        return out

    def learn(self, new: list[str]) -> None:
        coded = [p.encode() for p in new]
        short = [i for i, d in enumerate(coded) if len(d) <= LONG]
        for i, d in enumerate(coded):
            if len(d) > LONG:
                self.cache[new[i]] = self.prefix_counts(d)[-1]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self.cache.update(zip([new[i] for i in part], self._many([coded[i] for i in part]).tolist()))

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special tokens) of a text; special strings count as one token each."""
        if self.cut is None or not any(x in text for x in self.special):
            return self.pattern.findall(text), 0
        parts = self.cut.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Exact token count of each whole text."""
        split = [self.split(x) for x in texts]
        new = {p for ps, _ in split for p in ps if p not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = {p for ps, _ in split for p in ps}
        self.learn(list(new))
        get = self.cache.__getitem__
        return [sum(map(get, ps)) + n for ps, n in split]

    def truncate(self, text: str, budget: int) -> tuple[str, int]:
        """(longest prefix of whole characters found with at most ``budget`` tokens, its count).

        The cut is read from the prefix counts; only the last pre-token is split again to see the count of the cut text."""
        done = used = 0
        for m in self.pattern.finditer(text):
            n = self.counts([m.group()])[0]
            if used + n > budget:
                piece = m.group()
                at = self.prefix_counts(piece.encode())
                for k in range(len(piece), 0, -1):
                    if used + at[len(piece[:k].encode())] <= budget + 1 and used + (tail := self.counts([piece[:k]])[0]) <= budget:
                        return text[: m.start() + k], used + tail
                break
            done, used = m.end(), used + n
        return text[:done], used


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text); null texts are empty.

    vocabulary: name of a byte-level BPE file that every worker can find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path(vocabulary))
        for batch in batches:
            sizes, counts = [], []
            for a, b, buf, offs in t.pieces(t.texts_of(batch), 1 << 20):
                data = buf.tobytes()
                sizes += np.diff(offs).tolist()
                counts += own.counts([data[x:y].decode("utf-8", "replace") for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = with_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def truncate_to_budget(docs: DataFrame, budget: int, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text, n_tokens): every text cut to at most ``budget`` tokens (special strings are ordinary text here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path(vocabulary))
        for batch in batches:
            out = [own.truncate(x or "", budget) for x in t.texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["doc_id", "text", "n_tokens"])

    return with_text(docs).mapInArrow(run, "doc_id long, text string, n_tokens long")
