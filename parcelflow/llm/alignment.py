"""Alignment of the tokens that two vocabularies give to the same texts, with corpus-wide scores of the linked pairs.

Tokens of both sides never cross a single space between two words, so a text is a sequence of chunks (a space and what
follows up to the next such space) whose alignment does not depend on what stands around them; every worker remembers
the chunks that it has aligned.  Documents are numbered within blocks.  Each pair of ids has, in every block that holds
it, a compressed bitmap of documents (a sorted list where that is smaller) made by OR of the documents' bits, and bit
planes of multiplicities.  Popcounts give document and link counts; scores go back to the documents along the postings.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .spark_util import discard, with_text, written
from .token_counts import _byte_letters, tokenizer_path

#: Documents and postings after which a block ends; pairs are dealt to buckets by their A id.
DOC_BITS, BLOCK_POSTINGS, BUCKETS = 12, 2_000_000, 64
BLOCK_DOCS = 1 << DOC_BITS
#: Chunks that a worker remembers, and bytes of them; postings gathered before they are added up.
CHUNKS, CHUNK_BYTES, RUN = 700_000, 32 << 20, 1 << 14
B_BITS = 20
SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
INFO = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Both tokenizers of a worker and the chunks aligned so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = {i: bytes(map(letters.__getitem__, tok)) if all(c in letters for c in tok) else tok.encode() for tok, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: A piece with a space behind a letter could cross a border; then texts are taken whole.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.bytes, self.joined = 0, []
        self.numbers, self.first, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The chunks of space+text, each without its leading space."""
        return SPACE_BETWEEN.split(text) if self.cuts else [text]

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """Of chunks, each with its leading space: (n_a, n_b, n_groups, n_links) of each, linked pairs a << B_BITS | b of all
        in order, groups of each written out.  A chunk whose bytes differ on one side has no links, and None for groups."""
        text = "".join(texts)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(texts) == 1:
                return np.zeros((1, 4), np.int64), np.zeros(0, np.int64), [None]
            parts = [self.align([x]) for x in texts]
            return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), [g for x in parts for g in x[2]]
        a_id, b_id = np.asarray(a), np.asarray(b)
        a_end, b_end = np.cumsum(self.a_size[a_id]), np.cumsum(self.b_size[b_id])
        ends, both = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        pairs = (a_id[np.searchsorted(a_end, ends)] << B_BITS) | b_id[np.searchsorted(b_end, ends)]
        a_to, b_to = (np.searchsorted(a_end, both) + 1).tolist(), (np.searchsorted(b_end, both) + 1).tolist()
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups = [
            f"{a_text[x]}|{b_text[y]}" if u - x == 1 == v - y else f"{','.join(a_text[x:u])}|{','.join(b_text[y:v])}"
            for x, u, y, v in zip([0, *a_to], a_to, [0, *b_to], b_to)
        ]
        stop = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in texts])
        at = np.stack([np.searchsorted(e, stop, "right") for e in (a_end, b_end, both, ends)], axis=1)
        cuts = at[:, 2].tolist()
        return np.diff(at, axis=0, prepend=0), pairs, [";".join(groups[x:y]).encode() for x, y in zip([0, *cuts], cuts)]

    def learn(self, new: list[str]) -> None:
        """Align chunks that are not known yet, many in one run of the tokenizers."""
        numbers, pairs, at = [self.numbers], [self.pairs], 0
        self.index.update(zip(new, range(len(self.joined), len(self.joined) + len(new))))
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) < RUN):
                size += len(new[to]) + 1
                to += 1
            n, p, groups = self.align([" " + x for x in new[at:to]])
            numbers.append(n)
            pairs.append(p)
            self.joined += groups
            self.bytes += size
            at = to
        self.numbers, self.pairs = np.concatenate(numbers), np.concatenate(pairs)
        self.first = np.concatenate([[0], np.cumsum(self.numbers[:, 3])])

    def documents(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Per text (numbers, digest of its groups); then document, pair and multiplicity of every posting."""
        split = [self.chunks(x) if x else [] for x in texts]
        new = list({c for s in split for c in s if c not in self.index})
        if len(self.index) + len(new) > CHUNKS or self.bytes > CHUNK_BYTES:
            self.forget()
            new = list({c for s in split for c in s})
        if new:
            self.learn(new)
        info, which, docs = [], [], []
        for i, s in enumerate(split):
            known = list(map(self.index.__getitem__, s))
            parts = list(map(self.joined.__getitem__, known))
            if not parts or None in parts:
                info.append(((0, 0, 0, 0), ""))
                continue
            chunk = np.array(known)
            info.append((tuple(self.numbers[chunk].sum(0).tolist()), hashlib.sha256(b";".join(parts)).hexdigest()))
            which.append(chunk)
            docs.append(np.full(len(chunk), i))
        if not docs:
            return info, *(np.zeros(0, np.int64) for _ in range(3))
        key, times = np.unique(np.concatenate(docs) << 32 | np.concatenate(which), return_counts=True)
        doc, chunk = key >> 32, key & 0xFFFFFFFF
        many = self.numbers[chunk, 3]
        at = np.repeat(self.first[chunk] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return info, np.repeat(doc, many), self.pairs[at], np.repeat(times, many)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_name: str, b_name: str) -> Aligner:
    """One aligner for each pair of vocabularies and Python worker."""
    if (a_name, b_name) not in _aligners:
        _aligners[a_name, b_name] = Aligner(tokenizer_path(a_name), tokenizer_path(b_name))
    return _aligners[a_name, b_name]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def pack(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, width: int) -> bytes:
    """Postings in order of (pair, doc) of a block of ``width`` documents as bytes: per pair a bitmap, or a sorted list
    where that is smaller, then the planes of the multiplicities above one."""
    pairs, first, n = np.unique(pair, return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(pairs)), n)
    stride = -(-width // 8)
    dense = 2 * n > stride
    bits = np.zeros((int(dense.sum()), stride), np.uint8)
    of = np.cumsum(dense) - 1
    own = dense[row]
    np.bitwise_or.at(bits, (of[row[own]], doc[own] >> 3), (1 << (doc[own] & 7)).astype(np.uint8))
    planes = [np.packbits(((times - 1) >> j & 1).astype(bool)) for j in range(int(times.max() - 1).bit_length())]
    head = np.array([len(pairs), len(doc), stride, len(planes)], np.int64)
    return b"".join(x.tobytes() for x in (head, pairs.astype(np.int64), np.where(dense, 0, n).astype(np.uint16), bits, doc[~own].astype(np.uint16), *planes))


class Postings:
    """What ``pack`` wrote."""

    def __init__(self, data: bytes):
        n, self.size, stride, planes = np.frombuffer(data, np.int64, 4).tolist()
        self.pairs = np.frombuffer(data, np.int64, n, 32)
        at = 32 + 8 * n
        self.listed = np.frombuffer(data, np.uint16, n, at).astype(np.int64)
        at += 2 * n
        rows = int((self.listed == 0).sum())
        self.bits = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)
        at += rows * stride
        self.list = np.frombuffer(data, np.uint16, int(self.listed.sum()), at).astype(np.int64)
        at += 2 * len(self.list)
        width = -(-self.size // 8)
        self.planes = [np.frombuffer(data, np.uint8, width, at + j * width) for j in range(planes)]

    def counts(self) -> np.ndarray:
        """Documents of every pair: popcounts of its bitmap, or the length of its list."""
        out = self.listed.copy()
        out[out == 0] = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        return out

    def times(self) -> np.ndarray:
        """Multiplicity of every posting, in order of (pair, document)."""
        out = np.ones(self.size, np.int64)
        for j, plane in enumerate(self.planes):
            out += np.unpackbits(plane, count=self.size).astype(np.int64) << j
        return out

    def docs(self) -> np.ndarray:
        """Document of every posting, in order of (pair, document)."""
        row = np.repeat(np.arange(len(self.pairs)), self.counts())
        dense = (self.listed == 0)[row]
        out = np.empty(self.size, np.int64)
        out[~dense] = self.list
        out[dense] = np.nonzero(np.unpackbits(self.bits, axis=1, bitorder="little"))[1]
        return out


class Block:
    """Documents of one block and their postings so far."""

    def __init__(self, number: int):
        self.number, self.rows, self.keys, self.times, self.size = number, [], [], [], 0

    def add(self, ids: list, info: list, doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        keys, times = summed(pair << DOC_BITS | doc + len(self.rows), times)
        self.rows += [(i, *numbers, digest) for i, (numbers, digest) in zip(ids, info)]
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        n = len(self.rows)
        cols = list(zip(*self.rows))
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.array([-1] * n, pa.int32()), pa.array(range(n), pa.int32()), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string()), none], names=NAMES)
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.lexsort((keys, (keys >> DOC_BITS + B_BITS) % BUCKETS))
        keys, times = keys[order], times[order]
        bucket = (keys >> DOC_BITS + B_BITS) % BUCKETS
        for k in np.unique(bucket).tolist():
            a, b = np.searchsorted(bucket, [k, k + 1])
            data = pack(keys[a:b] >> DOC_BITS, keys[a:b] & BLOCK_DOCS - 1, times[a:b], n)
            lone = [pa.array([self.number], pa.int64()), pa.array([k], pa.int32()), pa.array([n], pa.int32()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(lone, names=NAMES)


#: A row is a document of a block (bucket -1, place = its number there) or a bucket's postings (place = documents of the block).
NAMES = ["block", "bucket", "place", "doc_id", *INFO, "groups_sha256", "data"]
BLOCKS = "block long, bucket int, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary"


def aligned_blocks(docs: DataFrame, a_name: str, b_name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_name, b_name)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, buf, offs in t.pieces(t.texts_of(batch), 1 << 20):
                for x in range(a, b, BLOCK_DOCS):
                    y = min(b, x + BLOCK_DOCS)
                    if block.rows and (len(block.rows) + y - x > BLOCK_DOCS or block.size > BLOCK_POSTINGS):
                        yield from block.rows_out()
                        number += 1
                        block = Block(number)
                    block.add(ids[x:y], *own.documents([buf[u:v].tobytes().decode() for u, v in zip(offs[x - a : y - a].tolist(), offs[x - a + 1 : y - a + 1].tolist())]))
        if block.rows:
            yield from block.rows_out()

    return written(with_text(docs).mapInArrow(run, BLOCKS), "alignment-blocks")


def _merged(totals: dict, pairs: np.ndarray, values: np.ndarray) -> None:
    """Add (pairs, values with one row per count) to the totals of a bucket."""
    if totals:
        pairs, values = np.concatenate([totals["pairs"], pairs]), np.concatenate([totals["values"], values])
    totals["values"] = np.stack([summed(pairs, values[:, j])[1] for j in range(values.shape[1])], axis=1)
    totals["pairs"] = np.unique(pairs)


def _count_row(bucket: int, salt: int, totals: dict) -> pa.RecordBatch:
    cols = [pa.array([bucket], pa.int32()), pa.array([salt], pa.int32()), pa.array([totals["pairs"].tobytes()], pa.binary()), pa.array([totals["values"].tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "salt", "pairs", "counts"])


COUNTS = "bucket int, salt int, pairs binary, counts binary"


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document and link counts of a task's postings, one row a bucket."""
    totals: dict[int, dict] = {}
    for batch in batches:
        for k, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
            p = Postings(data)
            n = p.counts()
            links = np.add.reduceat(p.times(), np.cumsum(n) - n)
            _merged(totals.setdefault(k, {}), p.pairs, np.stack([n, links], axis=1))
    salt = TaskContext.get().partitionId() % 16
    for k, found in totals.items():
        yield _count_row(k, salt, found)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, salt), those of one key added up."""
    key, totals = None, {}
    for batch in batches:
        for k, s, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if key not in (None, (k, s)):
                yield _count_row(*key, totals)
                totals = {}
            key = k, s
            _merged(totals, np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64).reshape(-1, 2))
    if key:
        yield _count_row(*key, totals)


def pair_totals(blocks: DataFrame) -> DataFrame:
    """One row a bucket: its pairs, and documents and links of each.  Added up in three steps: by task, by salt, by bucket."""
    rows = blocks.where("bucket >= 0").select("bucket", "data").mapInArrow(_popcounts, COUNTS)
    for salt in (F.col("salt"), F.lit(0)):
        rows = rows.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_added, COUNTS)
    return written(rows.select("bucket", "pairs", "counts"), "alignment-pairs")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, salt, block), the pairs of a bucket with their counts first (block -1).  Per bucket of a
    block: for every document the links to an A id's best pairs, and the sum of counts over links."""
    key = total = best = None
    for batch in batches:
        for k, _, block, n, data, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if block < 0:
                key, total = np.frombuffer(data, np.int64), np.frombuffer(counts, np.int64).reshape(-1, 2)[:, 0]
                a = np.unique(key >> B_BITS, return_index=True)[1]
                best = total == np.repeat(np.maximum.reduceat(total, a), np.diff(np.append(a, len(key))))
                continue
            p = Postings(data)
            at = np.repeat(np.searchsorted(key, p.pairs), p.counts())
            doc, times = p.docs(), p.times()
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * total[at])
            cols = [pa.array([block], pa.int64()), pa.array([k], pa.int32()), pa.array([n], pa.int32()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.array([sums.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (block, bucket): the documents of a block first, then what each bucket adds to them."""

    def out() -> pa.RecordBatch:
        cols, added = list(zip(*rows)), np.zeros((2, len(rows)), np.int64)
        for x in sums:
            added += x
        arrays = [pa.array(c, pa.int64()) for c in (*cols[:5], *added)] + [pa.array(cols[5], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *INFO, "n_best", "count_sum", "groups_sha256"])

    number, rows, sums = None, [], []
    for batch in batches:
        for block, bucket, _, *doc, data in zip(*(c.to_pylist() for c in batch.columns)):
            if block != number:
                if rows:
                    yield out()
                number, rows, sums = block, [], []
            if bucket < 0:
                rows.append(doc)
            else:
                sums = [sum(sums, np.frombuffer(data, np.int64).reshape(2, -1))]
    if rows:
        yield out()


def alignment(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    a_name, b_name: a byte-level vocabulary that gets space+text and a sentencepiece model that adds the space itself.
    Null and empty texts, and those whose tokens' bytes are not space+text on both sides, get zeros and ''.  Every row is a
    document of its own, also where its doc_id is null or repeated.  Very long texts are taken whole.  An empty table gives
    an empty one; other columns are not read."""
    blocks = aligned_blocks(docs, a_name, b_name)
    totals = pair_totals(blocks)
    spread = max(1, blocks.where("bucket = -1 AND place = 0").count() // 16)
    posted = blocks.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("block"), F.lit(spread)).alias("salt"), "block", "place", "data", F.lit(None).cast("binary").alias("counts"))
    scores = totals.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("salt"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("place"), F.col("pairs").alias("data"), "counts")
    sums = scores.unionByName(posted).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "block").mapInArrow(_scored, BLOCKS)
    rows = blocks.where("bucket = -1").unionByName(sums).repartition("block").sortWithinPartitions("block", "bucket", "place")
    return rows.mapInArrow(_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
            key, n = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64).reshape(-1, 2)
            cols = key >> B_BITS, key & ((1 << B_BITS) - 1), n[:, 0], n[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a_id", "b_id", "n_docs", "n_links"])


def aligned_pairs(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """(a_id, b_id, n_docs, n_links): every pair of ids linked anywhere, with its documents and links; rules as in ``alignment``."""
    blocks = aligned_blocks(docs, a_name, b_name)
    totals = pair_totals(blocks)
    discard(blocks)
    return totals.mapInArrow(_pair_rows, "a_id long, b_id long, n_docs long, n_links long")
