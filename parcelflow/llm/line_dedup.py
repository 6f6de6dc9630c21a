"""Removal of lines that many documents share, told by two Bloom filters.

The filters are a table of slices, each a set of bits, so that they grow with the number of lines.  Tasks set the bits of
their documents' line digests, once and twice; the slices of all tasks are added up, and bits set by two documents remain
as the filter of lines seen twice.  Digests whose bits are all in it are suspects; only those are shuffled, counted
exactly on their 128 bits, and the largest document of each chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as t
from .spark_util import LAST, discard, written

SPACE = " \t\n\v\f\r"
#: Bits of a slice (as a power of two), lines for each slice, probes of a line, digests in a row.
SLICE, LINES, PROBES, ROW = 15, 2048, 3, 4096
#: Slices (of 4 KB) up to which the filter is broadcast; beyond, digests meet it in a shuffled join.
BROADCAST_SLICES = 1 << 14
#: Digests of one task that are added up at once, and shares into which the documents of a line are dealt.
RUN, SALTS = 1 << 20, 32


def keys_of(text: str, min_chars: int) -> list[bytes | None]:
    """Key of every line of a text: stripped, A-Z lower-cased; None where it is too short."""
    return [k.encode().lower() if len(k := line.strip(SPACE)) >= min_chars else None for line in text.split("\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit digests of lines as pairs of longs."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.int64).reshape(-1, 2)


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for a, b, buf, offs in t.pieces(t.texts_of(batch), 1 << 20):
                out = []
                for i in range(a, b):
                    keys = {k for k in keys_of(buf[offs[i - a] : offs[i - a + 1]].tobytes().decode(), min_chars) if k is not None}
                    d = digests(list(keys))
                    out += [(ids[i], d[x : x + ROW, 0], d[x : x + ROW, 1]) for x in range(0, len(d), ROW)]
                if out:
                    cols = [pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[j] for x in out], pa.list_(pa.int64())) for j in (1, 2)]]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "h", "g"])

    return run


def _set_bits(bits: int):
    """Rows of digests -> (slice, bits set once or more, bits set twice or more) of a run of them, bits as sorted places."""

    def added(runs: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(runs).view(np.uint64)
        part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        places = [part << SLICE | (h >> np.uint64(SLICE * j) & np.uint64((1 << SLICE) - 1)).astype(np.int64) for j in range(PROBES)]
        # two probes of one line in one place set it once
        for j in range(1, PROBES):
            for i in range(j):
                places[j] = np.where(places[j] == places[i], -1, places[j])
        at, n = np.unique(np.concatenate(places), return_counts=True)
        at, n = at[at >= 0], n[at >= 0]
        twice = at[n > 1]
        slices, first = np.unique(at >> SLICE, return_index=True)
        ends, low = np.append(first[1:], len(at)), (at & ((1 << SLICE) - 1)).astype(np.uint16)
        two_first, two_ends = np.searchsorted(twice, slices << SLICE), np.searchsorted(twice, slices + 1 << SLICE)
        two_low = (twice & ((1 << SLICE) - 1)).astype(np.uint16)
        once = [low[x:y].tobytes() for x, y in zip(first.tolist(), ends.tolist())]
        two = [two_low[x:y].tobytes() for x, y in zip(two_first.tolist(), two_ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(once, pa.binary()), pa.array(two, pa.binary())], names=["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, size = [], 0
        for batch in batches:
            h = batch.column("h").flatten().to_numpy()
            runs.append(h)
            size += len(h)
            if size >= RUN:
                yield added(runs)
                runs, size = [], 0
        if size:
            yield added(runs)

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of slice -> bits of each slice that two documents or more set, as longs; slices without one are left out."""

    def out() -> pa.RecordBatch:
        words = [np.packbits(x, bitorder="little").view(np.int64) for _, x in done]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["slice", "bits"])

    number, done, once, twice = None, [], None, None
    for batch in batches:
        for s, one, two in zip(*(c.to_pylist() for c in batch.columns)):
            if s != number:
                if number is not None and twice.any():
                    done.append((number, twice))
                if len(done) >= 64:
                    yield out()
                    done = []
                number, once, twice = s, np.zeros(1 << SLICE, bool), np.zeros(1 << SLICE, bool)
            at = np.frombuffer(one, np.uint16)
            twice[at] |= once[at]
            once[at] = True
            twice[np.frombuffer(two, np.uint16)] = True
    if number is not None and twice.any():
        done.append((number, twice))
    if done:
        yield out()


def _suspects(lines: DataFrame) -> DataFrame:
    """(h, g, doc) of the lines whose bits are all in the filter of bits seen twice."""
    n = lines.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = max(0, (n // LINES).bit_length())
    slices = lines.select("h").mapInArrow(_set_bits(bits), "slice long, once binary, twice binary").repartition("slice").sortWithinPartitions("slice")
    twice = written(slices.mapInArrow(_twice, "slice long, bits array<long>"), "lines-twice")
    each = lines.select("doc", F.explode(F.arrays_zip("h", "g")).alias("x")).select("doc", F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    each = each.withColumn("slice", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    probe = [F.shiftrightunsigned("h", SLICE * j).bitwiseAND(F.lit((1 << SLICE) - 1).cast("long")).cast("int") for j in range(PROBES)]
    hit = [F.getbit(F.get("bits", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1 for p in probe]
    found = each.join(F.broadcast(twice) if 1 << bits <= BROADCAST_SLICES else twice, "slice")
    out = written(found.where(hit[0] & hit[1] & hit[2]).select("h", "g", "doc"), "lines-suspect")
    discard(twice)
    return out


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc, drop): per document the digests of the lines that it loses; docs has doc and text."""
    lines = written(docs.mapInArrow(_line_rows(min_chars), "doc long, h array<long>, g array<long>"), "lines")
    suspects = _suspects(lines).distinct().withColumn("salt", F.pmod("doc", F.lit(SALTS)))
    # documents of a line are counted by share and then in all; its rows meet the result by share as well
    shares = suspects.groupBy("h", "g", "salt").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
    known = shares.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)
    goes = shares.select("h", "g", "salt").join(known.select("h", "g", "last"), ["h", "g"])
    out = suspects.join(goes, ["h", "g", "salt"]).where("doc <> last")
    out = written(out.groupBy("doc").agg(F.collect_list(F.struct("h", "g")).alias("drop")), "lines-dropped")
    discard(lines)
    return out


def _rewrite(min_chars: int):
    """Texts without the lines to drop: kept columns, n_lines, n_dropped, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("text", "drop")]
            drops = batch.column("drop")
            for a, b, buf, offs in t.pieces(t.texts_of(batch), 1 << 20):
                lines, gone, kept = [], [], []
                for i in range(a, b):
                    text = buf[offs[i - a] : offs[i - a + 1]].tobytes().decode()
                    n, left = text.count("\n") + 1, text
                    if drops[i].is_valid:
                        keys = keys_of(text, min_chars)
                        bad = set(np.stack([drops[i].values.field(j).to_numpy() for j in (0, 1)], axis=1).astype(np.int64).view("V16").ravel().tolist())
                        told = iter(digests([k for k in keys if k is not None]).view("V16").ravel().tolist())
                        stay = [line for line, k in zip(text.split("\n"), keys) if k is None or next(told) not in bad]
                        left = "\n".join(stay)
                        gone.append(n - len(stay))
                    else:
                        gone.append(0)
                    lines.append(n)
                    kept.append(left)
                cols = [batch.column(c).slice(a, b - a) for c in others] + [pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*others, "n_lines", "n_dropped", "kept"])

    return run


def _rewritten(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(carried, n_lines, n_dropped, kept) for docs (doc_id, text, carried)."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", "carried")
    drops = dropped_lines(rows.select("doc", "text"), min_docs, min_chars)
    out = T.StructType([f for f in rows.schema if f.name == "carried"] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")] + [T.StructField("kept", T.StringType())])
    return rows.join(drops, "doc", "left").select("carried", "text", "drop").mapInArrow(_rewrite(min_chars), out)


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of docs (doc_id, text).

    A line's key is the line without white space (x20, x09-x0D) at both ends, A-Z in lower case.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines except in the largest doc_id.  A null
    or empty text is one empty line; very long texts are taken whole.  Rows that repeat a doc_id count as one document and
    keep or lose a line together; a null doc_id is the largest, and rows without one are one document.  An empty table gives
    an empty one; other columns are not read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _rewritten(own.withColumn("carried", F.struct("doc_id")), min_docs, min_chars)
    return out.select("carried.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_common_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) with the lines cut that ``line_dedup`` drops; a null text stays null, every row stays."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns], F.col("text").isNull().alias("_null")).alias("carried"))
    out = _rewritten(own, min_docs, min_chars)
    return out.select(*[F.when(~F.col("carried._null"), F.col("kept")).alias(c) if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])
