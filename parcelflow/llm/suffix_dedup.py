"""Exact repeated substrings by distributed rank refinement over byte positions (prefix doubling on thinned positions).

Ranking every byte position at every doubling would shuffle each byte of the corpus many times.  Instead:

1. Positions are thinned to anchors: of the grams (GRAM bytes) inside any window of ``length`` bytes, the one with
   the least hash (leftmost on ties) is the window's anchor.  The choice depends on the window's bytes alone, so equal
   windows have equal anchors at equal offsets, and an anchor owns a run of window starts.
2. Every round sorts rows by a pair of ranks: that of the string which all windows of a row share (its core) and that of
   all bytes the row covers.  The first round takes an anchor's whole run, whose core is the gram.  All but the earliest
   row of a pair repeat entirely; a core with a single pair is unique, and neither goes on.
3. The earliest rows of a pair whose core has several pairs are cut into shorter runs of window starts, so that cores grow
   (32, 85, 97, 100 bytes for length 100), and are ranked again, until a row is a single window.
4. The runs found are merged per document and cut out.

Map tasks combine equal rows before every shuffle, so a passage that many documents share is sent once per task and
half a million rows.  Cores that a sample shows to be frequent are salted by the second rank; the sample decides only
where rows are sent.  Ranks are 64-bit hashes, and rows are equal only where both hashes of the pair are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import textops as t
from .spark_util import LAST, discard, identified, partitions, written

GRAM = 32
#: Lengths, in window starts, of the runs of the later rounds (those shorter than an anchor's longest run are used).
STEPS = (256, 64, 16, 4, 1)
SALTS = 64
#: A core is frequent from HEAVY_SHARE of a mean partition's rows on, and from HEAVY_LEAST rows on; both are estimated
#: from one document in HEAVY_SAMPLE.  At most partitions / HEAVY_SHARE cores can be frequent.
HEAVY_SAMPLE, HEAVY_SHARE, HEAVY_LEAST = 32, 0.25, 768
#: Rows that a map task combines at once.
COMBINED = 500_000
ID_LIMIT = 2_000_000
#: A row's place: first window start, its distance from the region's, number of windows, distance to the anchor.
AT_LO, AT_OFF, AT_N, AT_MOST = 32, 22, 11, 1023

_U64 = np.uint64
_ROWS = "k long, salt int, u long, doc long, tag long, at long"


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first owned start, number of owned starts, distance to the anchor, gram rank, region rank), starts in buf."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U64),) * 2
    if len(buf) < length:
        return none
    size = min(GRAM, length)
    prefix = t.prefix_hash(buf)
    at = np.arange(len(buf) - size + 1)
    gram = t.span_hash(prefix, at, at + size)
    keyed = (gram & _U64(0xFFFFFFFF00000000)) | at.astype(_U64)
    least = _least_in_windows(keyed, length - size + 1)
    anchor = (least & _U64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(least) + 1, np.int32)
    begin, end = offs[:-1], offs[1:] - length + 1
    whole = end > begin
    np.add.at(valid, begin[whole], 1)
    np.add.at(valid, end[whole], -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.ones(len(least), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    inner = begin[whole]
    change[inner[inner < len(change)]] = True
    first = np.flatnonzero(change)
    after = np.append(first[1:], len(least))
    keep = valid[first]
    first, after = first[keep], after[keep]
    text = np.searchsorted(offs, first, "right") - 1
    region = t.span_hash(prefix, first, after + length - 1)
    return text, first, after - first, anchor[first] - first, gram[anchor[first]], region


def _merged(row: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, given as (row, first window, number of windows) in order, joined where their bytes touch."""
    if not len(row):
        return row, lo, n
    far = lo + n + length - 1
    change = row[1:] != row[:-1]
    base = np.concatenate([[0], np.cumsum(change)]) * (int(far.max()) + 1)
    far = np.maximum.accumulate(far + base) - base
    cut = np.flatnonzero(change | (lo[1:] > far[:-1])) + 1
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
    return row[head], lo[head], far[tail] - lo[head] - length + 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if len(out) > 1 else True
    return out


def _run_start(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


class _Classes:
    """Rows of a map task: of equal strings those that can be the earliest are sent on, the others leave as finished runs."""

    def __init__(self, length: int, heavy: np.ndarray):
        self.length, self.heavy = length, heavy
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows, self.n_ids, self.size = [], [], 0, 0

    def add(self, doc, tag, row, k, u, lo, off, n, e) -> None:
        """doc, tag: of the texts; row: index of the text of every row."""
        self.ids.append((doc, tag))
        self.rows.append((row + self.n_ids, k, u, lo, off, n, e))
        self.n_ids += len(doc)
        self.size += len(k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        doc, tag = (np.concatenate(x) for x in zip(*self.ids))
        row, k, u, lo, off, n, e = (np.concatenate(x) for x in zip(*self.rows))
        self.clear()
        order = np.lexsort((tag, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(_changes(doc[order], tag[order])) - 1  # one text under one id: one rank
        who = np.empty(len(doc), np.int64)
        who[rank] = np.arange(len(doc))
        row = rank[row]
        order = np.lexsort(((row << 32) | lo, u))
        row, k, u, lo, off, n, e = (x[order] for x in (row, k, u, lo, off, n, e))
        new = _changes(k, u)
        own = new | _changes(row)
        again = ~(own | _changes(lo))  # the same place of the same text, from a repeated row
        late = (doc[who[row]] > doc[who[row[_run_start(new)]]]) | (lo > lo[_run_start(own)])
        done = np.flatnonzero(late)
        done = done[np.argsort((row[done] << 32) | lo[done], kind="stable")]
        r_row, r_lo, r_n = _merged(row[done], lo[done], n[done], self.length)
        keep = np.flatnonzero(~late & ~again)
        # Finished runs need no other row: they are spread over all partitions.
        spread = t.mix(tag[who[r_row]].view(_U64) * _U64(31) + r_lo.astype(_U64))
        salt = np.where(np.isin(k[keep], self.heavy), 1 + (u[keep] % _U64(SALTS)).astype(np.int64), 0) if len(self.heavy) else np.zeros(len(keep), np.int64)
        at = (lo << AT_LO) | (off << AT_OFF) | (n << AT_N) | e
        which = who[np.concatenate([row[keep], r_row])]
        cols = (
            np.concatenate([k[keep], spread]).view(np.int64), np.concatenate([salt, np.full(len(r_row), -1)]).astype(np.int32), np.concatenate([u[keep], spread]).view(np.int64),
            doc[which], tag[which], np.concatenate([at[keep], (r_lo << AT_LO) | r_n]),
        )
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "salt", "u", "doc", "tag", "at"])
        for i in range(0, out.num_rows, 100_000):
            yield out.slice(i, 100_000)


def _first_rows(length: int, heavy: np.ndarray):
    """The first round's rows: anchors with the whole run of windows they own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Classes(length, heavy)
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy() for c in ("doc", "tag"))
            for a, b, buf, offs in t.pieces(t.texts_of(batch)):
                text, first, n, e, gram, region = anchors(buf, offs, length)
                held.add(doc[a:b], tag[a:b], text, gram, region, first - offs[:-1][text], np.zeros(len(text), np.int64), n, e)
                if held.size > COMBINED:
                    yield from held.batches()
        yield from held.batches()

    return run


def _regions(length: int):
    """The bytes of the regions that go on, at ``todo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(c).to_numpy() for c in ("doc", "tag"))
            todo = batch.column("todo")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(todo.offsets)))
            places = todo.flatten().to_numpy()
            for a, b, buf, offs in t.pieces(t.texts_of(batch)):
                here = np.flatnonzero((row >= a) & (row < b))
                data, lo, n = buf.tobytes(), places[here] >> AT_LO, (places[here] >> AT_N) & 2047
                begin = offs[row[here] - a] + lo
                text = [data[x : x + m + length - 1] for x, m in zip(begin.tolist(), n.tolist())]
                for i in range(0, len(here), 20_000):
                    h = here[i : i + 20_000]
                    cols = [doc[row[h]], tag[row[h]], lo[i : i + 20_000], places[h]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(text[i : i + 20_000], pa.binary())], names=["doc", "tag", "lo", "at", "region"])

    return run


def _next_rows(length: int, size: int, core: int, heavy: np.ndarray):
    """The rows of a later round: runs of at most ``size`` windows, cut where the distance to the anchor is a multiple
    of ``size``, so that equal windows of different texts lie in runs of one number; cores are those of runs of ``core``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Classes(length, heavy)
        for batch in batches:
            for i in range(0, batch.num_rows, 3000):
                part = batch.slice(i, 3000)
                doc, tag, at = (part.column(c).to_numpy() for c in ("doc", "tag", "at"))
                region = part.column("region").cast(pa.large_binary())
                offs = np.frombuffer(region.buffers()[1], np.int64)[region.offset : region.offset + len(region) + 1]
                data = np.frombuffer(region.buffers()[2], np.uint8)[offs[0] : offs[-1]]
                offs = offs[:-1] - offs[0]
                prefix = t.prefix_hash(data)
                lo, off, n, e = at >> AT_LO, (at >> AT_OFF) & AT_MOST, (at >> AT_N) & 2047, at & 2047
                top, least = e // size, e - n + 1
                m = top - least // size + 1
                row = np.repeat(np.arange(len(m)), m)
                number = top[row] - (np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m))
                far, near = np.minimum(e[row], (number + 1) * size - 1), np.maximum(least[row], number * size)
                step, n = e[row] - far, far - near + 1
                lo, off = lo[row] + step, off[row] + step
                begin = offs[row] + off
                u = t.span_hash(prefix, begin, begin + n + length - 1)
                number = far // core
                mid = begin + far - number * core
                k = t.span_hash(prefix, mid, mid + length - core + 1)
                held.add(doc, tag, row, k, u, lo, off, n, far)
            if held.size > COMBINED:
                yield from held.batches()
        yield from held.batches()

    return run


def _frequent(rows: DataFrame) -> np.ndarray:
    """Sorted cores of a sample's rows that are frequent: at most partitions / HEAVY_SHARE of them."""
    drawn = written(rows.where("salt >= 0").select("k"), "suffix-sample")
    share = HEAVY_SHARE * drawn.count() / partitions(drawn.sparkSession)
    often = drawn.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= max(HEAVY_LEAST / HEAVY_SAMPLE, share))
    out = np.sort(np.array([r.k for r in often.select("k").collect()], np.int64).view(_U64))
    discard(drawn)
    return out


def _ranked(rows: DataFrame, length: int) -> DataFrame:
    """(doc, tag, at, a, b, repeats): rows that repeat earlier bytes [a, b) entirely, and those that go on."""
    pair = W.partitionBy("k", "salt", "u").orderBy("doc", "tag", "at")
    own = W.partitionBy("k", "salt", "u", "doc", "tag").orderBy("at")
    core = W.partitionBy("k", "salt")
    done = F.col("salt") < 0
    repeats = done | (F.first("doc").over(pair) < F.col("doc")) | (F.rank().over(own) > 1)
    several = (F.col("salt") > 0) | (F.min("u").over(core) != F.max("u").over(core))
    n = F.when(done, F.col("at").bitwiseAND((1 << AT_LO) - 1)).otherwise(F.shiftright("at", AT_N).bitwiseAND(2047))
    marked = rows.repartition("k", "salt").select("doc", "tag", "at", F.shiftright("at", AT_LO).alias("a"), n.alias("n"), repeats.alias("repeats"), several.alias("several"))
    return marked.where("repeats OR several").select("doc", "tag", "at", "a", (F.col("a") + F.col("n") + F.lit(length - 1)).alias("b"), "repeats")


def _texts(docs: DataFrame) -> DataFrame:
    return identified(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc", "tag", "text")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, tag, spans) with the byte runs [a, b) that repeat earlier bytes, for texts that have any; written.

    doc and tag are those of ``identified``.  Spans may overlap or touch; ``cut`` merges them."""
    longest = length - min(GRAM, length) + 1
    if longest > AT_MOST:
        raise ValueError(f"length is at most {AT_MOST + GRAM - 1}")
    texts = _texts(docs)
    drawn = lambda df: df.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(HEAVY_SAMPLE)) == 0)
    heavy = _frequent(drawn(texts).mapInArrow(_first_rows(length, np.zeros(0, _U64)), _ROWS))
    marked = written(_ranked(texts.mapInArrow(_first_rows(length, heavy), _ROWS), length), "suffix-ranked")
    rounds = [marked]
    todo = marked.where("NOT repeats").groupBy("doc", "tag").agg(F.collect_set("at").alias("todo"))
    todo = written(todo, "suffix-todo")
    regions = written(_narrowed(texts, todo, "tag").join(todo, ["doc", "tag"]).mapInArrow(_regions(length), "doc long, tag long, lo long, at long, region binary"), "suffix-regions")
    discard(todo)
    steps = [s for s in STEPS if s < longest]
    pieces = regions.drop("lo")
    for i, size in enumerate(steps):
        # A single window has no shorter core of its own: it keeps the last one.
        core = steps[i - 1] if size == 1 and i else size
        heavy = _frequent(drawn(pieces).mapInArrow(_next_rows(length, size, core, np.zeros(0, _U64)), _ROWS))
        marked = written(_ranked(pieces.mapInArrow(_next_rows(length, size, core, heavy), _ROWS), length), "suffix-ranked")
        rounds.append(marked)
        lo = F.shiftright("at", AT_LO) - F.shiftright("at", AT_OFF).bitwiseAND(AT_MOST)
        live = marked.where("NOT repeats").select("doc", "tag", lo.alias("lo"), "at").distinct()
        pieces = regions.drop("at").join(live, ["doc", "tag", "lo"]).select("doc", "tag", "at", "region")
    found = [r.where("repeats").select("doc", "tag", "a", "b") for r in rounds]
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = written(spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")
    discard(regions, *rounds)
    return spans


def _narrowed(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows that can meet the written table ``side``, told before the shuffle where its keys are few enough to broadcast
    (at most ID_LIMIT); else all rows, and the join itself tells."""
    return rows.join(F.broadcast(side.select(key)), key, "left_semi") if side.count() <= ID_LIMIT else rows


def cut(data: np.ndarray, spans) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, number of maximal removed runs)."""
    if not spans:
        return data.tobytes(), 0, 0
    delta = np.zeros(len(data) + 1, np.int32)
    np.add.at(delta, [s["a"] for s in spans], 1)
    np.add.at(delta, [s["b"] for s in spans], -1)
    gone = np.cumsum(delta[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return data[~gone].tobytes(), int(gone.sum()), runs


def _cut_texts(last: str):
    """Columns of the input without text, tag and spans, with n_bytes, n_removed, n_spans and the digest or the text left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans") if "spans" in batch.schema.names else None
            kept = [c for c in batch.schema.names if c not in ("text", "tag", "spans")]
            for a, b, buf, offs in t.pieces(t.texts_of(batch)):
                out = []
                for i in range(a, b):
                    left, removed, runs = cut(buf[offs[i - a] : offs[i - a + 1]], spans[i].as_py() if spans is not None else None)
                    out.append((int(offs[i - a + 1] - offs[i - a]), removed, runs, hashlib.sha256(left).hexdigest() if last == "kept_sha256" else left.decode("utf-8", "ignore")))
                cols = [pa.array([x[j] for x in out], pa.int64()) for j in range(3)] + [pa.array([x[3] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + cols, names=[*kept, "n_bytes", "n_removed", "n_spans", last])

    return run


def _cut(docs: DataFrame, length: int, last: str) -> DataFrame:
    """(doc, carried, n_bytes, n_removed, n_spans, last) for docs (doc_id, text, carried)."""
    spans = repeated_spans(docs, length)
    rows = identified(docs).drop("doc_id")
    kept = [f for f in rows.schema if f.name not in ("text", "tag")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField(last, T.StringType())])
    if spans.count() > ID_LIMIT:
        return rows.join(spans, ["doc", "tag"], "left").select(*names, "text", "spans").mapInArrow(_cut_texts(last), schema)
    ids = F.broadcast(spans.select("tag"))
    hit = rows.join(ids, "tag", "left_semi").join(spans, ["doc", "tag"], "left").select(*names, "text", "spans").mapInArrow(_cut_texts(last), schema)
    return hit.unionByName(rows.join(ids, "tag", "left_anti").select(*names, "text").mapInArrow(_cut_texts(last), schema))


def suffix_dedup(docs: DataFrame, length: int = 100, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 or, with texts, text) for every row of docs (doc_id, text).

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same row.  Null texts are empty; texts shorter than ``length`` lose nothing; very long texts are taken whole.  A null
    doc_id counts as the largest.  Of rows with one doc_id (or none) no row counts as earlier than another, whether their
    texts are equal or not.  With texts, characters that a cut splits are dropped whole."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _cut(own, length, "text" if texts else "kept_sha256")
    return out.withColumn("doc", F.nullif(F.col("doc"), F.lit(LAST))).withColumnRenamed("doc", "doc_id")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) with cut texts, rows that lost all their bytes being dropped; the rules are those of ``suffix_dedup``."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("carried"))
    out = _cut(own, length, "left").where("n_removed = 0 OR n_removed < n_bytes")
    return out.select(*[F.col("left").alias("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])
