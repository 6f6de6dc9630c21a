"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over whole documents.

The benchmark's windows are counted first.  They are broadcast in blocks of at most BLOCK_WINDOWS, so what a
task holds is bounded however large the benchmark is; documents are scanned once for each block and the
blocks' hits are merged per row, by the rows' numbers in a written table.  Every hash hit is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as t
from .spark_util import discard, with_text, written

WINDOW = 10
BLOCK_WINDOWS = 500_000
#: Words after A-Z became a-z: everything but control characters, punctuation and space of ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, n, items): each distinct window of the items with the ids (as text) of the items that hold it."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("n", F.least(F.size("ws"), F.lit(window)))
    each = items.select("item", "n", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)).alias("i"))
    return each.select("item", "n", F.array_join(F.slice("ws", F.col("i"), F.col("n")), " ").alias("words")).groupBy("words", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Windows:
    """One block of windows, by length: sorted hashes, texts to verify against, item ids."""

    def __init__(self, rows):
        self.by_n = {}
        for n in sorted({r.n for r in rows}):
            own = [r for r in rows if r.n == n]
            hashes = np.concatenate([t.chain(t.word_hashes(buf, offs, t.ALNUM)[0].reshape(-1, n).ravel(), n)[::n] for _, _, buf, offs in t.pieces(pa.array([r.words for r in own]))])
            order = np.argsort(hashes, kind="stable")
            self.by_n[n] = hashes[order], [own[i].words.encode() for i in order], [own[i].items for i in order]


def _scan(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = windows.value.by_n
        for batch in batches:
            n_words, hit_words, items = [], [], []
            for a, b, buf, offs in t.pieces(t.texts_of(batch)):
                low = t.LOWER[buf]
                starts, ends, first = t.words(low, offs, t.ALNUM)
                hashes = t.hash_runs(low, starts, ends)
                n_words += np.diff(first).tolist()
                hits: list[set[int]] = [set() for _ in range(b - a)]
                found: list[set[str]] = [set() for _ in range(b - a)]
                for n, (known, words, ids) in table.items():
                    run_of = t.chain(hashes, n)
                    if not len(run_of):
                        continue
                    at = np.searchsorted(known, run_of)
                    at[at == len(known)] = 0
                    for i in np.flatnonzero(known[at] == run_of).tolist():
                        d = int(np.searchsorted(first, i, "right")) - 1
                        if i + n > first[d + 1]:
                            continue
                        own = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + n))
                        k = int(at[i])
                        while k < len(known) and known[k] == run_of[i]:
                            if words[k] == own:
                                hits[d].update(range(i - first[d], i - first[d] + n))
                                found[d].update(x for x in ids[k] if x is not None)
                            k += 1
                hit_words += [sorted(h) for h in hits]
                items += [sorted(f) for f in found]
            cols = [pa.array(n_words, pa.int64()), pa.array(hit_words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + cols, names=[batch.schema.names[i] for i in kept] + ["n_words", "hit_words", "items"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words at ``hit_words`` (null: none)."""
    for batch in batches:
        hits, texts = batch.column("hit_words"), []
        for a, b, buf, offs in t.pieces(t.texts_of(batch)):
            starts, ends, first = t.words(t.LOWER[buf], offs, t.ALNUM)
            for d in range(b - a):
                data = buf[offs[d] : offs[d + 1]]
                gone = hits[a + d].as_py()
                if gone:
                    keep = np.ones(len(data), bool)
                    for j in gone:
                        w = first[d] + j
                        keep[starts[w] - offs[d] : ends[w] - offs[d]] = False
                    data = data[keep]
                texts.append(data.tobytes().decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


_FOUND = "n_words long, hit_words array<int>, items array<string>"


ROW = "_benchmark_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for every row, written, so that a row keeps it however often it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "benchmark-rows")


def _hits(numbered: DataFrame, wins: DataFrame, blocks: int) -> DataFrame:
    """(row, doc_id, n_words, hit_words, items) of every row, merged over the blocks of windows."""
    out = None
    for k in range(blocks):
        rows = wins.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()
        part = with_text(numbered, F.col(ROW).alias("row")).select("row", "doc_id", "text").mapInArrow(_scan(numbered.sparkSession.sparkContext.broadcast(_Windows(rows))), f"row long, doc_id long, {_FOUND}")
        out = part if out is None else out.unionByName(part)
    if blocks == 1:
        return out
    merged = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_words")).alias("h"), F.flatten(F.collect_list("items")).alias("i"))
    return merged.select("row", "doc_id", "n_words", F.array_distinct("h").alias("hit_words"), F.array_distinct("i").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, hit_words, items): positions of the words that lie in a benchmark window, and the items' ids."""
    wins = benchmark_windows(benchmark, window)
    blocks = max(1, -(-wins.count() // block))
    if blocks == 1:
        return with_text(docs).mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(_Windows(wins.collect()))), f"doc_id long, {_FOUND}")
    return _hits(_numbered(with_text(docs)), wins, blocks).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text).

    Null or empty texts have no words; an item without words has no window; an item with a null id hits but is not
    counted or listed."""
    ids = F.array_join(F.sort_array("items"), ",")
    return scan(docs, benchmark, window, block).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without the rows that hold a benchmark window, told block by block in the scan itself; with ``spans``, (doc_id, text) of all rows without the hit words,
    which are those of the original text for all blocks of windows."""
    wins = written(benchmark_windows(benchmark, window), "benchmark-windows")
    blocks = max(1, -(-wins.count() // block))
    if spans:
        numbered = _numbered(with_text(docs))
        found = _hits(numbered, wins, blocks).where(F.size("hit_words") > 0).select(F.col("row").alias("_hit_row"), "hit_words")
        return numbered.join(found, F.col(ROW) == F.col("_hit_row"), "left").select("doc_id", "text", "hit_words").mapInArrow(_without, "doc_id long, text string")
    clean = docs
    for k in range(blocks):  # one block is in the driver and on the executors at a time; a row goes where it is read
        held = docs.sparkSession.sparkContext.broadcast(_Windows(wins.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()))
        rows = clean.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("carried"))
        out = T.StructType([rows.schema["carried"], *T._parse_datatype_string(_FOUND).fields])
        left = rows.mapInArrow(_scan(held), out).where(F.size("hit_words") == 0).select(*[F.col("carried")[c].alias(c) for c in docs.columns])
        if k + 1 < blocks:
            left = written(left, "benchmark-clean")
            held.unpersist()
        if k and k + 1 < blocks:
            discard(clean)
        clean = left
    discard(wins)
    return clean
