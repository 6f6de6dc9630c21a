"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit hashes) and a 64-coordinate
   MinHash signature.  Rows with equal sets form one class, which has a number of its own, so that null and repeated
   doc_ids do no harm; one row stands for it.
2. Each class is posted under its (coordinate, value) pairs.  Prefix merging: a pair that agrees in
   T of K coordinates shares at least one of the K - T + 1 coordinates that are rarest for either side,
   so only those are posted; coordinates that nobody shares use up the prefix without being posted.
3. Posting lists are merged: collisions over the whole signature are counted for the members of a list, other
   coordinates being skipped until then, and pairs with at least T stay.  Only a spanning star of what agrees leaves the
   task, never all pairs of a list.
4. Groups of candidates are confirmed on full shingle sets with integer arithmetic, again returning a spanning star of
   the confirmed links; their connected components are the answer.

Lists and groups beyond a bound are cut into blocks.  First every block meets a few centres of the whole list, which
joins most of it into one component; then only the members outside the largest component, each of which may still be
linked to any other, meet all blocks.  Pairs within one component need no comparison, so no link is lost, and a large
group of near copies costs its size times the number of centres instead of its square.

A pair with similarity 0.75 agrees in fewer than 32 of 64 coordinates with probability about 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as t
from .components import components
from .spark_util import LAST, discard, identified, partitions, with_text, written

SHINGLE = 5
K, AGREE = 64, 32
#: Members and shingles of a block (a member counts as SET_BLOCK / POSTING_BLOCK shingles at least), centres of a large group.
POSTING_BLOCK, SET_BLOCK = 1024, 1 << 18
CENTRES = 8
ID_LIMIT = 2_000_000

_U64 = np.uint64
_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) * _U64(2) + _U64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    for a, b, buf, offs in t.pieces(texts):
        hashes, first = t.word_hashes(buf, offs, t.NON_SPACE)
        runs = t.chain(hashes, shingle)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= shingle:
                yield np.unique(runs[lo : hi - shingle + 1])
            elif hi > lo:
                yield t.mix(t.chain(hashes[lo:hi], hi - lo) + _U64(hi - lo))
            else:
                yield np.zeros(0, _U64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of K coordinates for each set: the least value of each hash function over it (0 for an empty set)."""
    size = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), K), np.uint32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    values = np.concatenate(sets)
    starts = (np.cumsum(size) - size)[full]
    hashed = np.empty_like(values)
    for c in range(K):
        np.multiply(values, _MUL[c], out=hashed)
        out[full, c] = np.minimum.reduceat(hashed, starts) >> _U64(32)
    return out


_SKETCH = "doc long, tag long, n_shingles long, s1 long, s2 long, sig array<int>, short binary"


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sig, held, size = [], [], [], [np.zeros((0, K), np.uint32)], [], 0
            for values in shingle_sets(t.texts_of(batch), shingle):
                n.append(len(values))
                s1.append(int(values.sum(dtype=_U64)))
                s2.append(int(t.mix(values).sum(dtype=_U64)))
                held.append(values)
                size += len(values)
                if size > 50_000:
                    sig.append(signatures(held))
                    held, size = [], 0
            sig = np.concatenate([*sig, signatures(held)])
            rows = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, K, dtype=np.int32), pa.array(sig.view(np.int32).ravel()))
            short = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
            columns = [batch.column("doc"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(np.array(s1, _U64).view(np.int64)), pa.array(np.array(s2, _U64).view(np.int64)), rows, short]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "n_shingles", "s1", "s2", "sig", "short"])

    return run


def _stars(match: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars (least id, other id) of the graph with this adjacency matrix."""
    left, out = np.ones(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            reach = match[front].any(axis=0) & left
            front = np.flatnonzero(reach)
            left[front] = False
            out += [(int(ids[i]), int(ids[x])) for x in front]
            front = list(front)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted input, also where a run spans batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == c[0] for k, c in zip(keys, cols)):
            held.append(batch.slice(0, edges[1]))
            edges = edges[1:]
            if len(edges) == 1:
                continue
        if held:
            yield pa.Table.from_batches(held)
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(edges[-2], edges[-1] - edges[-2])]
    if held:
        yield pa.Table.from_batches(held)


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _agreeing(percent: int):
    """Whether rows of a posting list agree in enough coordinates and are near enough in size: (rows, rows) booleans."""

    def match(group: pa.Table) -> np.ndarray:
        n = group.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(-1, K)
        if len(n) <= 16:
            hits = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
        else:
            hits = np.zeros((len(n), len(n)), np.uint8)
            for c in range(K):
                hits += sig[:, c][:, None] == sig[:, c][None, :]
        return (hits >= AGREE) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))

    return match


def _similar(percent: int):
    """Whether full sets are similar enough: (rows, rows) booleans."""

    def match(group: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, _U64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            inter = np.array([[size[0], both], [both, size[1]]])
        else:
            _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), size)
            shared = n[col] > 1
            back = np.cumsum(n > 1) - 1
            row, col = row[shared], back[col[shared]]
            inter = np.zeros((len(sets), len(sets)), np.int64)
            for lo in range(0, int((n > 1).sum()), 8192):  # columns in slices: exact counts below 2^24 in float32
                here = (col >= lo) & (col < lo + 8192)
                dense = np.zeros((len(sets), 8192), np.float32)
                dense[row[here], col[here] - lo] = 1
                inter += (dense @ dense.T).astype(np.int64)
        return 100 * inter >= percent * (size[:, None] + size[None, :] - inter)

    return match


def _stars_of_groups(match, crossed: bool):
    """Spanning stars of every run of rows with one (grp, block, part): of all its pairs, or, if crossed, of those that have a
    row with ``met``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for group in _grouped(batches, ("grp", "block", "part")):
            if group.num_rows < 2:
                continue
            ids, ok = group.column("cls").to_numpy(), match(group)
            if crossed:
                met = group.column("met").to_numpy() > 0
                ok &= met[:, None] | met[None, :]
            if len(ids) == 2:
                if ok[0, 1] and ids[0] != ids[1]:
                    found.add((int(ids.min()), int(ids.max())))
            else:
                found.update(_stars(ok, ids))
            if len(found) >= 20_000:
                yield _links_batch(list(found))
                found.clear()
        yield _links_batch(list(found))

    return run


def _linked(rows: DataFrame, limit: int, match, payload: list[str], label: str) -> DataFrame:
    """Components (node, component) of the graph that links matching rows of a group.

    rows: (grp, cls, weight, total, payload), total being the weight of the group or more.  Groups up to the limit are
    compared whole.  Larger ones: every block with CENTRES centres, then every block with the members outside the group's
    largest component, in parts of the limit."""
    n = partitions(rows.sparkSession)

    def links(df: DataFrame, crossed: bool) -> DataFrame:
        df = df.select("grp", "block", "part", "cls", *(["met"] if crossed else []), *payload)
        return df.repartition(n, "grp", "block", "part").sortWithinPartitions("grp", "block", "part").mapInArrow(_stars_of_groups(match, crossed), "a long, b long")

    def dealt(total: str, name: str, seed: int):
        return F.pmod(F.xxhash64("cls", F.lit(seed)), F.ceil(F.col(total) / limit)).cast("int").alias(name)

    zero, no, yes = F.lit(0), F.lit(0).alias("met"), F.lit(1).alias("met")
    every_of = lambda total: F.explode(F.sequence(zero, F.ceil(F.col(total) / limit).cast("int") - 1))
    found = links(rows.where(F.col("total") <= limit).select("grp", zero.alias("block"), zero.alias("part"), "cls", *payload), False)
    hot = rows.where(F.col("total") > limit).select("grp", "cls", "weight", "total", dealt("total", "block", 1), *payload)
    hot = written(hot, f"{label}-large")
    if hot.isEmpty():
        discard(hot)
        return components(found, label)
    bucket = F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(CENTRES))
    chosen = hot.groupBy("grp", bucket.alias("bucket")).agg(F.min(F.struct(F.xxhash64("cls", F.lit(3)).alias("h"), F.col("cls"))).alias("m")).select("grp", "m.cls")
    centres = hot.join(chosen, ["grp", "cls"], "left_semi")
    centres = centres.select("grp", every_of("total").alias("block"), zero.alias("part"), "cls", yes, *payload)
    met = links(hot.select("grp", "block", zero.alias("part"), "cls", no, *payload).unionByName(centres), True)
    found = written(found.unionByName(met), f"{label}-first")
    known = components(found, f"{label}-first")
    named = hot.select("grp", "cls", "weight").join(known.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    size = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = size.groupBy("grp").agg(F.max(F.struct("c", "component")).alias("l")).select("grp", F.col("l.component").alias("largest"))
    rest = written(named.join(largest, "grp").where("component != largest").select("grp", "cls", "weight"), f"{label}-rest")
    if rest.isEmpty():
        discard(hot, found, rest)
        return known
    left = rest.groupBy("grp").agg(F.sum("weight").alias("rest"))
    outside = hot.join(rest.select("grp", "cls"), ["grp", "cls"]).join(left, "grp")
    outside = outside.select("grp", every_of("total").alias("block"), dealt("rest", "part", 4), "cls", yes, *payload)
    every = hot.join(left, "grp").select("grp", "block", every_of("rest").alias("part"), "cls", no, *payload)
    second = written(links(every.unionByName(outside), True), f"{label}-second")
    out = known if second.isEmpty() else components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), label)
    discard(hot, found, rest, second)
    return out


def _member_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(t.texts_of(batch), shingle)]
            kept = [c for c in batch.schema.names if c != "text"]
            for a in range(0, len(sets), 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(sets[a : a + 500], pa.binary())], names=[*kept, "shingles"])

    return run


def _classified(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc, tag, n_shingles, first) for every row: first is (doc, tag) of the first row of its component (null: no shingles)."""
    texts = identified(with_text(docs)).select("doc", "tag", "text")
    sketches = written(texts.mapInArrow(_sketch(shingle), _SKETCH), "near-sketches")
    full = sketches.where("n_shingles > 0")
    classes = full.groupBy("n_shingles", "s1", "s2").agg(F.min(F.struct("doc", "tag")).alias("rep"), F.first("sig").alias("sig"), F.first("short").alias("short"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")

    rows = classes.select("cls", F.posexplode("sig").alias("c", "v")).select("cls", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v")).alias("key"))
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(lists, "key")
    rank = W.partitionBy("cls").orderBy("df", "key")
    prefix = K - AGREE + 1
    ranked = shared.withColumns({"rank": F.row_number().over(rank), "n_shared": F.count(F.lit(1)).over(W.partitionBy("cls"))})
    postings = ranked.where(F.col("rank") <= prefix - (K - F.col("n_shared"))).select("cls", "key", "df")
    postings = written(postings.select(F.col("key").alias("grp"), "cls", F.lit(1).alias("weight"), F.col("df").alias("total")), "near-postings")
    listed = postings.join(classes.select("cls", "n_shingles", "short"), "cls")
    clusters = _linked(listed, POSTING_BLOCK, _agreeing(percent), ["n_shingles", "short"], "near-candidates")
    weight = F.greatest("n_shingles", F.lit(max(1, SET_BLOCK // POSTING_BLOCK)))
    members = clusters.join(classes.select(F.col("cls").alias("node"), weight.alias("weight"), "rep"), "node").select("rep.doc", "rep.tag", F.col("node").alias("cls"), F.col("component").alias("grp"), "weight")
    alone = written(members, "near-members")
    totals = alone.groupBy("grp").agg(F.sum("weight").alias("total"))
    members = written(alone.join(totals, "grp"), "near-groups")
    sets = texts.join(F.broadcast(members) if members.count() <= ID_LIMIT else members, ["doc", "tag"])
    # The row that stands for a class may itself be repeated: one of its equal copies is enough.
    sets = sets.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("text", "grp", "weight", "total")]).select("grp", "cls", "weight", "total", "text")
    sets = written(sets.mapInArrow(_member_sets(shingle), "grp long, cls long, weight long, total long, shingles binary"), "near-sets")
    found = _linked(sets, SET_BLOCK, _similar(percent), ["shingles"], "near-links")
    named = classes.select("n_shingles", "s1", "s2", "cls", "rep").join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    firsts = named.groupBy("component").agg(F.min("rep").alias("first"))
    named = written(named.join(firsts, "component").select("n_shingles", "s1", "s2", "first"), "near-named")
    discard(classes, postings, alone, members, sets)
    # A class may hold a third of all rows: nothing above this join needs them together, so its rows can be split.
    out = full.select("doc", "tag", "n_shingles", "s1", "s2").join(named, ["n_shingles", "s1", "s2"]).select("doc", "tag", "n_shingles", "first")
    return out.unionByName(sketches.where("n_shingles = 0").select("doc", "tag", "n_shingles", F.lit(None).cast("struct<doc: bigint, tag: bigint>").alias("first")))


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Rows whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id of
    the connected component.  Null or word-less texts have no shingles and no links; very long texts are taken whole.
    Rows of one doc_id are linked by their own texts, whether equal or not, and each appears in the result.  A null doc_id
    counts as the largest: such rows get the component's smallest doc_id if it has one, and kept = false.  Shingles are
    told apart by 64-bit hashes.  The signature settings assume percent >= 75."""
    rows = _classified(docs, percent, shingle)
    doc, first = F.nullif("doc", F.lit(LAST)), F.coalesce("first.doc", "doc")
    out = rows.select(doc.alias("doc_id"), "n_shingles", F.nullif(first, F.lit(LAST)).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, of several the one of the smallest text hash.

    Rows without shingles stay.  Also where ids are null or repeated one row of each group stays."""
    rows = written(_classified(docs, percent, shingle).select(F.col("doc").alias("_near_doc"), F.col("tag").alias("_near_tag"), "first"), "near-rows")
    own = identified(docs.withColumnRenamed("doc", "_near_own_doc").withColumnRenamed("tag", "_near_own_tag"))
    own = own.withColumnRenamed("doc", "_near_doc").withColumnRenamed("tag", "_near_tag")
    for c in ("doc", "tag"):
        own = own.withColumnRenamed(f"_near_own_{c}", c)
    key = ["_near_doc", "_near_tag"]
    other = (F.col("first.doc") != F.col("_near_doc")) | (F.col("first.tag") != F.col("_near_tag"))
    kept = own.join(rows.where(other).select(*key).distinct(), key, "left_anti")
    again = written(rows.where(~other).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "near-again")
    if not again.isEmpty():  # equal rows under one id: one of them
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)
