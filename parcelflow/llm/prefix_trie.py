"""Prefix trie of conversations, from whole sequences instead of turn by turn.

A turn is a 128-bit digest of role and text; a prefix is told by the XOR of its turns' digests, each mixed with its place,
so that prefix digests are running aggregates.  Identical conversations collapse into one weighted sequence; sequences
that are proper prefixes of others are told by an anti-join, the rest are leaves.  Every node is then one group of the
sequences' prefixes, and what its subtree holds follows from sums over those sequences:

    turns' characters over members  =  sum of weight * characters of the sequence  -  members * characters before the node
    turns' characters over nodes    =  those of the node's owner (its smallest sequence)  +  what each other sequence owns

where a sequence owns the prefixes that no smaller sequence has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import discard, written

#: Turns of a conversation that one task holds together; shares into which the sequences of a node are dealt; ids joined in one string.
BLOCK, SALTS, IDS = 1024, 32, 1024
NODE = ["x", "y", "depth"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, x, y, chars): turns in order within each range partition of all turns; long conversations are cut.

    Turns are ordered by turn (null first), then role, then the text's MD5 digest; rows equal in all of these are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text).alias("md5"), F.length(text).cast("long").alias("chars"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "md5", "row").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "md5", "row")
    at = F.monotonically_increasing_id()
    rows = rows.select("conv_id", F.xxhash64("role", "md5").alias("x"), F.xxhash64("md5", F.lit(1), "role").alias("y"), "chars", at.alias("at"))
    return written(rows.withColumn("part", F.shiftright("at", 33)), "trie-turns")


def _heads_by_crc(conv: Column) -> Column:
    """Turns that a conversation takes from the first one of its hundred: crc32 of its number modulo 6."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)).cast("long")


def rebuilt_turns(conversations: DataFrame, share: int = 100, longest_head: int = 5) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((conv_id, n), turns (conv_id, n, depth, x, y, chars), tables that they read) of the rebuilt conversations: the first h
    turns of the first conversation of each ``share``, then the own turns after the first h."""
    turns = numbered_turns(conversations)
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("many"))
    order = Window.partitionBy("conv_id").orderBy("part")
    whole = Window.partitionBy("conv_id")
    parts = written(parts.select("conv_id", "part", "start", (F.sum("many").over(order) - F.col("many")).alias("before"), F.sum("many").over(whole).alias("own")), "trie-parts")
    place = (F.col("at") - F.col("start") + F.col("before")).alias("place")
    first = f"conv_id % {share} = 0"
    heads = turns.where(first).join(parts.where(first).where(F.col("before") < longest_head), ["conv_id", "part"]).select(F.col("conv_id").alias("base"), place, "x", "y", "chars")
    heads = heads.where(F.col("place") < longest_head).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "chars"))).alias("head"))
    conv = F.col("conv_id")
    infos = parts.withColumns({"base": conv - conv % share, "h": _heads_by_crc(conv)}).join(heads, "base", "left")
    infos = infos.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)))
    infos = infos.withColumn("taken", F.size("head").cast("long")).withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    infos = written(infos.drop("base"), "trie-parts")
    own = turns.join(infos.drop("head"), ["conv_id", "part"]).where(place >= F.col("h"))
    own = own.select("conv_id", "n", (place - F.col("h") + F.col("taken") + 1).alias("depth"), "x", "y", "chars")
    once = infos.where("before = 0")
    head = once.select("conv_id", "n", F.explode("head").alias("t")).select("conv_id", "n", (F.col("t.place") + 1).alias("depth"), "t.x", "t.y", "t.chars")
    discard(parts)
    return once.select("conv_id", "n"), head.unionByName(own), [turns, infos]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, n, depth, x, y, px, py, chars, upto): digest of every prefix, of the one before, characters of the last turn and up to it."""
    mixed = turns.withColumns({"x": F.xxhash64("x", "depth"), "y": F.xxhash64("y", "depth", F.lit(2)), "block": F.expr(f"(depth - 1) DIV {BLOCK}")})
    # conversations of more than one block: what stands before each block
    long_ones = mixed.where(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("chars").alias("bc"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = long_ones.select("conv_id", "block", *[F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "bx"), (F.bit_xor, "by"), (F.sum, "bc"))])
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = mixed.withColumns({"rx": F.bit_xor("x").over(run), "ry": F.bit_xor("y").over(run), "upto": F.sum("chars").over(run)})
    out = out.join(carry, ["conv_id", "block"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({"rx": F.col("rx").bitwiseXOR(zero("bx")), "ry": F.col("ry").bitwiseXOR(zero("by")), "upto": F.col("upto") + zero("bc")})
    return out.select("conv_id", "block", "n", "depth", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rx").bitwiseXOR(F.col("x")).alias("px"), F.col("ry").bitwiseXOR(F.col("y")).alias("py"), "chars", "upto")


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (node, part) -> SHA-256 of each node's parts, joined by commas; one part is held at a time."""

    def out() -> pa.RecordBatch:
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    key, digest, done = None, None, []
    for batch in batches:
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                if len(done) >= 10_000:
                    yield out()
                    done = []
                key, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if key:
        done.append((*key, digest.hexdigest()))
    if done:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256) of ends (conv_id, x, y, depth): a list's digest is one pass over it by definition, so ids
    are joined part by part first."""
    parts = ends.withColumn("part", F.expr(f"(conv_id - pmod(conv_id, {IDS})) DIV {IDS}"))
    parts = parts.groupBy(*NODE, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(_list_digests, "x long, y long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty; rows without conv_id take no part.  Turns are ordered by turn, null first; turns of one
    number by role and then by the text's MD5 digest, and repeated rows are turns of their own.  Very long texts and
    conversations are taken whole.  A conversation left without turns is a member of the root.  An empty table has no nodes;
    other columns are not read."""
    convs, turns, read = rebuilt_turns(conversations)
    steps = written(prefixes(turns), "trie-prefixes")
    zero = F.lit(0).cast("long")
    last = steps.where("depth = n").select("conv_id", "x", "y", "depth", "upto")
    last = written(last.unionByName(convs.where("n = 0").select("conv_id", zero.alias("x"), zero.alias("y"), zero.alias("depth"), zero.alias("upto"))), "trie-last")
    discard(*read)
    sequences = last.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("upto").alias("total"))
    # sequences that are proper prefixes of others are no leaves
    inner = steps.where("depth < n").select(*NODE).distinct()
    some = steps.where("n > 0").select(zero.alias("x"), zero.alias("y"), zero.alias("depth")).limit(1)
    whole = written(sequences, "trie-sequences")
    leaves = whole.join(inner.unionByName(some), NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    sequences = written(whole.join(leaves, "conv_id", "left").select("conv_id", F.col("depth").alias("n"), "weight", "total", F.coalesce("leaf", zero).alias("leaf")), "trie-weighted")
    discard(whole)
    # prefixes of every sequence, block by block, and the root of each
    blocks = sequences.select("conv_id", F.explode(F.sequence(zero, F.expr(f"greatest(n - 1, 0) DIV {BLOCK}"))).alias("block"), "weight", "total", "leaf")
    none = {"depth": zero, "x": zero, "y": zero, "px": zero, "py": zero, "chars": zero, "upto": zero, "block": zero}
    path = steps.drop("n").join(blocks, ["conv_id", "block"]).unionByName(sequences.drop("n").withColumns(none))
    path = written(path.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))), "trie-paths")
    discard(steps, sequences)
    shares = path.groupBy(*NODE, "salt").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("total")).alias("over"),
        F.first("px").alias("px"), F.first("py").alias("py"), F.first("chars").alias("chars"), F.first("upto").alias("upto"),
    )
    shares = written(shares, "trie-shares")
    nodes = shares.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "over")], *[F.first(c).alias(c) for c in ("px", "py", "chars", "upto")],
    )
    nodes = written(nodes, "trie-nodes")
    # owner of every prefix of every sequence
    owner = shares.select(*NODE, "salt").join(nodes.select(*NODE, F.col("conv_id").alias("owner")), NODE)
    owned = written(path.select("conv_id", "block", *NODE, "salt", "upto", "total").join(owner, [*NODE, "salt"]), "trie-owned")
    discard(path, shares)
    guests = owned.where("owner <> conv_id")
    adds = guests.groupBy("conv_id").agg(F.max("depth").alias("to"), F.max("upto").alias("shared"), F.first("total").alias("total"))
    adds = adds.select("conv_id", F.explode(F.sequence(zero, F.expr(f"greatest(to - 1, 0) DIV {BLOCK}"))).alias("block"), (F.col("total") - F.col("shared")).alias("adds"))
    guests = guests.select("conv_id", "block", *NODE, "salt").join(adds, ["conv_id", "block"]).groupBy(*NODE).agg(F.sum("adds").alias("adds"))
    own = owned.where("owner = conv_id").select("conv_id", "depth", "total")
    parents = owned.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = nodes.join(own, ["conv_id", "depth"]).join(parents, ["conv_id", "depth"], "left")
    out = out.join(guests, NODE, "left").join(children, NODE, "left").join(end_digests(last.drop("upto")), NODE, "left")
    before = F.col("upto") - F.col("chars")
    saved = F.col("over") - F.col("n_convs") * before - (F.col("total") - before) - F.coalesce("adds", zero)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
