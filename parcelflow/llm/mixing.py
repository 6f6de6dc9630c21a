"""Mixing sources to target weights by Pfair scheduling, as DataFrame expressions only.

Every source's documents, in a fixed pseudo-random order, are cut into blocks.  Block j of a source of weight w is
released at floor(j / w) and due at ceil((j + 1) / w); at every slot the released block with the earliest deadline
runs, so after any number of slots each source is less than one block from its share.

The exact schedule takes shares to 2^-36.  Its slots are cut into frames.  Of the blocks released before a slot, those
run by then are the best by deadline that can all be run (a lower one never delays a higher one), so a frame can be run
alone, as if nothing were left over from before it: every block that is left over at its start then takes an idle slot of
the frame, or the place of the last by deadline among itself and what the frame ran.  So the frames are run side by side,
one short pass over the frames (no slots) tells what is left over at the start of each, and they are scheduled side by side.
With a period instead, every source gets 1 / period and only the rest follows the weights,
in multiples of 1 / period: the schedule repeats, but shares can be far from the weights where sources are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .spark_util import partitions, written

#: Shares of the exact schedule are multiples of 1 / SHARES; it is cut into frames of so many slots, or as many as there are frames.
SHARES, FRAME = 1 << 36, 1000
PERIOD = 1000
#: Rows of a block.
BLOCK = 16
DIGITS = 3  # hex digits of the bucket number: 4096 buckets


def weight_parts(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row: array of (source, q) with q >= 1 summing to the period (largest remainders, ties to the first source).

    weights: (source, weight > 0), one row for each source; a null source is a source of its own.  The period is
    raised to the number of sources where there are more of them."""
    each = weights.select(F.struct(F.col("source").isNotNull().alias("named"), F.col("source").cast("string").alias("source")).alias("s"), F.col("weight").cast("double").alias("w"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("s", "w"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["w"])
    n = F.greatest(F.lit(period), F.size("a"))
    spare = (F.col("n") - F.size("a")).cast("double")
    one = one.select("a", total.alias("total"), n.alias("n"))
    exact = F.transform("a", lambda x: F.struct(x["s"].alias("s"), (x["w"] / F.col("total") * spare).alias("x")))
    one = one.select("n", exact.alias("e"))
    floors = F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc + F.floor(x["x"]).cast("long"))
    order = F.array_sort(F.transform("e", lambda x, i: F.struct((F.floor(x["x"]) - x["x"]).alias("r"), i.alias("i"))))
    one = one.select("n", "e", (F.col("n") - F.size("e") - floors).alias("rest"), F.transform(order, lambda x: x["i"]).alias("order"))
    q = lambda x, i: (F.lit(1) + F.floor(x["x"]) + F.when(F.array_position(F.col("order"), i) <= F.col("rest"), 1).otherwise(0)).cast("long")
    return one.select(F.col("n").cast("long").alias("period"), F.transform("e", lambda x, i: F.struct(x["s"].alias("s"), q(x, i).alias("q"))).alias("parts"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, q, period, k, slot): the slot of the k-th block of each source within one period."""
    one = weight_parts(weights, period)
    step = lambda acc, t: _slot(acc, t)
    start = F.struct(F.transform("parts", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picked"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step)
    each = one.select("period", "parts", F.posexplode(run["picked"]).alias("slot", "i"))
    each = each.select("period", F.element_at("parts", F.col("i") + 1).alias("p"), F.col("slot").cast("long").alias("slot"), "i")
    k = F.row_number().over(W.partitionBy("i").orderBy("slot")).cast("long") - 1
    return each.select(F.col("p.s.source").alias("source"), F.col("p.q").alias("q"), "period", k.alias("k"), "slot")


def _slot(acc, t):
    """Fold step: of the released blocks the one with the earliest deadline, ties to the earlier source."""
    bids = F.transform("parts", lambda x, i: F.when(
        F.floor(F.element_at(acc["done"], i + 1) * F.col("period") / x["q"]) <= t,
        F.struct((-F.floor(-(F.element_at(acc["done"], i + 1) + 1) * F.col("period") / x["q"])).alias("due"), i.alias("i")),
    ))
    pick = F.array_min(F.filter(bids, lambda b: b.isNotNull()))["i"]
    return F.struct(F.transform(acc["done"], lambda d, i: d + F.when(i == pick, 1).otherwise(0)).alias("done"), F.concat(acc["picked"], F.array(pick)).alias("picked"))


def _div(a, q):
    """floor(a / q) of longs with a >= 0 and a quotient below 2^50, exactly."""
    return F.round((a - a % q) / q).cast("long")


def _runs(state, use):
    """use(number of the source that runs next), bound once for all sources: of the released blocks that of the earliest deadline."""
    due = lambda x: _div(F.lit(SHARES) - x["lead"] + x["q"] - 1, x["q"])
    bids = F.transform(state, lambda x, i: F.when(x["lead"] + x["q"] > 0, F.struct(due(x).alias("due"), i.alias("i"))))
    return F.element_at(F.transform(F.array(F.array_min(F.filter(bids, lambda b: b.isNotNull()))["i"]), use), 1)


def _advance(state, pick):
    ran = lambda i: F.when(i == pick, 1).otherwise(0).cast("long")
    return F.transform(state, lambda x, i: F.struct(x["q"].alias("q"), (x["lead"] + x["q"] - ran(i) * F.lit(SHARES)).alias("lead"), (x["j"] + ran(i)).alias("j")))


def _fresh(at, q):
    """State of a source at a slot if all its blocks released before have run: the product slot * q in parts that a long holds."""
    half = F.lit(1 << 18)
    high = at * _div(q, half)
    low = (high % half) * half + at * (q % half)
    over = low % F.lit(SHARES)
    return F.struct(q.alias("q"), F.when(over == 0, over).otherwise(over - F.lit(SHARES)).alias("lead"), (_div(high, half) + _div(low, F.lit(SHARES)) + F.when(over == 0, 0).otherwise(1)).alias("j"))


def _left_over(frames: DataFrame) -> DataFrame:
    """(f, left): which sources have a released block that has not run at the start of frame f.

    frames: (f, slots from ``at`` to ``to``, start and end: states before and after the frame run alone).  A source's last block released
    before the end is a spare one (run in the frame, but due later), an older one (released before the frame), or has
    surely not run."""
    due = lambda x: F.col("to") + _div(F.when(x["lead"] > 0, F.lit(SHARES) - x["lead"]).otherwise(-x["lead"]) + x["q"] - 1, x["q"])
    kind = lambda x, i: F.when(x["lead"] > 0, "left").when(x["lead"] < 0, F.when(x["j"] > F.element_at("start", i + 1)["j"], "spare").otherwise("old"))
    ran = F.aggregate(F.zip_with("start", "end", lambda a, b: b["j"] - a["j"]), F.lit(0).cast("long"), lambda acc, x: acc + x)
    marks = F.transform("end", lambda x, i: F.struct(kind(x, i).alias("kind"), F.struct(due(x).alias("due"), i.alias("i")).alias("rank")))
    one = frames.select("f", (F.col("to") - F.col("at") - ran).alias("idle"), marks.alias("marks")).agg(F.array_sort(F.collect_list(F.struct("f", "idle", "marks"))).alias("frames"))

    def step(acc, frame):
        here = F.element_at(acc, -1)
        more = F.size(F.filter(here, lambda x: x)) - frame["idle"]  # so many blocks do not fit
        free = lambda m, i: (m["kind"] == "spare") | ((m["kind"] == "old") & F.element_at(here, i + 1))
        ranks = F.sort_array(F.transform(F.filter(frame["marks"], lambda m, i: free(m, i)), lambda m: m["rank"]), asc=False)
        last = F.when(more > 0, F.element_at(ranks, more.cast("int")))
        left = lambda least: F.transform(frame["marks"], lambda m, i: F.coalesce((m["kind"] == "left") | (free(m, i) & (m["rank"] >= least)), F.lit(False)))
        return F.concat(acc, F.transform(F.array(last), left))

    none = F.array(F.transform(F.element_at("frames", 1)["marks"], lambda m: F.lit(False)))
    kept = F.aggregate("frames", none, step)
    return one.where(F.size("frames") > 0).select(F.posexplode(kept).alias("f", "left")).select(F.col("f").cast("long").alias("f"), "left")


def exact_schedule(weights: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, k, slot): the slot of the k-th block of each source, up to the first block that no source can fill.

    weights: (source, weight > 0), one row for each source; rows: (source, rows).  The state of a source is its share q, its
    lead (slots * q - blocks run * SHARES, always within one block) and the number of blocks it has run."""
    s = F.struct(F.col("source").isNotNull().alias("named"), F.col("source").cast("string").alias("source"))
    one = weights.select(s.alias("s"), F.col("weight").cast("double").alias("w")).agg(F.array_sort(F.collect_list(F.struct("s", "w"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["w"])
    one = one.select("a", total.alias("total"))
    one = one.select("a", F.transform("a", lambda x: F.greatest(F.lit(1), F.round(x["w"] / F.col("total") * F.lit(float(SHARES)))).cast("long")).alias("q"))
    # What rounding leaves over (a few multiples of 2^-36) goes to the first of the largest shares.
    rest = F.lit(SHARES) - F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x)
    one = one.select("a", "q", rest.alias("rest"), F.array_position("q", F.array_max("q")).alias("top"))
    one = one.select("a", F.transform("q", lambda x, i: x + F.when(i + 1 == F.col("top"), F.col("rest")).otherwise(0)).alias("qs"))
    one = written(one.where(F.size("a") > 0), "mix-shares")
    each = one.select(F.explode(F.arrays_zip(F.col("a").alias("a"), F.col("qs").alias("q"))).alias("p")).select(F.col("p.a.s.source").alias("_s"), F.col("p.q").alias("q"))
    until = F.ceil((F.floor(F.col("rows") / block) + 1).cast("double") * F.lit(float(SHARES)) / F.col("q"))
    slots = each.join(rows, F.col("_s").eqNullSafe(F.col("source").cast("string"))).agg(F.max(until).alias("slots"))
    size = F.greatest(F.lit(FRAME), F.ceil(F.sqrt("slots"))).cast("long")
    one = written(one.crossJoin(slots.where("slots IS NOT NULL")).withColumn("size", size), "mix-slots")  # one row each
    frames = one.select("a", "qs", "size", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("slots"), F.col("size")))).alias("f"))
    frames = frames.select("a", "f", (F.col("f") * F.col("size")).alias("at"), ((F.col("f") + 1) * F.col("size")).alias("to"), "qs")
    frames = frames.select("a", "f", "at", "to", F.transform("qs", lambda q: _fresh(F.col("at"), q)).alias("start"))
    # Frames are few bytes but long to run: into a stated number of partitions, so that they are not put together by size.
    dealt = partitions(one.sparkSession)
    within = F.sequence(F.col("at"), F.col("to") - 1)
    end = F.aggregate(within, F.col("start"), lambda state, t: _runs(state, lambda pick: _advance(state, pick)))
    left = written(_left_over(frames.drop("a").repartition(dealt, "f").withColumn("end", end)), "mix-left")
    late = lambda x, n: F.struct(x["q"].alias("q"), (x["lead"] + n * F.lit(SHARES)).alias("lead"), (x["j"] - n).alias("j"))
    state = F.zip_with("start", "left", lambda x, is_left: late(x, is_left.cast("long")))
    frames = frames.join(left, "f").select("a", "f", "at", "to", state.alias("state")).repartition(dealt, "f")
    place = lambda acc, t: _runs(acc["now"], lambda pick: F.struct(
        _advance(acc["now"], pick).alias("now"),
        F.concat(acc["picked"], F.array(F.struct(pick.alias("i"), F.element_at(acc["now"], pick + 1)["j"].alias("k"), t.alias("slot")))).alias("picked"),
    ))
    none = F.array().cast("array<struct<i: int, k: bigint, slot: bigint>>")
    run = F.aggregate(within, F.struct(F.col("state").alias("now"), none.alias("picked")), place)
    placed = frames.select("a", F.explode(run["picked"]).alias("p"))
    return placed.select(F.element_at("a", F.col("p.i") + 1)["s"]["source"].alias("source"), F.col("p.k").alias("k"), F.col("p.slot").alias("slot"))


def mix(docs: DataFrame, weights: DataFrame, period: int | None = None, block: int = BLOCK, digits: int = DIGITS) -> DataFrame:
    """docs (doc_id, source, ...) with the columns mix_block, mix_slot, mix_place and mix_full.

    mix_block: block number within the source; mix_slot: the slot it runs in; mix_place: place within the block, so
    that ordering by (mix_slot, mix_place) interleaves the sources; mix_full: no source has run out before this slot, so
    the target weights hold up to it.  Every row stays: what a source has beyond the shortest one comes in its later
    slots.  A null source is a source of its own; sources without a weight get null columns and mix_full false; empty
    input gives no rows.  Rows that are equal in doc_id and source take neighbouring places in no stated order; where an
    extra column is named like one of the four, it is replaced.  Without a period the exact schedule is taken."""
    spare = "_mix_md5"
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.drop("mix_block", "mix_slot", "mix_place", "mix_full")
    rows = docs.withColumn(spare, key).withColumn("_mix_bucket", F.substring(spare, 1, digits))
    rows = rows.repartition("_mix_bucket")  # a bucket holds an even share of every source, however hot
    place = F.row_number().over(W.partitionBy("_mix_bucket", "source").orderBy(spare, "doc_id"))
    counts = docs.select("source", F.substring(key, 1, digits).alias("_mix_bucket")).groupBy("source", "_mix_bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("source").orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), F.coalesce(before, F.lit(0)).alias("_mix_start"))
    rows = rows.withColumn("_mix_rn", place)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")), "left").drop("_mix_s", "_mix_b")
    nth = F.col("_mix_start") + F.col("_mix_rn") - 1
    rows = rows.withColumns({"mix_block": F.floor(nth / block).cast("long"), "mix_place": F.pmod(nth, F.lit(block)).cast("long")})
    sizes = counts.groupBy("source").agg(F.sum("c").alias("rows"))
    if period is None:
        plan = written(exact_schedule(weights, sizes, block), "mix-plan").select(F.col("source").alias("_mix_s"), F.col("k").alias("_mix_k"), F.col("slot").alias("mix_slot"))
        ends = sizes.join(plan, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.floor(F.col("rows") / block) == F.col("_mix_k"))).agg(F.min("mix_slot"))
        rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("mix_block") == F.col("_mix_k")), "left")
        rows = rows.drop("_mix_s", "_mix_k", "_mix_start", "_mix_rn", "_mix_bucket", spare)
        return rows.withColumn("mix_full", F.coalesce(F.col("mix_slot") < ends.scalar(), F.lit(False)))
    plan = schedule(weights, period)
    quota = plan.select("source", "q", "period").distinct()
    last = sizes.join(quota, sizes["source"].eqNullSafe(quota["source"])).select(quota["source"].alias("source"), "q", "period", F.floor(F.col("rows") / block).alias("full"))
    # The slot of each source's first block that it cannot fill: none of the sources has run out before the least of them.
    ends = last.select(F.col("source").alias("_s"), (F.col("full") % F.col("q")).alias("_k"), (F.floor(F.col("full") / F.col("q")) * F.col("period")).alias("_base"))
    ends = ends.join(plan, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_k") == F.col("k"))).agg(F.min(F.col("_base") + F.col("slot")).alias("_end"))
    p = plan.select(F.col("source").alias("_mix_s"), F.col("k").alias("_mix_k"), F.col("slot").alias("_mix_slot"))
    q = F.broadcast(quota.select(F.col("source").alias("_mix_s"), F.col("q").alias("_mix_q"), F.col("period").alias("_mix_p")))
    rows = rows.join(q, F.col("source").eqNullSafe(F.col("_mix_s")), "left").drop("_mix_s")
    rows = rows.withColumns({"_mix_of": F.col("mix_block") % F.col("_mix_q"), "_mix_base": F.floor(F.col("mix_block") / F.col("_mix_q")) * F.col("_mix_p")}).drop("_mix_q", "_mix_p")
    rows = rows.join(F.broadcast(p), F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_of") == F.col("_mix_k")), "left")
    rows = rows.withColumn("mix_slot", (F.col("_mix_base") + F.col("_mix_slot")).cast("long"))
    rows = rows.drop("_mix_s", "_mix_k", "_mix_slot", "_mix_of", "_mix_base", "_mix_start", "_mix_rn", "_mix_bucket", spare)
    return rows.withColumn("mix_full", F.coalesce(F.col("mix_slot") < ends.scalar(), F.lit(False)))


def natural_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): row counts raised to a power, the usual damping between natural shares (1) and equal ones (0)."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))
