"""Shards for notes: balanced label propagation over the links between notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.llm.joins import salted_join
from barloom.session import discard, materialize

CELLS = 64            # hash cells of the movers between two shards; a cell moves whole or not at all
SLACK = 0.10          # room over a shard's quota while labels move
ROUNDS = 8            # rounds at most; they stop when nothing moves
SLOT_ROWS = 50_000    # rows that are numbered together, about
SALT_ROWS = 64        # rows of a hub that meet in one task when they ask for their goal


def quotas(spark, rows: int, shards: int) -> DataFrame:
    """(shard, quota): rows dealt evenly, the first shards take one more."""
    q, extra = divmod(rows, shards)
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"),
                                      (F.lit(q) + (F.col("id") < extra).cast("long")).alias("quota"))


def balanced_shards(positions: DataFrame, shards: int = 40, *, hubs: tuple[str, ...] = ("note_hash",)) -> DataFrame:
    """`positions` with `shard` and `slot`: linked notes together where the quotas allow it, row counts at most one apart.

    Notes that agree in a column of `hubs` (for example a hash of the note's text) are neighbours; a hub stands for its whole
    clique, so no pairs are made. A hub with more notes than half a quota is split by hash into parts of that size
    beforehand, because no shard could take it whole.

    Linked notes start at the shard that a hash gives them. In a round every hub names the shard that holds most of it and its
    other notes ask to go there. Requests are counted per pair of shards and hash cell; two shards may swap as many rows as
    both want, and the free room of a shard (its quota and SLACK, less what it holds) is shared among the requests. The cells
    that fit within the allowance move. At the end rows over a quota join the unlinked notes, and these fill the free places
    exactly, by rank. `slot` counts the rows of a shard from 0 without gaps.

    The given columns are stored once with a row number, so pass keys and hashes, not texts. An empty table gives no rows,
    repeated rows are rows of their own, and a null in a hub column links nothing."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = positions.sparkSession
    positions = materialize(positions.withColumn("row_", F.monotonically_increasing_id()), "rows")
    total = positions.count()
    if not total:
        return positions.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).drop("row_")
    quota = quotas(spark, total, shards)
    part = max(1, total // shards // 2)
    links = positions.select("row_", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(h).cast("string").alias("value"))
                                                         for i, h in enumerate(hubs)])).alias("hub"))
    links = links.filter("hub.value is not null").select("row_", F.xxhash64("hub.kind", "hub.value").alias("hub"))
    sizes = links.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the unit of movement: a hub, or a hash part of one that is too large for a shard
    parts = F.pmod(F.xxhash64("row_", F.lit(1)), F.ceil(F.col("n") / F.lit(part)))
    linked = (salted_join(links, sizes, ["hub"], F.xxhash64("row_"))
              .select("row_", F.xxhash64("hub", parts).alias("hub"),
                      F.ceil(F.least("n", F.lit(part)) / F.lit(SALT_ROWS)).alias("salts"),
                      F.pmod(F.xxhash64("row_"), F.lit(shards)).cast("int").alias("shard")))
    state = materialize(linked, "labels")
    for step in range(ROUNDS):
        old, state = state, materialize(_round(state, quota, shards, step), "labels")
        discard(old)
        if not state.filter("moved").limit(1).count():
            break
    return _fill(positions, state, quota, total).drop("row_")


def _round(state: DataFrame, quota: DataFrame, shards: int, step: int) -> DataFrame:
    held = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts"))
    # the shard with most notes of the hub; ties go to a hash of both, so that hubs spread over the shards
    goal = held.groupBy("hub").agg(F.max("salts").alias("salts"),
        F.max_by("shard", F.struct("n", F.xxhash64("hub", "shard"), "shard")).alias("goal"))
    asks = held.drop("salts").join(goal, "hub").filter("shard <> goal")
    cell = F.pmod(F.xxhash64("hub", F.lit(step)), F.lit(CELLS)).cast("int")
    # shards x shards x cells rows at most from here on
    flows = asks.groupBy("shard", "goal", cell.alias("cell")).agg(F.sum("n").alias("n"))
    wants = flows.groupBy("shard", "goal").agg(F.sum("n").alias("out"))
    back = wants.select(F.col("goal").alias("shard"), F.col("shard").alias("goal"), F.col("out").alias("back"))
    load = state.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    room = (quota.join(load, "shard", "left")
            .select(F.col("shard").alias("goal"), F.greatest(
                F.col("quota") * (1 + SLACK) - F.coalesce("load", F.lit(0)), F.lit(0.0)).alias("room")))
    both = wants.join(back, ["shard", "goal"], "left").withColumn("swap", F.least("out", F.coalesce("back", F.lit(0))))
    rest = F.col("out") - F.col("swap")
    share = F.sum(rest).over(W.partitionBy("goal"))
    allowed = (both.withColumn("rest", rest).withColumn("share", share).join(room, "goal")
               .select("shard", "goal", (F.col("swap") + F.when(F.col("share") > 0, F.floor(F.col("room") * F.col("rest") / F.col("share")))
                                         .otherwise(0)).alias("allowed")))
    run = F.sum("n").over(W.partitionBy("shard", "goal").orderBy("n", "cell"))
    admitted = (flows.withColumn("run", run).join(allowed, ["shard", "goal"])
                .filter("run <= allowed").select("shard", "goal", "cell"))
    ways = salted_join(state, goal, ["hub", "salts"], F.xxhash64("row_", F.lit(2)), salts=F.col("salts")).withColumn("cell", cell)
    admitted = F.broadcast(admitted.withColumn("go", F.lit(True)))    # shards x shards x cells rows at most
    return (ways.join(admitted, ["shard", "goal", "cell"], "left")
            .select("row_", "hub", "salts", F.when(F.col("go"), F.col("goal")).otherwise(F.col("shard")).alias("shard"),
                    F.coalesce("go", F.lit(False)).alias("moved")))


def _rank(df: DataFrame, groups: list[str], order: list[Column], total: int, name: str) -> DataFrame:
    """`name`: gapless number of each row in its group, without a task for a whole group: rows are numbered in hash buckets
    of about SLOT_ROWS and the counts of earlier buckets are added."""
    buckets = max(256, -(-total // SLOT_ROWS))
    df = df.withColumn("bucket_", F.pmod(F.xxhash64("row_"), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*groups, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = W.partitionBy(*groups).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*groups, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = W.partitionBy(*groups, "bucket_").orderBy(*order)
    return (df.withColumn("in_", F.row_number().over(inside) - 1).join(base, [*groups, "bucket_"])
            .withColumn(name, F.col("in_") + F.col("base_")).drop("bucket_", "in_", "base_"))


def _fill(positions: DataFrame, state: DataFrame, quota: DataFrame, total: int) -> DataFrame:
    # a note on several hubs keeps the shard that most of them chose
    own = state.groupBy("row_", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("row_").agg(
        F.max_by("shard", F.struct("n", -F.col("shard"))).alias("shard"))
    placed = _rank(own, ["shard"], [F.col("row_")], total, "slot").join(F.broadcast(quota), "shard").filter("slot < quota")
    placed = materialize(placed.select("row_", "shard", "slot"), "placed")
    took = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("took"))
    upto = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)     # one row a shard
    free = (quota.join(took, "shard", "left").withColumn("took", F.coalesce("took", F.lit(0)))
            .withColumn("free", F.col("quota") - F.col("took"))
            .withColumn("from", F.coalesce(F.sum("free").over(upto), F.lit(0)))
            .select(F.lit(0).alias("all_"), "shard", "took", "free", "from"))
    rest = positions.select("row_").join(placed.select("row_"), "row_", "left_anti").withColumn("all_", F.lit(0))
    ranked = _rank(rest, ["all_"], [F.col("row_")], total, "rank")
    table = F.broadcast(free.groupBy("all_").agg(F.sort_array(F.collect_list(F.struct("from", "shard", "took", "free"))).alias("places")))
    place = F.element_at(F.filter("places", lambda p: (p["from"] <= F.col("rank")) & (F.col("rank") < p["from"] + p["free"])), 1)
    filled = (ranked.join(table, "all_").withColumn("place", place)
              .select("row_", F.col("place.shard").alias("shard"),
                      (F.col("rank") - F.col("place.from") + F.col("place.took")).alias("slot")))
    return positions.join(placed.unionByName(filled), "row_")
