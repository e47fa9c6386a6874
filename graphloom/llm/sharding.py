"""Shards by balanced label propagation, with DataFrame operations only.

Texts that are equal are linked. Every document starts in the shard that its id
hashes to. In each round, each group of linked documents looks where its
members are and asks to gather in the shard that holds most of them; the
requests for a shard are granted up to the room that its quota leaves, by a
hash of the group, so that a round needs one aggregation, one join and a table
of one row per shard. A group larger than a quota can't gather in one shard;
only the share that the room allows moves.

The law is ``rows``: counts of shards differ by one at most, and a group is kept
whole wherever a shard has room for it. Groups of a 64th of a quota or more are
fewer than 64 a shard, so they are placed one by one, largest first: where
most of their members are, else where most room is, else in as few pieces as
the rooms allow. Smaller groups go where most of their members are, as long as
running sums leave room there; those that are left draw another shard, more
likely one with more room. What is in no group then fills the shards up, in
the order of a rank, together with the few groups for which no shard had room.

Ranks and running sums come from sums per bucket of groups and a window within
a bucket; buckets have a bounded number of rows, and a large group has buckets
of its own that are split further by id, so no window holds more than about
``BUCKET`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table

SHARDS = 16
ROUNDS = 4
BUCKET = 20_000
SLACK = 1.1  # a shard may be so much larger than its quota until groups are settled
PLACED = 64  # groups of this part of a quota or more are placed one by one
DRAWS = 3


def propagate(rows: DataFrame, groups: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (key, grp, label) with new labels; ``groups`` (grp, n) are those of two rows or more."""
    quota = max(1.0, SLACK * total / shards)
    for k in range(rounds):
        loads = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per shard
        # a hot group is one row per shard and task before it is shuffled
        places = rows.join(groups, "grp").groupBy("grp", "label").agg(F.count("*").alias("here"), F.first("n").alias("n"))
        # most members; among equals a hash of group and shard, so that ties spread
        wish = places.groupBy("grp").agg(F.max(F.struct("here", F.xxhash64("grp", "label").alias("tie"), "label")).alias("best"), F.first("n").alias("n"))
        wish = materialize(wish.select("grp", F.col("best.label").alias("goal"), (F.col("n") - F.col("best.here")).alias("moving")), f"sharding-wish-{k}")
        flows = rows.join(wish, "grp").filter(F.col("label") != F.col("goal")).groupBy("label", "goal").agg(F.count("*").alias("n")).collect()  # a row per pair of shards
        asked = {s: sum(r["n"] for r in flows if r["goal"] == s) for s in range(shards)}
        leaving = {s: sum(r["n"] for r in flows if r["label"] == s) for s in range(shards)}
        # what is about to leave a shard makes room in it
        share = {s: min(1.0, max(0.0, quota - loads.get(s, 0) + leaving[s]) / max(1, asked[s])) for s in range(shards)}
        room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, float(share[s]))]), F.col("goal"))
        # groups within a tenth of a quota move together, others in part
        chance = F.pmod(F.xxhash64(F.when(F.col("moving") <= F.lit(quota / 10), F.hash("grp")).otherwise(F.hash("key")), F.lit(k)), F.lit(1 << 20)) / F.lit(1 << 20)
        moved = rows.join(wish, "grp", "left").withColumn("label", F.when(chance < room, F.col("goal")).otherwise(F.col("label")))
        rows = materialize(moved.select("key", "grp", "label"), f"sharding-labels-{k}")
    return rows


def ranked(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` with column place: 0 to total - 1 in the order of label, bucket, group and key."""
    buckets = max(1, total // BUCKET)
    large = groups.filter(F.col("n") > BUCKET)
    rows = rows.join(large, "grp", "left").withColumns({
        "bucket": F.pmod(F.xxhash64("grp"), F.lit(buckets)) * 2 + F.col("n").isNotNull().cast("long"),
        "large": F.when(F.col("n").isNotNull(), F.col("grp")),
        "part": F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BUCKET))).otherwise(0),
    })
    by = ["label", "bucket", "large", "part"]
    # one row for some BUCKET rows: sorted in one place, as the ranks of buckets must be
    sums = rows.groupBy(*by).agg(F.count("*").alias("held"))
    before = sums.select(*by, (F.sum("held").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "large" else F.col(f"r.{c}") == F.col(f"b.{c}") for c in by]
    within = F.row_number().over(Window.partitionBy(*by).orderBy("grp", "key")) - 1
    numbered = rows.withColumn("within", within)
    return numbered.alias("r").join(before.alias("b"), same).select("r.key", (F.col("b.before") + F.col("r.within")).cast("long").alias("place"))


def seat(large: list, room: list[int]) -> tuple[dict, list[tuple]]:
    """Places of ``large`` (grp, n, goal), largest first: the shard of each whole group, and runs (grp, shard, n) of the others; ``room`` shrinks."""
    whole, runs = {}, []
    for grp, n, goal in large:
        at = goal if room[goal] >= n else max(range(len(room)), key=room.__getitem__)
        if room[at] >= n:
            whole[grp], room[at] = at, room[at] - n
            continue
        while n:
            at = max(range(len(room)), key=room.__getitem__)
            take = min(n, room[at])
            runs.append((grp, at, take))
            n, room[at] = n - take, room[at] - take
    return whole, runs


def fitting(groups: DataFrame, room: list[int], total: int) -> DataFrame:
    """``groups`` (grp, n, goal) with ``fits``: whether those before it and itself fill no more than the room of its goal."""
    # a bucket's sum of rows is about BUCKET, and a row per bucket and shard remains
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(max(1, total // BUCKET))))
    sums = groups.groupBy("goal", "bucket").agg(F.sum("n").alias("held"))
    before = sums.select("goal", "bucket", (F.sum("held").over(Window.partitionBy("goal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("goal", "bucket").orderBy(F.desc("n"), "grp").rowsBetween(Window.unboundedPreceding, 0))
    rooms = F.element_at(F.array(*map(F.lit, room)), F.col("goal") + 1)
    return groups.withColumn("within", within).join(before, ["goal", "bucket"]).select("grp", "n", "goal", (F.col("before") + F.col("within") <= rooms).alias("fits"))


def settle(rows: DataFrame, groups: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """``rows`` (key, grp, label) as key, grp, shard: counts of shards differ by one at most, groups are whole where there is room."""
    room = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    places = rows.join(groups, "grp").groupBy("grp", "label").agg(F.count("*").alias("here"), F.first("n").alias("n"))
    goals = places.groupBy("grp").agg(F.first("n").alias("n"), F.max_by("label", F.struct("here", F.xxhash64("grp", "label"))).alias("goal"))
    goals = materialize(goals.select("grp", "n", F.col("goal").cast("int").alias("goal")), "sharding-goals")
    one_by_one = F.col("n") * PLACED * shards >= total  # their sizes sum to total at most, so PLACED * shards of them are the most there can be
    large = [(bytes(r["grp"]), r["n"], r["goal"]) for r in goals.filter(one_by_one).orderBy(F.desc("n"), "grp").collect()]
    whole, runs = seat(large, room)
    spark = rows.sparkSession
    settled = spark.createDataFrame(list(whole.items()), "grp binary, goal int")
    left = goals.filter(~one_by_one)
    for k in range(DRAWS):
        if k:  # a number drawn for a group falls in the room of a shard
            ends = [sum(room[: s + 1]) for s in range(shards)]
            draw = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(max(1, ends[-1])))
            left = left.withColumn("goal", sum(((draw >= e).cast("int") for e in ends[:-1]), F.lit(0)))
        tried = materialize(fitting(left.select("grp", "n", "goal"), room, total), f"sharding-fit-{k}")
        for r in tried.filter("fits").groupBy("goal").agg(F.sum("n").alias("n")).collect():  # a row per shard
            room[r["goal"]] -= r["n"]
        settled, left = settled.unionByName(tried.filter("fits").select("grp", "goal")), tried.filter("not fits")
        if left.isEmpty():
            break
    parted = list(dict.fromkeys(grp for grp, _, _ in runs))
    turns = spark.createDataFrame([(g, i) for i, g in enumerate(parted)], "grp binary, turn int")
    held = rows.select("key", "grp").join(settled, "grp", "left")
    loose = held.filter("goal is null").select("key", "grp").join(F.broadcast(turns), "grp", "left")  # fewer rows than shards
    loose = materialize(ranked(loose.withColumn("label", F.coalesce("turn", F.lit(len(parted)))).select("key", "grp", "label"), groups, total), "sharding-loose")
    shard, end = F.when(F.lit(False), 0), 0
    for _, s, n in [*runs, *((None, s, n) for s, n in enumerate(room))]:
        end += n
        shard = shard.when(F.col("place") < end, s)
    return held.join(loose, "key", "left").select("key", "grp", F.coalesce("goal", shard).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text counts as empty (size 1), and texts of the same bytes are
    linked. Repeated rows, repeated ids and null ids each keep a row with a
    slot of its own; other columns are not read, whatever their names. An
    empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"))
    # the number in a written table is the same in each later read of it
    base = materialize(base.withColumn("key", F.monotonically_increasing_id()), "sharding-base")
    total = base.count()
    counted = materialize(base.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"), "sharding-groups")
    rows = base.select("key", "grp", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("label"))
    placed = materialize(settle(propagate(rows, counted, total, shards), counted, total, shards), "sharding-shards")
    slots = materialize(ranked(placed.withColumnRenamed("shard", "label"), counted, total), "sharding-places")
    start = F.expr(f"(shard * {total}L) div {shards}L")  # of the places of a shard, for shards are full
    out = base.join(placed.select("key", "shard"), "key").join(slots, "key").withColumn("slot", F.col("place") - start)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
