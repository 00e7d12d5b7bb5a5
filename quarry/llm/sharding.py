"""Balanced label propagation: linked documents move to the shard where most of their neighbours are, round by round, under
quotas that keep every shard's row count as it began.

Links are given as groups (here: equal texts), so a document's neighbours are counted once per group and shard and no pairs are
made. In a round each scattered group names the shard with most of its members, those that still hold unlinked documents before
others; members elsewhere want to move there. Per pair of shards a quota of moves is granted: as many unlinked documents move
the other way, and where there are none left, linked ones that want to, one for one or in rings. Counts stay at most one apart."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, few, stored


@dataclass(frozen=True)
class ShardParams:
    """Groups of over half a shard are split into parts of about that size, each a group by itself. rounds: at most. bucket_rows:
    of the buckets that numbers are dealt in."""

    shards: int = 16
    rounds: int = 10
    bucket_rows: int = 1 << 14


def numbered(df: DataFrame, keys: list[str], by: list[str], name: str, rows: int, bucket_rows: int) -> DataFrame:
    """df with name: numbers 0, 1, ... without gaps within keys. Two levels: counts of hashed buckets of by are summed before
    each bucket is numbered by itself, so no task sorts more than a bucket."""
    buckets = max(1, rows // bucket_rows)
    cut = df.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__n")
    offsets = counts.select(*keys, "__b", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*by)) - 1
    return cut.join(offsets, [*keys, "__b"]).withColumn(name, (F.col("__before") + nth).cast("long")).drop("__b", "__before")


def quotas(wanted: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """wanted[i, j]: members that want to go from i to j; spare[j]: unlinked rows of j. Gives the granted moves, and for the way
    back rows (from, to, first, last): which spare rows, by number, go where. In and out of each shard are equal."""
    granted = wanted.astype(np.int64)
    while True:
        over = granted.sum(axis=0) - granted.sum(axis=1) - spare  # what comes in beyond what can leave
        j = int(over.argmax())
        if over[j] <= 0:
            break
        excess = int(over[j])
        for i in np.argsort(over, kind="stable").tolist():  # from shards that lose more than they get, first
            less = min(excess, int(granted[i, j]), max(-int(over[i]), 0))
            granted[i, j] -= less
            excess -= less
        if excess == over[j]:  # those that are left all get as much as they lose: some must lose less in turn
            i = int(granted[:, j].argmax())
            granted[i, j] -= min(excess, int(granted[i, j]))
    net = granted.sum(axis=0) - granted.sum(axis=1)
    ways, need = [], [(j, -int(n)) for j, n in enumerate(net) if n < 0]
    for j in np.flatnonzero(net > 0).tolist():
        first, left = 0, int(net[j])
        while left:
            to, room = need.pop()
            take = min(left, room)
            ways.append((j, to, first, first + take - 1))
            first, left = first + take, left - take
            if room > take:
                need.append((to, room - take))
    return granted, ways


def _among(plan: list[tuple[int, int, int, int]], number: Column, of: Column) -> Column:
    """The shard that a plan of (from, to, first, last) sends a row to; null if it stays. A plan has under 2 * shards rows."""
    to = F.lit(None).cast("int")
    for source, target, first, last in plan:
        to = F.when((of == source) & number.between(first, last), F.lit(target)).otherwise(to)
    return to


def propagate(rows: DataFrame, params: ShardParams) -> DataFrame:
    """rows: row (unique), grp. Gives row, shard, with counts of shards at most one apart. Rows of a null group are unlinked."""
    k = params.shards
    total = rows.count()
    half = max(1, total // (2 * k))
    sizes = rows.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    linked = rows.join(few(stored(sizes)), "grp", "left")
    part = F.when(F.col("n") > half, F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / half))).otherwise(0)
    linked = linked.withColumn("part", part).select("row", F.when(F.col("n").isNotNull(), F.xxhash64("grp", "part")).alias("link"))
    start = numbered(linked.withColumn("all", F.lit(0)), ["all"], ["row"], "at", total, params.bucket_rows)
    now = stored(start.select("row", "link", (F.col("at") % k).cast("int").alias("shard")))
    for turn in range(params.rounds):
        spare = np.zeros(k, np.int64)
        for r in now.where(F.col("link").isNull()).groupBy("shard").count().collect():
            spare[r["shard"]] = r["count"]
        here = now.where(F.col("link").isNotNull()).groupBy("link", "shard").agg(F.count("*").alias("n"))
        open_shard = F.col("shard").isin(np.flatnonzero(spare).tolist())  # others take members only for members
        best = here.groupBy("link").agg(  # ties fall otherwise in each round, so that what found no exchange may find one
            F.max_by("shard", F.struct(open_shard, "n", F.xxhash64("link", "shard", F.lit(turn)))).alias("target"), F.count("*").alias("spread")
        )
        best = stored(best.where(F.col("spread") > 1).drop("spread"))
        alone = now.where(F.col("link").isNull()).withColumn("target", F.lit(None).cast("int"))  # apart: nulls would meet in one task
        joined = now.where(F.col("link").isNotNull()).join(few(best), "link", "left")
        joined = joined.select("row", "link", "shard", F.when(F.col("target") != F.col("shard"), F.col("target")).alias("target"))
        aimed = stored(joined.unionByName(alone))
        wanted = np.zeros((k, k), np.int64)
        for r in aimed.where(F.col("target").isNotNull()).groupBy("shard", "target").count().collect():  # shards squared at most
            wanted[r["shard"], r["target"]] = r["count"]
        if not wanted.any():
            break
        granted, ways = quotas(wanted, spare)
        if not granted.any():
            discard(aimed, best)
            continue
        movers = numbered(aimed.where(F.col("target").isNotNull()), ["shard", "target"], ["link", "row"], "nth", total, params.bucket_rows)
        quota = now.sparkSession.createDataFrame([(i, j, int(granted[i, j])) for i in range(k) for j in range(k)], "shard int, target int, quota long")
        movers = movers.join(F.broadcast(quota), ["shard", "target"])  # shards squared rows
        movers = movers.select("row", "link", F.when(F.col("nth") < F.col("quota"), F.col("target")).otherwise(F.col("shard")).alias("shard"))
        still = aimed.where(F.col("link").isNotNull() & F.col("target").isNull()).select("row", "link", "shard")
        singles = numbered(aimed.where(F.col("link").isNull()), ["shard"], ["row"], "nth", total, params.bucket_rows)
        singles = singles.select("row", "link", F.coalesce(_among(ways, F.col("nth"), F.col("shard")), F.col("shard")).alias("shard"))
        moved = stored(movers.unionByName(still).unionByName(singles))
        discard(now, aimed, best)
        now = moved
    return now.select("row", "shard")


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text + 1), text_crc32, law ("rows"), shard, slot (0, 1, ... in its
    shard), grown_shard (null under this law). Equal texts are linked; null counts as empty; repeated rows and null ids are
    documents like others; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"))
    light = stored(light.withColumn("row", F.monotonically_increasing_id()))
    placed = light.drop("grp").join(propagate(light.select("row", "grp"), params), "row")
    total = light.count()
    slots = numbered(placed, ["shard"], ["row"], "slot", total, params.bucket_rows)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
