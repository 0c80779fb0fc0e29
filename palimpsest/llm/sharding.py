"""Balanced label propagation: linked documents move towards their neighbours' shards, under capacity quotas.

Documents of equal text are linked. A link group is held as its counts by shard, so that a group of any size is one
row. In each round a group asks to move its documents to the shard where most of them lie; requests are granted while
the shard has room, in a fixed order. Documents without links fill what is left, so that the numbers of rows end at most
one apart; only what is over a quota is moved, documents without links first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, running_total, staged

SHARDS, ROUNDS = 16, 24
#: Rows that a task of the running totals holds, on average.
CHUNK = 8192


def propagated(groups: DataFrame, shards: int, quotas: list[int], rounds: int, chunks: int) -> DataFrame:
    """groups (g, n), n the numbers of a link group's documents by shard, after the rounds of moves, or when none is left; the sum of n over a shard is within its quota unless it was over it before."""
    none, before_round = F.lit(0).cast("long"), None
    places = F.transform("n", lambda x, s: F.struct(x.alias("n"), F.xxhash64("g", s).alias("h"), s.alias("shard")))
    to = F.col("to")

    def total(of: Column) -> Column:
        return F.aggregate(of, none, lambda a, x: a + x["n"])

    def taken(p: Column) -> Column:
        """Of a place that gives up documents: how many, the places with fewer first."""
        return F.greatest(none, F.least(p["n"], F.col("granted") - total(F.filter("less", lambda x: x < p))))

    for _ in range(rounds):
        sums = (F.sum(F.get("n", F.lit(s))).alias(f"n{s}") for s in range(shards))
        held = groups.agg(*sums, F.sum(F.aggregate("n", none, lambda a, x: a + x * x)).alias("together")).first()
        if held["together"] in (None, before_round):
            break  # no groups, or nothing moved
        before_round = held["together"]
        room = F.lit([max(0, quotas[s] - held[f"n{s}"]) for s in range(shards)]).cast("array<long>")
        d = groups.withColumn("places", places).withColumn("to", F.array_max(F.filter("places", lambda x: F.get(room, x["shard"]) > 0)))
        d = d.withColumn("less", F.filter("places", lambda x: (x["n"] > 0) & (x < to)))  # rows never leave a shard with more of their group
        d = d.withColumns({"best": to["shard"], "asks": total(F.col("less"))})
        asking = running_total(d.where("asks > 0"), ["best"], F.pmod(F.xxhash64("g"), F.lit(chunks)), ["g"], F.col("asks"), "before")
        moved = asking.withColumn("granted", F.greatest(none, F.least("asks", F.get(room, F.col("best")) - F.col("before"))))
        moved = moved.select("g", F.transform("places", lambda p: F.when(p["shard"] == to["shard"], p["n"] + F.col("granted")).when(p < to, p["n"] - taken(p)).otherwise(p["n"])).alias("n"))
        new = staged(d.where("asks = 0").select("g", "n").unionByName(moved), "labels")
        drop_staged(groups)
        groups = new
    return groups


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1 (null: none), text_crc32 that of the UTF-8 text. Numbers of rows of the
    shards differ by one at most, and slots of a shard have no gap. Rows of equal text are linked, null counts as empty;
    a group larger than a shard is cut into as few shards as its moves allow. Repeated rows and ids each get a slot of
    their own. Ties are broken by hashes. An empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(5), raw).alias("h2"))
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    chunks = max(16, total // CHUNK + 1)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(shards)).cast("int")
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1").select("h1", "h2", F.xxhash64("h1", "h2").alias("g"))
    groups = staged(groups, "groups")  # else the join would use the aggregate's partitions, and Spark couldn't split a hot one
    linked = staged(rows.join(groups, ["h1", "h2"]).select("uid", "g", start.alias("shard")), "linked")
    counts = linked.groupBy("g").agg(F.array(*(F.count(F.when(F.col("shard") == s, 1)) for s in range(shards))).alias("n"))
    counts = propagated(staged(counts, "labels"), shards, quotas, rounds, chunks)

    # the documents of a group, in a fixed order, take the places that its counts give
    mix = F.pmod(F.xxhash64("uid", F.lit(13)), F.lit(chunks))
    placed = running_total(linked.select("uid", "g"), ["g"], mix, ["uid"], F.lit(1), "rank")
    ends = F.transform("n", lambda x, s: F.aggregate(F.slice("n", F.lit(1), s + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    placed = placed.join(counts.select("g", ends.alias("ends")).hint("merge"), "g").select("uid", F.size(F.filter("ends", lambda x: x <= F.col("rank"))).alias("group_shard"))
    rows = rows.join(placed, "uid", "left").withColumns({"single": F.col("group_shard").isNull().cast("int"), "shard": F.coalesce("group_shard", start)})

    order = F.col("single") * chunks + mix
    slotted = staged(running_total(rows, ["shard"], order, ["uid"], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", "slot"), "slots")
    have = {r["shard"]: r["n"] for r in slotted.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
    over, gaps, seen, filled = [], [], 0, 0
    for s in range(shards):  # rows over the quotas, numbered through, fill the gaps in their order
        n = have.get(s, 0)
        over.append(seen - quotas[s])
        seen += max(0, n - quotas[s])
        if quotas[s] > n:
            gaps.append((filled, s, n))
            filled += quotas[s] - n
    quota = F.get(F.array(*(F.lit(x).cast("long") for x in quotas)), F.col("shard"))
    extra = F.when(F.col("slot") >= quota, F.get(F.array(*(F.lit(x).cast("long") for x in over)), F.col("shard")) + F.col("slot"))
    # looked up in arrays: a case for each gap is code that takes the compiler much memory
    first, to, held = (F.lit([x[i] for x in gaps]).cast("array<long>") if gaps else F.array().cast("array<long>") for i in range(3))
    gap = F.size(F.filter(first, lambda x: x <= F.col("extra"))) - 1  # the last that begins at or before it
    shard = F.coalesce(F.get(to, F.col("gap")), F.col("shard"))
    slot = F.coalesce(F.get(held, F.col("gap")) - F.get(first, F.col("gap")) + F.col("extra"), F.col("slot"))
    return slotted.withColumn("extra", extra).withColumn("gap", gap).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
