"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

1. Sizes are words; each source's words are counted before anything is shuffled.
2. Targets: weights share all words; a target stops at ``cap`` times its source's size and the excess is shared again.
3. The mix consists of blocks of equally many words. Shard h of ``shards`` ends after a fixed count of blocks, and the
   highest quotients target / (2 i + 1) give each source its blocks up to there. The method is monotone in the count, so
   the differences between shards are quotas, whole numbers of zero or more. Only seats near the line are ranked: at most a
   few per source and shard.
4. A source's documents stand in a seeded order, a stream of blocks from a seeded start, around it as often as needed. The
   shards take their quotas of blocks from it one after another, so each shard of each source is a run of whole documents
   but for its two ends. ``mixture`` names the shard in which a document is first taken.

The offset of a document in its source's stream comes from sums per (source, slice) and a running sum within a
slice, so a source that holds a third of all rows is spread over many tasks. One row per source is all that meets in one
task. Reruns give equal results, as order and start are hashes (md5) of ids and texts.

Defined results. Null or empty text: size 0, nothing taken. A null source is a source, last in order. Rows with equal
doc_id are separate rows. An empty table gives an empty result. Other columns are kept in ``mixed`` and not read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (1, 2, 3)
CAP = 3
SHARDS = 16
SLICE_DIGITS = 3
SEED = 42
LARGEST_BLOCK = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target): one row per source from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    # In the order of how soon they are full: the shares that are left when all before have stopped at their cap.
    every = Window.partitionBy(F.lit(1))
    rank = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    per = per.withColumn("room", F.col("total") - cap * F.coalesce(F.sum("source_size").over(rank), F.lit(0))).withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(rank), F.lit(0)))
    full = cap * F.col("source_size") * F.col("open") <= F.col("weight") * F.col("room")
    per = per.withColumn("full", full)
    # The first source that does not fill up sets the share of one unit of weight for it and all after it.
    line = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "room", "open"))).over(every)
    per = per.withColumn("line", line)
    share = F.col("weight") * F.col("line.room") / F.col("line.open")
    return per.select("source", "source_size", "weight", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def block_quotas(targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, source_size, target, block, shard, quota, upto): whole blocks of each source for each shard, and up to its end."""
    every = Window.partitionBy(F.lit(1))
    t = targets.where("source_size > 0").withColumn("sources", F.count("*").over(every)).withColumn("total", F.sum("source_size").over(every))
    block = F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(F.min("target").over(every) / 1000))).cast("long")
    t = t.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    seats = F.floor(F.round(F.col("total") / F.col("block")) * (F.col("shard") + 1) / shards).cast("long")
    t = t.withColumn("seats", seats).withColumn("share", F.col("seats") * F.col("target") / F.col("total"))
    # All divisors that give this many seats lie within sources / 2 seats of the proportional one.
    slack = F.col("share") * F.col("sources") / (2 * F.greatest(F.col("seats"), F.lit(1)))
    t = t.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("share") - slack - 1)).cast("long")).withColumn("high", F.ceil(F.col("share") + slack + 1).cast("long"))
    near = t.withColumn("seat", F.explode(F.sequence("low", F.col("high"))))
    near = near.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    by_shard = Window.partitionBy("shard")
    best = by_shard.orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "seat")
    near = near.withColumn("place", F.row_number().over(best))
    lows = t.groupBy("shard").agg(F.sum("low").alias("sure"))
    won = near.join(lows, "shard").withColumn("won", (F.col("place") <= F.col("seats") - F.col("sure")).cast("long"))
    upto = won.groupBy("source", "source_size", "target", "block", "shard").agg((F.max("low") + F.sum("won")).alias("upto"))
    before = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return upto.select("source", "source_size", "target", "block", "shard", (F.col("upto") - before).alias("quota"), "upto")


def placed(docs: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """``docs`` with a struct ``mix``: size, source_size, target, taken, shard, and where the taken words lie.

    mix.passes: how often the whole text is taken; mix.parts: word ranges (from, to), 0-based, of one more partial taking;
    mix.shard: the shard whose quota takes the document first.
    """
    docs = docs.withColumn("mix_size", word_count(F.col("text")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    docs = docs.withColumn("mix_order", order).withColumn("mix_slice", F.substring("mix_order", 1, SLICE_DIGITS))
    sizes = docs.select(F.col("source"), F.col("mix_size").alias("size"), F.col("mix_slice").alias("slice"))
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    targets = source_targets(slices)
    # One row for each source, with the blocks that its shards have taken up to their ends.
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"])
    quota = block_quotas(targets, shards).groupBy("source").agg(F.sum("quota").alias("quota"), F.first("block").alias("block"), ends.alias("ends"))
    base = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("l"), base.alias("base"))
    plan = targets.join(quota.withColumnRenamed("source", "q"), F.col("source").eqNullSafe(F.col("q")), "left").select(
        F.col("source").alias("t"), "source_size", "target", F.coalesce("quota", F.lit(0)).alias("quota"), F.coalesce("block", F.lit(1)).alias("block"), "ends")
    plan = slices.join(plan, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = Window.partitionBy("source", "mix_slice").orderBy("mix_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    docs = docs.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_slice") == F.col("l")))
    # The quota in words; a document may not be taken more than CAP times.
    words = F.least(F.col("quota") * F.col("block"), CAP * F.col("source_size"))
    docs = docs.withColumn("mix_passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    docs = docs.withColumn("mix_rest", words - F.col("mix_passes") * F.col("source_size"))
    spin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")))), 1, 12), 16, 10).cast("long")
    start = spin % F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.col("block"))) * F.col("block")
    docs = docs.withColumn("mix_start", start).withColumn("mix_from", F.col("base") + F.col("mix_before"))

    def overlap(a: Column, b: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), a - F.col("mix_from"))
        high = F.least(F.col("mix_size"), b - F.col("mix_from"))
        return F.struct(low.alias("from"), F.greatest(low, high).alias("to"))

    end = F.col("mix_start") + F.col("mix_rest")
    parts = F.filter(F.array(
        overlap(F.lit(0).cast("long"), end - F.col("source_size")),  # what runs over the stream's end goes on at its start
        overlap(F.col("mix_start"), F.least(end, F.col("source_size")))), lambda p: p["from"] < p["to"])
    docs = docs.withColumn("mix_parts", parts)
    part = F.aggregate("mix_parts", F.lit(0).cast("long"), lambda acc, p: acc + p["to"] - p["from"])
    taken = F.col("mix_passes") * F.col("mix_size") + part
    # Where the document's first word behind the start stands in the run.
    at = F.when(F.col("mix_from") >= F.col("mix_start"), F.col("mix_from") - F.col("mix_start")).when(F.col("mix_from") + F.col("mix_size") > F.col("mix_start"), F.lit(0))
    docs = docs.withColumn("mix_at", F.coalesce(at, F.col("mix_from") + F.col("source_size") - F.col("mix_start")))
    shard = F.when(taken > 0, F.size(F.filter("ends", lambda e: e * F.col("block") <= F.col("mix_at"))))
    mix = F.struct(
        F.col("mix_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("mix_passes").alias("passes"), F.col("mix_parts").alias("parts"), shard.alias("shard"))
    helpers = [c for c in docs.columns if c.startswith("mix_")] + ["s", "l", "base", "source_size", "target", "quota", "block", "ends"]
    return docs.withColumn("mix", mix).drop(*helpers)


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard) for every row of ``docs``; shard is null where nothing is taken."""
    return placed(docs.select(F.col("doc_id"), F.col("text"), F.col("source")), seed).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.shard")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each document as often as it is taken whole, and one row for a part.

    A part keeps the white space after its words. n_chars, where there is such a column, counts the new text.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text", "source")]
    rows = placed(docs.select("doc_id", "text", "source", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("row")), seed)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    # A part that covers the whole document is the whole text.
    whole = F.exists("mix.parts", lambda p: p["to"] - p["from"] == F.col("mix.size"))
    part = F.array_join(F.flatten(F.transform("mix.parts", lambda p: F.slice(pieces, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), "")
    copies = F.concat(
        F.array_repeat(F.col("text"), F.col("mix.passes").cast("int")),
        F.when(F.size("mix.parts") == 0, F.array().cast("array<string>")).when(whole, F.array("text")).otherwise(F.array(part)))
    rows = rows.where("mix.taken > 0").withColumn("text", F.explode(copies))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None
    return rows.select(*[
        F.col(c) if c not in others else length.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in columns])
