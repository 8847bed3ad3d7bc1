"""Mixing sources to target weights by Sainte-Lague apportionment (operator 6, native).

1. Targets: the sources in code-point order (null last) weigh ``weights``,
   repeating; they share ``share`` of all sizes, none above ``cap`` times its own
   size, the excess going to the others by weight.  That is water-filling: with
   the sources sorted by cap / weight there is one level t, and a source gets
   min(cap_i, weight_i * t); two running sums find it without a loop.
2. Quotas: tokens are handed out in blocks of equal size, each block to the source
   with the highest quotient target / (2 * blocks + 1).  The quotas start from the
   nearest whole numbers, which differ from the result by a few blocks in all, and
   only the quotients around them are ranked.
3. Shards: a source is dealt into shards of about ``shard_tokens`` words by a seeded
   hash, and its quota is apportioned to them in the same way.
4. Selection: a shard's documents lie in seeded order on a line of words that is cut
   into blocks; a quota of q over b blocks takes every block q div b times and the
   first q mod b blocks of that order once more.  What a document gives is its
   overlap with the blocks taken, so nothing is exploded per block.

Scale.  One pass for sizes; per source and per shard sums are combined before the
shuffle; the running sums need only a shard in one task, and the number of shards
grows with the source, so a source with a third of all rows is spread.  Tables of
sources and shards are joined; source tables are broadcast (one row per source,
their number checked).  No Python runs on executors.

Edge cases: null and empty texts have size 0 and give 0; a null source is a source
of its own; a source of size 0 has target 0; a null doc_id is ordered by its size;
repeated rows are documents of their own; ties of the seeded hash are broken by
doc_id and size, beyond which rows are alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SHARD_TOKENS = 200_000
SEED = 20240607
#: Blocks are small enough that the smallest target has about this many, and no longer than LARGEST_BLOCK words.
BLOCKS = 256
LARGEST_BLOCK = 1024
BROADCAST_SOURCES = 100_000


def seeded(seed: int, *columns: str) -> Column:
    """A hash that SQL engines share: the md5 of the values as text."""
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns], F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = total.withColumns({"weight": weight, "most": (cap * F.col("source_size")).cast("double")})
    rows = rows.withColumn("pool", share * F.sum("source_size").over(Window.partitionBy()))
    # sources whose cap binds come first in this order; the level is what the others share
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("pool") - before) / after)
    free = F.col("most") >= F.col("weight") * F.col("level")
    rows = rows.withColumn("level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    return rows.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def apportion(rows: DataFrame, group: list[str], key: list[str], want: str, total: str, room: str) -> DataFrame:
    """``rows`` with a column ``quota``: Sainte-Lague shares of ``total`` blocks per group by the weights in ``want``, at most ``room`` each.

    The nearest whole numbers of want * total / sum(want) are the highest
    quotients down to one common level; what they miss or exceed is settled by
    ranking the next quotients around them.
    """
    by = Window.partitionBy(*[F.col(c) for c in group])
    rows = rows.withColumn("__sum", F.sum(want).over(by))
    near = F.floor(F.when(F.col("__sum") > 0, F.col(want) * F.col(total) / F.col("__sum")).otherwise(0.0) + 0.5).cast("long")
    rows = rows.withColumn("__near", F.least(near, F.col(room)))
    rows = rows.withColumn("__gap", (F.col(total) - F.sum("__near").over(by)).cast("long"))
    # seats that may change hands: the next |gap| quotients above, or the last |gap| below
    n = F.abs("__gap")
    seats = F.when(F.col("__gap") > 0, F.sequence(F.col("__near"), F.least(F.col("__near") + n, F.greatest(F.col(room), F.col("__near"))))).when(F.col("__gap") < 0, F.sequence(F.greatest(F.col("__near") - n, F.lit(0).cast("long")), F.col("__near")))
    seat = rows.where("__gap <> 0").select(*group, *key, "__near", "__gap", room, F.col(want).alias("__want"), F.explode(seats).alias("__k"))
    seat = seat.where((F.col("__k") < F.col(room)) & ((F.col("__gap") > 0) | (F.col("__k") < F.col("__near")))).withColumn("__q", F.col("__want") / (2 * F.col("__k") + 1))
    up = F.row_number().over(by.orderBy(F.desc("__q"), *[F.col(c).asc_nulls_last() for c in key]))
    down = F.row_number().over(by.orderBy(F.asc("__q"), *[F.col(c).desc_nulls_first() for c in key]))
    moved = seat.where("__gap > 0").withColumn("__r", up).where("__r <= __gap").withColumn("__d", F.lit(1))
    moved = moved.union(seat.where("__gap < 0").withColumn("__r", down).where("__r <= -__gap").withColumn("__d", F.lit(-1)))
    moved = moved.groupBy(*group, *key).agg(F.sum("__d").alias("__d"))
    moved = moved.select(*[F.col(c).alias(f"__m_{c}") for c in group + key], "__d")
    same = None
    for c in group + key:
        one = F.col(c).eqNullSafe(F.col(f"__m_{c}"))
        same = one if same is None else same & one
    quota = (F.col("__near") + F.coalesce("__d", F.lit(0))).cast("long").alias("quota")
    return rows.join(moved, same, "left").select(*[c for c in rows.columns if not c.startswith("__")], quota)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    sources = source_targets(rows, weights, cap, share)
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(LARGEST_BLOCK)), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy()) / BLOCKS))).cast("long")
    sources = sources.withColumn("block", F.coalesce(block, F.lit(1).cast("long")))
    sources = sources.withColumn("blocks", F.floor(F.sum("target").over(Window.partitionBy()) / F.col("block") + 0.5).cast("long"))
    sources = sources.withColumn("room", (cap * F.ceil(F.col("source_size") / F.col("block"))).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("int"))
    sources = apportion(sources.withColumn("__all", F.lit(1)).withColumnRenamed("__all", "all"), ["all"], ["source"], "target", "blocks", "room")
    sources = materialize(sources.select("source", "source_size", "target", "block", "shards", F.col("quota").alias("source_quota")), "mix-sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = sources.withColumnRenamed("source", "__source")
    side = F.broadcast(side) if few else side
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("__order", seeded(seed, "doc_id"))
    # the shard is read from the hash's tail, the order in the shard from its head
    shard = (F.conv(F.substring("__order", 25, 8), 16, 10).cast("long") % F.col("shards")).cast("int")
    rows = rows.withColumn("shard", shard)
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    shards = shards.withColumn("n", F.ceil(F.col("shard_size") / F.col("block")).cast("long")).withColumns({"room": (cap * F.col("n")).cast("long"), "weight": F.col("shard_size").cast("double")})
    shards = materialize(apportion(shards, ["source"], ["shard"], "weight", "source_quota", "room").select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "n", "quota"), "mix-shards")
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")))
    line = Window.partitionBy("source", "shard").orderBy("__order", F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__end", F.sum("size").over(line))
    start = F.col("__end") - F.col("size")
    whole = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long")
    edge = (F.col("quota") - whole * F.col("n")) * F.col("block")
    once_more = F.greatest(F.lit(0).cast("long"), F.least(F.col("__end"), edge) - start)
    return rows.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + once_more).cast(T.LongType()).alias("taken"))
