"""Mixing sources to target weights with exact block quotas per output shard.

1. Targets: every source's share of all words follows its weight, but stops at `most` times the words that it has; the
   excess goes to the others by weight until none is above (water filling over the table of sources).
2. Documents fall into blocks of their source by a hash of id and text: at most BLOCKS blocks a source, so no block holds
   more than that part of one. A source is taken as many whole times as fit into its target; for the rest, blocks are
   taken in a random order, and the last one document by document, to the nearest document.
3. Splitting tree: the numbers of drawn blocks per source are split between two halves of the output shards, then each
   half again, by a multivariate hypergeometric draw: block after block goes left with the chance that the room left
   gives it. Every shard gets an exact quota of every source's blocks.
4. Each source's drawn blocks, in a random order, are dealt to the shards by these quotas: disjoint runs of the order.
   Within a shard rows are ordered by a keyed hash (`arranged`).

All draws are hashes of (seed, keys), so reruns and retried tasks agree. Everything is SQL functions. Size is the number
of words `[^\\x20\\x09-\\x0D]+`; a null text has none. A null source is a source of its own, last in the order. A source
without words has target 0. Repeated rows are documents of their own; ids may repeat or be null. An empty input gives an
empty result. Tables of sources and blocks are metadata: one row a source, at most BLOCKS rows a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.session import stage

BLOCKS, BROADCAST_BLOCKS = 1024, 200_000  # rows of some 100 bytes; beyond, blocks are shuffled
WEIGHTS = (5, 2, 1)


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, size) rows -> one row per source: source, nr, source_size, docs, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("nr", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nr")
    whole = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (F.sum("source_size").over(whole) - full) / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nr", "level"))
    table = table.withColumn("level", F.min(fits).over(whole)["level"])
    return table.select("source", "nr", "source_size", "docs", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _chance(*keys: str) -> str:
    """SQL: a number in [0, 1) from a hash of the keys."""
    return f"(pmod(xxhash64({', '.join(keys)}), 1048576L * 1048576L) / (1048576D * 1048576D))"


def shard_quotas(drawn: DataFrame, levels: int, seed: int) -> DataFrame:
    """(nr, n) blocks drawn per source -> (nr, shard, quota) for 2 ** levels shards, by the splitting tree."""
    nodes = drawn.select(F.lit(0).alias("node"), "nr", F.col("n").cast("long").alias("n"))
    for level in range(levels):
        packed = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nr", "n"))).alias("sources"), F.sum("n").alias("total"))  # one entry a source
        unit = f"if({_chance(str(seed), str(level), 'node', 's.nr', 'j')} * u.total < u.room, named_struct('total', u.total - 1, 'room', u.room - 1, 'left', u.left + 1), named_struct('total', u.total - 1, 'room', u.room, 'left', u.left))"
        one = f"aggregate(if(s.n > 0, sequence(1L, s.n), cast(array() as array<bigint>)), named_struct('total', acc.total, 'room', acc.room, 'left', 0L), (u, j) -> {unit})"
        split = (
            "aggregate(sources, named_struct('total', total, 'room', (total + 1) div 2, 'out', cast(array() as array<struct<nr:int,n:bigint,l:bigint>>)), (acc, s) -> "
            f"transform(array({one}), d -> named_struct('total', d.total, 'room', d.room, 'out', array_append(acc.out, named_struct('nr', s.nr, 'n', s.n, 'l', d.left))))[0]).out"
        )
        halves = packed.select("node", F.explode(F.expr(split)).alias("s")).select(F.expr("explode(array(named_struct('node', node * 2, 'nr', s.nr, 'n', s.l), named_struct('node', node * 2 + 1, 'nr', s.nr, 'n', s.n - s.l)))").alias("h"))
        nodes = stage(halves.select("h.*"), "quotas")
    return nodes.select("nr", F.col("node").alias("shard"), F.col("n").alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (), levels: int = 4, seed: int = 20, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """-> id, source, `keep`, size, source_size, target, draws: array of (pass, shard), one entry per copy that the mix takes.

    `arranged` makes the copies of it.
    """
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), *(F.col(c).alias(f"__keep_{c}") for c in keep), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("__text"))
    sized = stage(sized.withColumn("__row", F.monotonically_increasing_id()), "sized")
    table = stage(targets(sized.select("source", "size"), weights, most), "targets")
    plan = table.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("blocks", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.col("docs") / 16))))
    plan = plan.withColumnRenamed("source", "__source")
    of = F.expr(f"pmod(xxhash64({seed}, __id, __text), blocks)").cast("int")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("block", of)

    sums = stage(rows.groupBy("nr", "block").agg(F.sum("size").alias("words"), F.first("times").alias("times"), F.first("rest").alias("rest")), "blocks")
    mixed = Window.partitionBy("nr").orderBy(F.expr(f"xxhash64({seed}, nr, block)"), "block")  # BLOCKS rows at most
    sums = sums.withColumn("before", F.sum("words").over(mixed) - F.col("words"))
    sums = sums.withColumn("extra", F.when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    passes = sums.select("nr", "block", F.explode(F.expr("sequence(0L, times)")).alias("pass"), "times", "extra").where("pass < times or extra > 0")
    dealt = Window.partitionBy("nr").orderBy(F.expr(f"xxhash64({seed + 1}, nr, block, pass)"), "block", "pass")  # most * BLOCKS rows at most
    passes = passes.withColumn("turn", F.row_number().over(dealt))
    quotas = shard_quotas(passes.groupBy("nr").agg(F.count("*").alias("n")), levels, seed)
    ends = quotas.withColumn("end", F.sum("quota").over(Window.partitionBy("nr").orderBy("shard"))).groupBy("nr").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    shard = F.expr("size(filter(ends, e -> e < turn))").alias("shard")
    draws = passes.join(ends, "nr").select("nr", "block", F.struct(F.col("pass").cast("int").alias("pass"), shard).alias("draw"))
    draws = draws.groupBy("nr", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws"))
    chosen = stage(sums.select("nr", "block", "before", "extra").join(draws, ["nr", "block"], "left"), "draws")

    rows = rows.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_BLOCKS else chosen, ["nr", "block"])
    # One block of each source is taken up to a row; only keys and sizes are ordered, the texts stay where they are.
    key = F.struct(F.expr(f"xxhash64({seed + 2}, __id, __text)").alias("order"), "size", "__row")
    last = Window.partitionBy("nr").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partly = rows.where("extra = 1").select("nr", "size", "before", "rest", key.alias("key")).withColumn("upto", F.col("before") + F.sum("size").over(last))
    cut = stage(partly.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("nr").agg(F.max("key").alias("cut")), "cut")
    rows = rows.join(cut, "nr", "left")
    whole = (F.col("extra") != 1) | F.coalesce(key <= F.col("cut"), F.lit(False))
    both = rows.withColumn("draws", F.when(whole, F.col("draws")).otherwise(F.expr("filter(draws, d -> d.pass < times)")))
    return both.select(
        F.col("__id").alias(id_col), F.col("source").alias(source_col), *(F.col(f"__keep_{c}").alias(c) for c in keep), "size", "source_size", "target",
        F.coalesce("draws", F.expr("cast(array() as array<struct<pass:int,shard:int>>)")).alias("draws"),
    )


def arranged(mixed: DataFrame, id_col: str = "doc_id", seed: int = 20) -> DataFrame:
    """One row per drawn copy, with `shard`, in the order of the shards and of a keyed hash within a shard."""
    copies = mixed.withColumn("draw", F.explode("draws")).withColumn("shard", F.col("draw.shard"))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed + 3), id_col, "draw.pass")).drop("draw", "draws")
    return copies.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
