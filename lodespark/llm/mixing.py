"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and cut into blocks of BLOCK tokens (a document belongs to the block
in which it starts). Slot k of the schedule goes to the source whose share of the cumulative weights holds the k-th
golden-ratio point, k * 2654435769 mod 2**32: every run of slots then has each source's share to within a few slots.
The r-th slot of a source takes its block r; a source with fewer blocks than slots starts again (the next epoch). The
schedule ends with the slot that completes the first epoch of the last source, so every document of a source with a
weight is in it once at least; sources of a single block don't prolong it, and come after its end if it has not
reached them. Default weights are the sources' tokens to the power 3/4.

All arithmetic is in integers, and running sums are taken in two levels (hash buckets, then rows of a bucket), so no
task ever holds a whole source, and SQL gives the same rows. Tokens are white-space separated words.

* null source: a source of its own (""). Null text: no tokens; it stays, in the block of its place. Null doc_id: placed like any other.
* rows equal in doc_id, source and text are one unit of the schedule, all in one block.
* a source without tokens has one block, and 1 for its default weight. Weights of unknown sources don't count; sources without a weight, or with one
  that is not above 0, get no slot. An empty table gives an empty result; other columns are not read by place().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, words

BLOCK, ROWS = 8192, 4096
GOLDEN, TURN = 2654435769, 1 << 32
SPARE = 64
#: Sources (some 60 bytes each) up to which their intervals are broadcast; beyond, slots meet them in a join on CELLS cells of the interval.
BROADCAST_SOURCES, CELLS = 100_000, 4096


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """A row's source, and the hash that shuffles and names it."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), source, F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit("-")))
    return source, F.md5(name.cast("binary"))


def running(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """df with before: the sum of value over the rows of the same source with a lesser key, in two levels."""
    df = df.withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(TURN)) * buckets / TURN).withColumn("bucket", F.floor("bucket"))
    sums = df.groupBy("source", "bucket").agg(F.sum(value).alias("own"))
    sums = sums.withColumn("base", F.sum("own").over(Window.partitionBy("source").orderBy("bucket")) - F.col("own")).drop("own")
    inside = F.sum(value).over(Window.partitionBy("source", "bucket").orderBy("key")) - F.col(value)
    return df.withColumn("inside", inside).join(sums, ["source", "bucket"]).withColumn("before", F.col("base") + F.col("inside")).drop("inside", "base", "bucket")


def schedule(spark: SparkSession, sources: DataFrame, slots: int, *, rows: int = ROWS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(slot, source, turn): turn counts the source's slots. sources: (source, weight), weights whole numbers above 0."""
    total = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per source
    bounds = sources.withColumn("top", F.sum("weight").over(total)).withColumn("low", F.col("top") - F.col("weight")).withColumn("all", F.sum("weight").over(Window.partitionBy()))
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(TURN))
    slot = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point)
    wide = lambda c: (c if isinstance(c, Column) else F.col(c)).cast("decimal(19,0)")  # noqa: E731  # products of two longs don't fit in one
    hit = (wide("point") * wide("all") >= wide("low") * TURN) & (wide("point") * wide("all") < wide("top") * TURN)
    if sources.count() <= broadcast_sources:
        given = slot.join(F.broadcast(bounds), hit)
    else:
        first, last = F.floor(F.col("low") * CELLS / F.col("all")), F.ceil(F.col("top") * CELLS / F.col("all"))  # rounded, hence a cell more on either side
        cells = bounds.withColumn("cell", F.explode(F.sequence(first - 1, last + 1)))
        given = slot.withColumn("cell", F.floor(F.col("point") / (TURN // CELLS))).join(cells, "cell").filter(hit)
    given = given.select("slot", "source").withColumn("bucket", F.floor(F.col("slot") / rows))
    sums = given.groupBy("source", "bucket").agg(F.count("*").alias("own"))
    sums = sums.withColumn("base", F.sum("own").over(Window.partitionBy("source").orderBy("bucket")) - F.col("own")).drop("own")
    inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("slot")) - 1
    return given.withColumn("inside", inside).join(sums, ["source", "bucket"]).select("slot", "source", (F.col("base") + F.col("inside")).alias("turn"))


def place(spark: SparkSession, docs: DataFrame, *, weights: dict[str, int] | None = None, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(slot, epoch, source, block, doc_id, n_tokens, key): the documents of each slot; key names a row of the table."""
    scratch = scratch or Scratch(spark)
    source, key = _key(docs)
    units = docs.select(source.alias("source"), key.alias("key"), F.col("doc_id").cast("long"), words(F.col("text").cast("string")).alias("n_tokens"))
    units = scratch.keep(units.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens")), "units")
    n = units.count()
    cut = running(units, "n_tokens", max(1, n // ROWS)).select("source", "key", "doc_id", "n_tokens", F.floor(F.col("before") / block).alias("block"))
    cut = scratch.keep(cut, "cut")
    sizes = cut.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.sum("n_tokens").cast("double").alias("tokens"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.greatest(F.lit(1), F.floor(F.sqrt("tokens") * F.sqrt(F.sqrt("tokens")))).cast("long"))
    else:
        sizes = sizes.join(spark.createDataFrame(list(weights.items()), "source string, weight long").filter("weight > 0"), "source")
    sizes = scratch.keep(sizes.select("source", "blocks", "weight"), "sizes")
    # no interval is hit SPARE times less than its share, so this is enough for every source of more than one block
    needed = F.ceil((F.col("blocks") + SPARE).cast("double") * F.sum("weight").over(Window.partitionBy()).cast("double") / F.col("weight"))
    slots = sizes.withColumn("needed", needed).agg(F.coalesce(F.max(F.when(F.col("blocks") > 1, F.col("needed"))), F.count("*"))).first()[0]
    turns = scratch.keep(schedule(spark, sizes.select("source", "weight"), slots).join(sizes.select("source", "blocks"), "source"), "turns")
    end = turns.filter("blocks > 1 and turn = blocks - 1").agg(F.max("slot")).first()[0]
    end = slots if end is None else end + 1
    turns = turns.filter(F.col("slot") < end).select("slot", "source", F.pmod("turn", "blocks").alias("block"), F.floor(F.col("turn") / F.col("blocks")).alias("epoch"))
    late = sizes.select("source").join(turns.select("source").distinct(), "source", "left_anti")
    late = late.select((F.row_number().over(Window.orderBy("source")) + (end - 1)).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("epoch"))
    # a row per slot: its files are small enough for a broadcast long after the rows aren't
    return turns.union(late).join(cut.hint("merge"), ["source", "block"]).select("slot", "epoch", "source", "block", "doc_id", "n_tokens", "key")


def mixed(spark: SparkSession, docs: DataFrame, *, weights: dict[str, int] | None = None, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """The documents of the mix, with their columns; a document of a second epoch comes again."""
    scratch = scratch or Scratch(spark)
    times = scratch.keep(place(spark, docs, weights=weights, block=block, scratch=scratch).groupBy("key").agg(F.count("*").alias("times")), "times")
    mark = next(c for c in (f"__key{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    rows = docs.withColumn(mark, _key(docs)[1]).join(times.select(F.col("key").alias(mark), F.col("times").alias(f"{mark}_n")), mark)
    again = rows.withColumn(mark, F.explode(F.sequence(F.lit(1), F.col(f"{mark}_n"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark, table(spark, sf_dir, "documents")).drop("key")


ORACLE = """
with units as (select coalesce(source, '') as source,
                 md5(coalesce(cast(doc_id as varchar), '-') || '|' || coalesce(source, '') || '|' || coalesce(md5(text), '-')) as key, doc_id,
                 coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) as n from documents),
unit as (select source, key, min(doc_id) as doc_id, cast(sum(n) as bigint) as n_tokens from units group by source, key),
cut as (select *, (sum(n_tokens) over (partition by source order by key rows unbounded preceding) - n_tokens) // 8192 as block from unit),
size as (select source, max(block) + 1 as blocks, greatest(1, cast(floor(sqrt(cast(sum(n_tokens) as double)) * sqrt(sqrt(cast(sum(n_tokens) as double)))) as bigint)) as weight from cut group by source),
bound as (select *, sum(weight) over (order by source rows unbounded preceding) as top, sum(weight) over () as total from size),
slot as (select unnest(range(cast((select coalesce(max(case when blocks > 1 then ceil((blocks + 64) * total / weight) end), count(*)) from bound) as bigint))) as slot),
given as (select slot, source, row_number() over (partition by source order by slot) - 1 as turn, blocks from slot join bound
          on ((slot * 2654435769) % 4294967296) * total >= (top - weight) * 4294967296 and ((slot * 2654435769) % 4294967296) * total < top * 4294967296),
fin as (select coalesce((select max(slot) + 1 from given where blocks > 1 and turn = blocks - 1), (select count(*) from slot)) as fin),
early as (select slot, source, turn % blocks as block, turn // blocks as epoch from given where slot < (select fin from fin)),
late as (select (select fin from fin) + row_number() over (order by source) - 1 as slot, source, 0 as block, 0 as epoch from size where source not in (select source from early))
select cast(slot as bigint) as slot, cast(epoch as bigint) as epoch, source, cast(block as bigint) as block, doc_id, n_tokens
from (select * from early union all select * from late) join cut using (source, block)
"""
