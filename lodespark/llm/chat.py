"""Chat formatting: logged snapshots of a conversation that grew are collapsed to the longest, then rendered.

Every turn carries a rolling hash of all turns up to it (the exclusive or of 128-bit hashes of position, role and
text). A conversation whose last hash is a hash inside a longer one is a prefix of it and goes, by an anti-join; of
equal conversations the one of the least conv_id stays.

* rows with a null conv_id are left out. Turns are ordered by turn, role and text, nulls first; only their order matters.
* a row repeated in full counts once. Null and empty texts differ as turns; both are rendered empty. A null role is rendered "unknown".
* "<|" in a role or text becomes "< |", so that no text can end its turn. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table


def _part(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(c)), F.lit("0"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, position, h1, h2): h1 and h2 hash the turns up to this one. The table is shuffled once."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).filter("conv_id is not null")
    rows = rows.repartition("conv_id").dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = [F.xxhash64(F.lit(seed), F.col("position"), _part("role"), _part("text")) for seed in (1, 2)]
    return rows.select("conv_id", "role", "text", "position", *[F.bit_xor(h).over(so_far).alias(f"h{k}") for k, h in enumerate(each, 1)])


def maximal(spark: SparkSession, conversations: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another."""
    scratch = scratch or Scratch(spark)
    hashes = turns(conversations).select("conv_id", "position", "h1", "h2")
    hashes = scratch.keep(hashes.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id"))), "hashes")
    inside = hashes.filter("position < n_turns").select("position", "h1", "h2")
    last = hashes.filter("position = n_turns").select("conv_id", "position", "h1", "h2")
    kept = last.join(inside, ["position", "h1", "h2"], "left_anti")
    return kept.groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("position").cast("long").alias("n_turns"))


def render(spark: SparkSession, conversations: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, n_turns, chat) of the maximal conversations."""
    safe = lambda c, empty: F.replace(F.coalesce(F.col(c), F.lit(empty)), F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit("<|im_start|>"), safe("role", "unknown"), F.lit("\n"), safe("text", ""), F.lit("<|im_end|>\n"))
    kept = maximal(spark, conversations, scratch=scratch)
    shown = turns(conversations).join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("position", said.alias("said")))).alias("all"))
    return shown.select("conv_id", "n_turns", F.array_join(F.col("all.said"), "").alias("chat"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark, table(spark, sf_dir, "conversations"))


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
n as (select *, row_number() over w as position, count(*) over (partition by conv_id) as n_turns
      from t window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
p as (select *, string_agg(coalesce('1' || role, '0') || chr(2) || coalesce('1' || text, '0'), chr(1)) over
      (partition by conv_id order by position rows between unbounded preceding and current row) as so_far from n),
k as (select min(conv_id) as conv_id from p a where position = n_turns
      and not exists (select 1 from p b where b.position < b.n_turns and b.position = a.position and b.so_far = a.so_far)
      group by so_far)
select conv_id, cast(n_turns as bigint) as n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' order by position) as chat
from n where conv_id in (select conv_id from k) group by conv_id, n_turns
"""
