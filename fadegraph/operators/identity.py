"""Ids of new rows: unique in the memory, and the same when an import is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadegraph.schema import new_id
from fadegraph.session import broadcast_if_small, cut_lineage

# Places that are numbered together.
REPEAT_BLOCK = 10_000


def repeat_number(rows: DataFrame, keys: list[str], ord_: str, out: str = "repeat_no", block: int = REPEAT_BLOCK) -> DataFrame:
    """Rows with the number, from 0, of the repeat among those of equal keys, in the order of ``ord_``.

    ``ord_`` is a whole number and unique among equal keys.  They are numbered
    in blocks of it, so that rows of one key are not all in one task.
    """
    dealt = rows.withColumn("_block", F.expr(f"`{ord_}` div {block}"))
    sizes = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(ord_)) - 1
    return dealt.join(firsts, [*keys, "_block"]).withColumn(out, F.col("_first") + place).drop("_block", "_first")


def fresh_ids(rows: DataFrame, prefix: str, parts: list[str], stored: DataFrame, out: str = "id") -> DataFrame:
    """Rows with ids that no stored row has: digests of ``parts``, which identify a row among ``rows``.

    A row that once had the same parts may still be there under them, moved to
    another topic or renamed.  Then the id is that of the first generation that
    is free, so ids follow from the rows and the stored ids alone, and no clock
    or place in a batch has a part in them.
    """
    waiting, done, generation = rows, None, 0
    while True:
        named = cut_lineage(waiting.withColumn(out, new_id(prefix, *[F.col(p) for p in parts], F.lit(generation))))
        own = broadcast_if_small(named.select(F.col(out).alias("_own")))
        taken = stored.join(own, F.col("id") == F.col("_own"), "left_semi").select(F.col("id").alias("_taken"))
        if taken.isEmpty():
            return named if done is None else done.unionByName(named)
        taken = broadcast_if_small(cut_lineage(taken))
        free = named.join(taken, F.col(out) == F.col("_taken"), "left_anti")
        done = free if done is None else done.unionByName(free)
        waiting = named.join(taken, F.col(out) == F.col("_taken"), "left_semi").drop(out)
        generation += 1
