"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a multiple of its size, so each of its documents is
wanted a fractional number of times.  The whole part is taken; the rest are
probabilities, and *pairs* of them are settled against each other: mass moves
from one to the other, in a random direction with the odds that keep both
expectations, weighed by size so that the words of the pair stay the same,
until one of the two is 0 or 1.  What remains of a block of documents is one
fractional document; these residuals meet again in blocks of their own, level
by level, until one is left for each source, which goes to the nearer end.  A
source's taken words thereby differ from its target by at most half of one
document.

Blocks are hash ranges of a source, so a source of any size is many tasks, and
every draw is a hash of the document and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from fadegraph.llm.shared import id_or_last, id_or_null, write_out
from fadegraph.session import broadcast_if_small

WORD = "[^\\x20\\x09-\\x0D]+"
# Documents, or residuals, of one block.
BLOCK_ROWS = 1_024


def sources_of(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Size and target of each source: (source, source_no, source_size, target).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words.  A target stops at ``limit`` times its source's
    size; each round pins the targets that are above and shares the rest by
    weight among the others, until none is above.
    """
    sources = write_out(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source, counted already
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = write_out(sources.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, free = share * total, F.lit(True)
    most = F.col("source_size") * float(limit)
    unit = 0.0
    while True:
        pinned, weight = sources.agg(
            F.sum(F.when(~free, most)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            break
        unit = max(wanted - (pinned or 0.0), 0.0) / weight
        above = free & (F.col("weight") * unit > most)
        # A pinned source stays pinned: units only grow from round to round.
        if sources.filter(above).isEmpty():
            break
        free = F.col("weight") * unit <= most
    return sources.select("source", "source_no", "source_size",
                          F.when(free, F.col("weight") * unit).otherwise(most).alias("target"))


def _settle(sizes: list[float], shares: list[float], draws: list[float]) -> tuple[list[float], int]:
    """Pivotal rounding of one block, in order; returns the shares and the place of the residual (-1: none)."""
    held = -1
    for i, share in enumerate(shares):
        if not 0.0 < share < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        p, q = shares[held], shares[i]
        up = min((1.0 - p) * a, q * b)      # words that may move to the held one
        down = min(p * a, (1.0 - q) * b)    # and from it
        if draws[i] * (up + down) < down:
            p, q = (1.0 if up == (1.0 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
        else:
            p, q = (0.0 if down == p * a else p - down / a), (1.0 if down == (1.0 - q) * b else q + down / b)
        shares[held], shares[i] = p, q
        if not 0.0 < p < 1.0:
            held = i if 0.0 < q < 1.0 else -1
    return shares, held


def _round_block(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that the residual tends to be a small one.
        block = block.sort_values(["unit", "draw", "did"], ascending=[False, True, True]).reset_index(drop=True)
        shares, held = _settle(block["unit"].astype(float).tolist(), block["share"].tolist(), block["draw"].tolist())
        if last and held >= 0:
            shares[held] = float(shares[held] >= 0.5)  # one is left of the source: the nearer end
            held = -1
        block["share"] = shares
        block["open"] = [i == held for i in range(len(block))]
        return block

    return run


def _keys(id_: str, text: str, source: str) -> list[F.Column]:
    """What a document is settled by: id, source and size."""
    return [id_or_last(id_).alias("did"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")]


def settled_units(sizes: DataFrame, weights: Sequence[float], share: float, limit: float, seed: int) -> DataFrame:
    """Copies of each distinct (did, source, size), with the number of ``rows`` that have them."""
    units = write_out(sizes.groupBy("did", "source", "size").agg(F.count("*").alias("rows")))
    stats = sources_of(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, limit)
    counts = units.groupBy(F.col("source").alias("src")).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    stats = write_out(stats.join(counts, F.expr("source <=> src")).drop("source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = units.join(broadcast_if_small(stats), F.expr("source <=> src")).drop("src")

    def draw(at: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(at), "did", "size"), F.lit(1 << 52)) / float(1 << 52)

    level = (joined.withColumn("whole", F.floor(ratio).cast("long")).withColumn("share", ratio - F.floor(ratio))
             .withColumn("draw", draw(0)).withColumn("unit", F.col("size") * F.col("rows")))
    # Documents without words move no mass: each is settled by its own draw.
    level = level.withColumn("share", F.when(F.col("unit") > 0, F.col("share")).otherwise(
        (F.col("draw") < F.col("share")).cast("double")))
    settled = []
    blocks = stats.agg(F.max("blocks")).first()[0] or 0
    at = 0
    while blocks:
        block = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(at), "did", "size", "source"), F.col("blocks"))
        keyed = level.withColumn("block", block)
        schema = StructType([*keyed.schema.fields, StructField("open", BooleanType())])
        done = write_out(keyed.groupBy("source_no", "block").applyInPandas(_round_block(blocks == 1), schema))
        settled.append(done.filter("not open"))
        if blocks == 1:
            break
        at += 1
        blocks = -(-blocks // BLOCK_ROWS)
        level = done.filter("open").drop("open", "block").withColumn(
            "blocks", F.ceil(F.col("blocks") / BLOCK_ROWS)).withColumn(
            "draw", draw(at))
    columns = [F.col("did"), F.col("source"), F.col("size"), F.col("source_size"), F.col("target"),
               (F.col("whole") + F.round("share").cast("long")).alias("copies"), F.col("rows")]
    if not settled:
        rounded = level.select(*columns)
    else:
        rounded = settled[0].select(*columns)
        for part in settled[1:]:
            rounded = rounded.unionByName(part.select(*columns))
    return rounded


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0,
                id_: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """How often each document is taken: (doc_id, source, size, source_size, target, copies, taken), a row for each row.

    ``size`` counts the words of the whole text, runs without the six ASCII
    blanks; a null or blank text has none.  ``target`` is that of the source,
    ``taken`` is ``copies * size``, and ``copies`` is the fraction
    ``target / source_size`` rounded up or down.  Rows that agree in id, source
    and size are settled as one and get the same copies.  Null sources are one
    source; a null id counts as the largest.  A source without words has the
    target 0, and its documents, as all without words, are taken once or not by
    a draw of their own.  Other columns are dropped.  An empty table gives an
    empty result.
    """
    rounded = settled_units(docs.select(*_keys(id_, text, source)), weights, share, limit, seed)
    return (rounded.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .withColumns({"doc_id": id_or_null("did"), "taken": F.col("copies") * F.col("size")})
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def take_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0,
             id_: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs``, with all their columns, as often as ``mix_sources`` takes them."""
    names = docs.columns
    all_columns = F.struct(*[F.col(c) for c in names]).alias("__doc")
    rows = docs.select(*_keys(id_, text, source), all_columns)
    copies = settled_units(rows.drop("__doc"), weights, share, limit, seed).filter("copies > 0").select(
        "did", F.col("source").alias("src"), F.col("size").alias("words"), "copies")
    same = F.expr("did = uid and size = words and source <=> src")
    taken = rows.join(broadcast_if_small(copies.withColumnRenamed("did", "uid")), same)
    return taken.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__doc.*")
