"""Operators over blocks: order, merging, pairing with labels, walking, scoring.

Blocks have doc_id, page, block_idx (unique in a document), text, confidence, x1, y1, x2, y2. Whatever
joins or ranks them does so within (doc_id, page), so one exchange by document serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.catalogue import ANCHORS
from inkfield.functions.geometry import Box, across, below, clamp, right_of, upright
from inkfield.functions.numbers import all_digits, digits_only
from inkfield.functions.text import is_blank, normalize

ORDER = ("page", "y1", "x1", "block_idx")


def in_order(blocks: DataFrame) -> DataFrame:
    """Blocks with text, with their place from 0 in the order of page, top, left."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER)) - 1
    return blocks.where(~is_blank(F.col("text"))).withColumn("place", place)


def weighted_confidence(text: Column, confidence: Column) -> Column:
    """Aggregate: confidences weighted by text length, at least 1."""
    weight = F.greatest(F.length(text), F.lit(1))
    return F.coalesce(clamp(F.sum(confidence * weight) / F.sum(weight)), F.lit(0.0))


def page_confidence(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_blank(F.col("text"))).groupBy("doc_id").agg(weighted_confidence(F.col("text"), F.col("confidence")).alias("confidence"))


def document_score(blocks: DataFrame) -> DataFrame:
    """doc_id, score: the weights of the anchors that some page says, at most 1. Blocks of a page are read in wire order."""
    words = F.sort_array(F.collect_list(F.struct("block_idx", normalize(F.col("text")).alias("w"))))
    pages = blocks.groupBy("doc_id", "page").agg(F.array_join(F.transform(words, lambda b: b["w"]), " ").alias("said"))
    found = pages.groupBy("doc_id").agg(*[F.max(F.contains("said", F.lit(a))).alias(f"a{n}") for n, (a, _) in enumerate(ANCHORS)])
    score = sum((F.when(F.col(f"a{n}"), w).otherwise(0.0) for n, (_, w) in enumerate(ANCHORS)), F.lit(0.0))
    return found.select("doc_id", clamp(score).alias("score"))


def candidates(labels: DataFrame, values: DataFrame) -> DataFrame:
    """Every label with each value below or beside it on its page, and the better score; below wins a tie.

    labels: doc_id, page, label_idx and l-prefixed box. values: doc_id, page, block_idx and box. An equi-join on
    (doc_id, page) with the ranges as its condition.
    """
    a, b = Box.of("l"), Box.of()
    met = labels.join(values, ["doc_id", "page"]).where("label_idx <> block_idx")
    scored = met.withColumn("below", below(a, b)).withColumn("beside", right_of(a, b)).where("below is not null or beside is not null")
    under = F.col("below").isNotNull() & (F.col("beside").isNull() | (F.col("below") >= F.col("beside")))
    return scored.withColumn("position", F.when(under, "below").otherwise("right")).withColumn("geometry", F.when(under, F.col("below")).otherwise(F.col("beside")))


def top(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= k)


def continuation(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, next_idx: the topmost block right under each one in its column."""
    lower = blocks.select("doc_id", "page", F.col("block_idx").alias("next_idx"), *[F.col(c).alias(f"n{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = Box.of(), Box.of("n")
    h = F.greatest(a.height, F.lit(1.0))
    met = blocks.join(lower, ["doc_id", "page"]).where((F.col("block_idx") != F.col("next_idx")) & (b.y1 - a.y2).between(-0.5 * h, 0.7 * h) & (F.abs(b.x1 - a.x1) <= 0.8 * h))
    return met.groupBy("doc_id", "block_idx").agg(F.min_by("next_idx", F.struct("ny1", "nx1", "next_idx")).alias("next_idx"))


def owned_by_others(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Values with a label other than their owner's to the left on their line: a semi-join."""
    a, b = Box.of("l"), Box.of()
    same = (values.doc_id == labels.doc_id) & (values.page == labels.page) & (labels.label_idx != values.owner_idx)
    return values.join(labels, same & (a.x2 <= b.x1) & (upright(a, b) > 0.5), "left_semi")


def free_values(blocks: DataFrame, labels: DataFrame, claimed: DataFrame) -> DataFrame:
    """Blocks that are neither labels nor claimed: anti-joins."""
    return blocks.join(labels.select("doc_id", F.col("label_idx").alias("block_idx")), ["doc_id", "block_idx"], "left_anti").join(claimed, ["doc_id", "block_idx"], "left_anti")


def digit_islands(blocks: DataFrame, most: int = 4) -> DataFrame:
    """Runs of digit blocks side by side on a line, in groups of at most `most`: one row each with two or more.

    Gaps and islands: a block starts an island unless it lies on the line of the one before, at most
    one and a half heights away. Islands never span pages.
    """
    digits = blocks.where(all_digits(F.col("text"))).withColumn("digits", digits_only(F.col("text")))
    line = Window.partitionBy("doc_id", "page").orderBy("y1", "x1", "block_idx")
    before = digits.select("*", *[F.lag(c).over(line).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = Box.of("b"), Box.of()
    h = F.greatest(a.height, F.lit(1.0))
    joined = (upright(a, b) > 0.5) & (b.x1 - a.x2).between(-0.2 * h, 1.5 * h)
    marked = before.withColumn("starts", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    island = marked.withColumn("island", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.floor((F.row_number().over(Window.partitionBy("doc_id", "page", "island").orderBy("y1", "x1", "block_idx")) - 1) / most)
    return merged(island.withColumn("part", part), ["doc_id", "page", "island", "part"], "digits", "").where("n_parts > 1")


def merged(blocks: DataFrame, by: list[str], text: str, between: str) -> DataFrame:
    """One block for each group: the box around, the least confidence, texts joined in order, and the parts."""
    rows = F.sort_array(F.collect_list(F.struct("y1", "x1", "block_idx", F.col(text).alias("t"))))
    told = blocks.groupBy(*by).agg(F.min("x1").alias("mx1"), F.min("y1").alias("my1"), F.max("x2").alias("mx2"), F.max("y2").alias("my2"), F.min("confidence").alias("confidence"), rows.alias("rows"))
    return told.select(*by, F.array_join(F.transform("rows", lambda r: r["t"]), between).alias("text"), "confidence", F.col("mx1").alias("x1"), F.col("my1").alias("y1"), F.col("mx2").alias("x2"), F.col("my2").alias("y2"), F.transform("rows", lambda r: r["block_idx"]).alias("parts"), F.size("rows").alias("n_parts"))


def column_walk(anchors: DataFrame, blocks: DataFrame, most: int, reach: float = 1.6) -> DataFrame:
    """The blocks that go on under each anchor in its column, in order: doc_id, anchor_idx, lines.

    anchors: doc_id, page, anchor_idx, a-prefixed box. blocks also have stop (boolean). From top to bottom a block ends the walk if it
    lies further than `reach` heights under the last line taken, or is a stop; it is passed over if it stands in another
    column. The walk is a fold over a document's sorted blocks, as its cursor moves with the lines it takes.
    """
    a, b = Box.of("a"), Box.of()
    h = F.greatest(a.height, F.lit(1.0))
    met = anchors.join(blocks, ["doc_id", "page"]).where((F.col("anchor_idx") != F.col("block_idx")) & (b.y1 >= a.y1 - 0.3 * h))
    met = met.withColumn("h", h).withColumn("inside", (across(a, b) > 0.15) | (F.abs(b.x1 - a.x1) <= 4.0 * h))
    row = F.struct("y1", "x1", "block_idx", "y2", "stop", "inside", "text")
    lists = met.groupBy("doc_id", "anchor_idx").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("h").alias("h"), F.first("ay2").alias("low"), F.first("h").alias("ah"))
    start = F.struct(F.col("low").alias("low"), F.col("ah").alias("high"), F.lit(False).alias("over"), F.array().cast("array<struct<block_idx:int,text:string>>").alias("lines"))

    def step(s, r):
        over = s["over"] | (F.size(s["lines"]) >= most) | (r["y1"] - s["low"] > reach * F.greatest(s["high"], F.col("h"))) | r["stop"]
        take = ~over & r["inside"]
        return F.struct(
            F.when(take, r["y2"]).otherwise(s["low"]).alias("low"),
            F.when(take, F.greatest(r["y2"] - r["y1"], F.lit(0.0))).otherwise(s["high"]).alias("high"),
            over.alias("over"),
            F.when(take, F.concat(s["lines"], F.array(F.struct(r["block_idx"].cast("int").alias("block_idx"), r["text"].alias("text"))))).otherwise(s["lines"]).alias("lines"),
        )

    return lists.select("doc_id", "anchor_idx", F.aggregate("rows", start, step)["lines"].alias("lines"))
