"""Classes of linked items, without all pairs of a group.

components() finds connected components by alternating large and small stars. resolve()
gets buckets of items that may be linked and a function that confirms pairs. A bucket
is compared with a few of its members, its hubs; what these link becomes one component,
and only pairs of different components are left. After a few rounds what is left of a
bucket is compared pair by pair, so no link between two components is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import Written


def components(edges: DataFrame, what: str = "stars") -> Written:
    """node, component (smallest node reachable) of all nodes that have an edge (a, b)."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Written(pairs, what)
    while not is_forest(now.read()):
        stars = now.read()
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(nearest.select("u", F.col("m").alias("v"))).distinct()
        following = Written(small, what)
        now.drop()
        now = following
    stars = now.read()
    out = Written(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), what)
    now.drop()
    return out


def is_forest(stars: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the centre of its component."""
    ends = stars.groupBy("u").agg(F.count("*").alias("n"))
    bad = ends.where("n > 1").select("u").union(ends.select("u").join(stars.select(F.col("v").alias("u")), "u", "left_semi"))
    return bad.isEmpty()


def resolve(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], close: str | None = None, known: DataFrame | None = None, rounds: int = 2) -> Written:
    """node, component of the items of buckets (key, item, rank, ...) that have a link.

    verify: takes candidate pairs (a, b) and returns the linked ones. close: a cheap necessary
    condition in SQL on the other columns of the buckets and on those of known (item, ...), which only what is left
    is joined with; _a and _b stand after their names. The first
    hub of a bucket is its item of least rank, the hub of a later round the one with the least hash under
    the round's seed; so buckets of one group mostly share their hub. Buckets that lie in one component
    are left out. What is left meets pair by pair, each pair in the least key that both have.
    """
    spark, links, found = buckets.sparkSession, None, None
    for step in range(rounds):
        at = labelled(buckets, found)
        order = F.xxhash64("item", F.lit(step)) if step else F.col("rank")
        hub = at.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("item").alias("hub"), F.col("c").alias("ch"))).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        hub = hub.where("lo <> hi").select("key", "s.hub", "s.ch")
        pairs = at.select("key", "item", "c").join(hub, "key").where("c <> ch").select(F.least("hub", "item").alias("a"), F.greatest("hub", "item").alias("b")).distinct()
        links, found = linked(verify, pairs, links, found)
    at = labelled(buckets, found)
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = Written(at.join(mixed, "key", "left_semi"), "rest")
    keys = rest.read().groupBy("item").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    full = Written(rest.read().join(keys if known is None else keys.join(known, "item"), "item"), "mixed")
    left, right = suffixed(full.read(), "a"), suffixed(full.read(), "b")
    close = f"key_a = key_b and item_a < item_b and c_a <> c_b and {close or 'true'} and key_a = array_min(array_intersect(keys_a, keys_b))"
    pairs = left.join(right, F.expr(close)).select(F.col("item_a").alias("a"), F.col("item_b").alias("b"))
    with compiled_methods(spark):
        asked = Written(pairs, "pairs")
    links, found = confirmed(verify, asked, links, found)
    for t in (rest, full, links):
        t.drop()
    return found


@contextmanager
def compiled_methods(spark: SparkSession):
    """No generated method over what the JVM compiles to machine code, 8000 bytes: a long condition on pairs is cut into several.

    Beyond that size a method is interpreted, for every pair.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def suffixed(rows: DataFrame, side: str) -> DataFrame:
    return rows.toDF(*[f"{c}_{side}" for c in rows.columns])


def labelled(buckets: DataFrame, found: Written | None) -> DataFrame:
    """The buckets with each item's component so far, c."""
    if found is None:
        return buckets.withColumn("c", F.col("item"))
    labels = found.read().select(F.col("node").alias("item"), "component")
    return buckets.join(labels, "item", "left").withColumn("c", F.coalesce("component", "item")).drop("component")


def linked(verify, pairs: DataFrame, links: Written | None, found: Written | None) -> tuple[Written, Written]:
    """All links so far, and their components."""
    return confirmed(verify, Written(pairs, "pairs"), links, found)


def confirmed(verify, asked: Written, links: Written | None, found: Written | None) -> tuple[Written, Written]:
    if found is not None and asked.read().isEmpty():
        asked.drop()
        return links, found
    more = verify(asked.read()).select("a", "b")
    if found is not None:  # stars of the components stand for the links before
        more = more.union(found.read().where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    now = Written(more, "links")
    asked.drop()
    for old in (links, found):
        if old is not None:
            old.drop()
    return now, components(now.read())
