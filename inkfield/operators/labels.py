"""Label recognition: texts against the alias catalogue.

The catalogue is a few dozen literals of a compiled expression, so nothing is broadcast. Blocks repeat their texts,
labels above all, so each different text is matched once and its label is joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.catalogue import ALIASES, FUZZY
from inkfield.functions.text import clean_value, normalize


PLACES = 100  # at least as many as the catalogue has aliases
STEPS = 10**9  # of similarity


def catalogue() -> list[dict]:
    """Aliases, longest first, with what their matching needs."""
    rows = []
    for field, aliases in ALIASES.items():
        for alias in aliases:
            least = next(t for n, t in FUZZY if n is None or len(alias) <= n)
            rows.append({"field": field, "alias": alias, "compact": alias.replace(" ", ""), "size": len(alias), "least": least, "slack": max(2.0, len(alias) * 0.25), "edits": math.ceil(len(alias) * (1 - least))})
    rows.sort(key=lambda r: -r["size"])
    if len(rows) > PLACES:
        raise ValueError(f"the keys of labels have room for {PLACES} aliases")
    return [r | {"rank": n} for n, r in enumerate(rows)]


def catalogue_frame(spark) -> DataFrame:
    rows = catalogue()
    return spark.createDataFrame([tuple(r.values()) for r in rows], "field string, alias string, compact string, size int, least double, slack double, edits int, rank int")


def catalogue_array() -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in catalogue()])


def evaluate(words: Column, joined: Column, alias: Column) -> Column:
    """How alike a folded text and an alias are: whole 1, start 1, joined 0.99, joined start 0.98, else by edits; null if not enough."""
    distance = F.levenshtein(words, alias["alias"])
    alike = 1.0 - distance / F.greatest(F.length(words), alias["size"])
    close = (alias["least"] < 1.0) & (F.abs(F.length(words) - alias["size"]) <= alias["slack"])
    return (
        F.when((words == alias["alias"]) | F.startswith(words, F.concat(alias["alias"], F.lit(" "))), 1.0)
        .when(joined == alias["compact"], 0.99)
        .when(F.startswith(joined, alias["compact"]), 0.98)
        .when(close, F.when((distance <= alias["edits"]) & (alike >= alias["least"]), alike))
    )


def inline_part(text: Column, letters: Column) -> Column:
    """What follows after so many letters and digits of the text, cleaned; null if nothing."""
    pattern = F.concat(F.lit(r"(?s)^(?:[^\p{L}\p{Nd}]*[\p{L}\p{Nd}]){"), letters.cast("string"), F.lit(r"}(.*)$"))
    rest = clean_value(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    return F.when(rest != "", rest)


def key_of(words: Column, joined: Column, a: dict) -> Column:
    """Similarity and rank of one alias in one number, the better the larger; null if it does not match. All literals, so it is compiled."""
    alias, distance = F.lit(a["alias"]), F.levenshtein(words, F.lit(a["alias"]), a["edits"])
    alike = F.when((words == alias) | F.startswith(words, F.lit(a["alias"] + " ")), 1.0).when(joined == a["compact"], 0.99).when(F.startswith(joined, F.lit(a["compact"])), 0.98)
    if a["least"] < 1:
        close = 1.0 - distance / F.greatest(F.length(words), F.lit(a["size"]))
        alike = alike.when((F.abs(F.length(words) - a["size"]) <= a["slack"]) & (distance >= 0) & (close >= a["least"]), close)
    return F.round(alike * STEPS).cast("long") * PLACES + (PLACES - 1 - a["rank"])


def best_key(words: Column, joined: Column) -> Column:
    """The greatest key; more alike wins, then the longer alias."""
    return F.greatest(*[F.when(words != "", key_of(words, joined, a)) for a in catalogue()])


def told(text: Column, words: Column, joined: Column, key: Column) -> Column:
    """struct<field, alias, similarity, inline> of the alias with this key; null without one."""
    rows = catalogue()
    place = PLACES - 1 - F.pmod(key, F.lit(PLACES))
    of = lambda name: F.get(F.array(*[F.lit(r[name]) for r in rows]), place)
    sure = F.round(F.floor(key / PLACES) / STEPS, 9)
    exact = F.when(sure >= 0.98, sure).otherwise(1.0 - F.levenshtein(words, of("alias")) / F.greatest(F.length(words), of("size")))
    starts = (words != of("alias")) & (joined != of("compact")) & (sure >= 0.98) & F.startswith(joined, of("compact"))
    inline = F.when(starts, inline_part(text, F.length(of("compact"))))
    return F.when(key.isNotNull(), F.struct(of("field").alias("field"), of("alias").alias("alias"), exact.alias("similarity"), inline.alias("inline")))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable is bound, an expression used twice is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def label_of(text: Column) -> Column:
    """The label of any text as one expression; for whole tables with_labels is faster."""
    folded = let(normalize(text), lambda w: F.struct(w.alias("words"), F.replace(w, F.lit(" "), F.lit("")).alias("joined")))
    return let(folded, lambda f: let(best_key(f["words"], f["joined"]), lambda key: told(text, f["words"], f["joined"], key)))


def bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn as a generator of one row: a filter above is not pushed below it, which would put the whole
    expression into its condition, once for every use."""
    return rows.withColumn(name, F.explode(F.array(value)))


def matched(texts: DataFrame) -> DataFrame:
    """text, label of a table of texts, label null where a text is none: a map of compiled steps."""
    folded = bound(texts.select("text"), "_words", normalize(F.col("text"))).withColumn("_joined", F.replace("_words", F.lit(" "), F.lit("")))
    keyed = bound(folded, "_key", best_key(F.col("_words"), F.col("_joined")))
    return bound(keyed, "label", told(F.col("text"), F.col("_words"), F.col("_joined"), F.col("_key"))).select("text", "label")


def with_labels(blocks: DataFrame) -> DataFrame:
    """The blocks with a column label, null where a block is none. A text that many blocks have is one row of the matching;
    in the join back, adaptive execution splits it."""
    texts = matched(blocks.where("text is not null").groupBy("text").agg(F.lit(1).alias("one")))
    known = texts.where("label is not null").select(F.col("text").alias("_text"), "label")
    return blocks.join(known, F.col("text") == F.col("_text"), "left").drop("_text")


def grouped(labelled: DataFrame) -> DataFrame:
    """doc_id, page, rows: the blocks of a page in one row. What is taken from it twice is shuffled and matched once, as
    the exchange below is the same for both."""
    return labelled.groupBy("doc_id", "page").agg(F.collect_list(F.struct("block_idx", "text", "confidence", "x1", "y1", "x2", "y2", "label")).alias("rows"))
