"""Near-duplicate documents by an inverted join over signature coordinates.

A document is the set of its word shingles, hashed to 64 bits; its signature has the
minimum of 64 hash functions. Documents with equal sets are one class, so copies cost
nothing more. Every class is posted under its coordinate-value pairs. Two sets of
similarity 0.8 or more agree in at least 32 of 64 coordinates but for a chance of 2 in
100 million; two signatures that agree in 32 share one of the 33 rarest pairs of each, so
only the lists of these are merged (prefix), and values that no other class has are skipped. What meets
in a merged list has its collisions counted: the frequent pairs' lists are skipped over, and whether both
stand in them is looked up in the signatures. Whoever reaches 32 is
confirmed on the full sets. Before that, shingles that no other candidate has bound a
pair's similarity from above: a class with too many of its own is linked with nothing, so
families of loose copies do not meet pair by pair; and 1024 more coordinates of four bits each deny
pairs that are far apart, a pair at the threshold with a chance of under 1 in a billion.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import Written, arrow_map, pick
from inkfield.llm.linkage import resolve
from inkfield.llm.vectors import matrix
from inkfield.llm.wordtok import per_worker

COORDINATES, MATCHES = 64, 32
FINE, BITS = 1024, 4  # more coordinates, and the bits kept of each
DENIED = 1e-9  # chance at most that these deny a pair of the least similarity
SEED = 20_011
COLUMNS = 4096  # shingles times 64 values at a time
SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, signature array<int>"


class Words(dict):
    """64-bit hash of a word; forgets all words when it is full."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self, words: int, coordinates: int = COORDINATES):
        rng = np.random.default_rng(SEED)
        self.words, self.known = words, Words()
        self.factors = rng.integers(1, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = (rng.integers(1, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, coordinates, np.uint64)[:, None]

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word shingles; fewer words than a shingle count as one."""
        split = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
        if not split:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        n = len(h) - self.words + 1
        if n < 1:
            h, n = np.concatenate((h, np.full(self.words - len(h), len(h), np.uint64))), 1
        total = np.zeros(n, np.uint64)
        for i, factor in enumerate(self.factors):
            total += mixed(h[i : i + n]) * factor
        return np.unique(mixed(total))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        step = COLUMNS * COORDINATES // len(self.a)
        for i in range(0, len(shingles), step):
            least = np.minimum(least, (shingles[i : i + step] * self.a + self.b).min(axis=1))
        return least

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return (self.minima(shingles) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    def make():
        shingler = per_worker(("shingles", words), lambda: Shingler(words))

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            out = {"doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": [], "digest": [], "signature": []}
            for text in batch.column(1):
                s = shingler.shingles(text.as_py())
                out["n_shingles"].append(len(s))
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["signature"].append(shingler.signature(s) if len(s) else None)
            yield out

        return step

    return arrow_map(rows, make, SKETCH)


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """key, item: the rarest coordinate-value pairs of each class that other classes have too."""
    tokens = classes.select("item", F.posexplode("signature").alias("at", "value")).select("item", F.expr("shiftleft(cast(at as bigint), 32) | (value & 4294967295L)").alias("key"))
    shared = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    owned = tokens.join(shared, "key").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    prefix = COORDINATES - matches + 1  # of these, the pairs that no other class has come first
    room = F.greatest(F.size("own") - (COORDINATES - prefix), F.lit(0))
    return owned.select("item", F.explode(F.slice("own", F.lit(1), room)).alias("t")).select(F.col("t.key").alias("key"), "item")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """The pairs (a, b) with enough collisions, those in skipped lists looked up, whose intersection has at least `percent` of the union."""
    left = sets.select(F.col("item").alias("a"), F.col("shingles").alias("sa"), F.col("signature").alias("x"))
    right = sets.select(F.col("item").alias("b"), F.col("shingles").alias("sb"), F.col("signature").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "x", "y")

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            out = {"a": [], "b": []}
            agree = matrix(batch.column(4)) == matrix(batch.column(5))
            for i in np.flatnonzero(agree.sum(1) >= matches).tolist():
                x, y = np.frombuffer(batch.column(2)[i].as_py(), np.uint64), np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out["a"].append(batch.column(0)[i].as_py())
                    out["b"].append(batch.column(1)[i].as_py())
            yield out

        return step

    return arrow_map(met, make, "a long, b long")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """item, size, rest: shingles of each set, and those of them that another set has too."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            for i in range(0, batch.num_rows, 64):
                parts = [np.frombuffer(r.as_py(), np.int64) for r in batch.column(1)[i : i + 64]]
                yield {"item": np.repeat(batch.column(0)[i : i + 64].to_numpy(), [len(p) for p in parts]), "shingle": np.concatenate(parts)}

        return step

    every = arrow_map(sets.select("item", "shingles"), make, "item long, shingle long")
    owners = every.groupBy("shingle").agg(F.min("item").alias("item"), F.count("*").alias("n"))
    own = owners.where("n = 1").groupBy("item").agg(F.count("*").alias("own"))
    sized = sets.select("item", (F.length("shingles") / 8).cast("long").alias("size"))
    return sized.join(own, "item", "left").select("item", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("rest"))


def fine_bits(sets: DataFrame) -> DataFrame:
    """item, bits: four bits each of 1024 more minima, bit by bit. Two sets of similarity s agree in all four with chance s + (1 - s) / 16."""

    def make():
        more = per_worker(("bits",), lambda: Shingler(1, FINE))

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            bits = []
            for raw in batch.column(1):
                kept = (more.minima(np.frombuffer(raw.as_py(), np.uint64)) >> np.uint64(24)).astype(np.uint8)
                bits.append(np.packbits([kept >> k & 1 for k in range(BITS)], axis=1).ravel().view(np.int64))
            yield {"item": batch.column(0), "bits": bits}

        return step

    return arrow_map(sets.select("item", "shingles"), make, "item long, bits array<long>")


def most_apart(percent: int) -> int:
    """The least number of differing coordinates that a pair of the least similarity exceeds with a chance of at most DENIED."""
    differ, tail, k = (1 - percent / 100) * (1 - 2.0**-BITS), 0.0, FINE
    while k and tail + (now := comb(FINE, k) * differ**k * (1 - differ) ** (FINE - k)) <= DENIED:
        tail, k = tail + now, k - 1
    return k


def possible(percent: int) -> str:
    """SQL: whether two sets can be similar enough, by their sizes, by what of them other sets have at all, and by their bits."""
    words = FINE // 64
    differ = " + ".join("bit_count(" + " | ".join(f"(bits_a[{i + words * k}] ^ bits_b[{i + words * k}])" for k in range(BITS)) + ")" for i in range(words))
    return f"100 * least(rest_a, rest_b) >= {percent} * (size_a + size_b - least(rest_a, rest_b)) and {differ} <= {most_apart(percent)}"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: a row for each row of the table.

    Words are runs of other characters than the six ASCII spaces, A-Z in lower case; a set
    holds the distinct shingles of `words` words, or all words as one if there are fewer.
    Documents are linked from `percent` per cent Jaccard similarity. component_id is the
    smallest id that links reach. A null, empty or wordless text has an empty set and is linked with
    nothing. Rows with a null id take part in linking and are never kept; a component's id is
    the smallest that is not null, or null if it has none. Repeated rows have one
    set and one component; rows of one id with different texts are compared by text.
    Other columns are ignored; an empty table gives no row. Whole texts count.
    """
    spark = df.sparkSession
    rows = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    sketch = Written(sketches(rows, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))  # a document of the class, with the smallest id
    grouped = sketch.read().where("digest is not null").groupBy("digest").agg(first.alias("s"), F.first("signature").alias("signature"))
    grouped = grouped.select("digest", F.col("s.doc_id").alias("rep"), "s.text_hash", "signature", F.monotonically_increasing_id().alias("item"))
    classes = Written(grouped, "classes")
    buckets = Written(postings(classes.read(), matches), "postings")
    wanted = buckets.read().select("item").distinct()
    chosen = Written(classes.read().join(wanted, "item", "left_semi"), "candidates")
    sets = Written(class_sets(rows, chosen.read(), words), "sets")
    sizes = shared_sizes(sets.read()).where(f"100 * rest >= {percent} * size")  # else no link is possible
    known = Written(sizes.join(fine_bits(sets.read()), "item"), "known")
    ranked = known.read().select("item", (1 - F.col("rest") / F.col("size")).alias("rank"))
    viable = Written(buckets.read().join(ranked, "item"), "viable")
    found = resolve(viable.read(), lambda pairs: confirm(pairs, sets.read(), percent, matches), possible(percent), known.read())
    for t in (buckets, sets, chosen, known, viable):
        t.drop()
    items = classes.read().join(found.read().select(F.col("node").alias("item"), "component"), "item", "left").select("digest", "rep", F.coalesce("component", "item").alias("c"))
    least = items.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_digest = Written(items.join(least, "c").select("digest", "component_id"), "components")
    for t in (classes, found):
        t.drop()
    linked = sketch.read().join(by_digest.read(), "digest").select("doc_id", "n_shingles", "component_id", "text_hash")
    wordless = sketch.read().where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return linked.union(wordless).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash")


def class_sets(rows: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """item, shingles, signature of the chosen classes, made again from the text of a document of each."""
    same = rows.doc_id.eqNullSafe(chosen.rep) & (rows.text_hash == chosen.text_hash)
    texts = rows.join(chosen, same).select("item", "text", "digest", "signature")

    def make():
        shingler = per_worker(("shingles", words), lambda: Shingler(words))

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            out = {"item": [], "shingles": [], "signature": []}
            for item, text, digest, signature in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = shingler.shingles(text.as_py()).tobytes()
                if raw and xxhash.xxh3_128_digest(raw) == digest:
                    out["item"].append(item)
                    out["shingles"].append(raw)
                    out["signature"].append(signature.values)
            yield out

        return step

    return arrow_map(texts, make, "item long, shingles binary, signature array<int>").dropDuplicates(["item"])
