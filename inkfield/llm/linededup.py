"""Line dedup by a segment-partition edit join.

Two lines within `edits` edits share one of edits + 1 even segments of the shorter one, at
a place that differs by few characters. Every line therefore has keys: its own
segments, and the substrings that a shorter or equally long line's segments could be
(length, segment number and text go into the key). Lines that share a key and have close
lengths and character counts are verified with a banded bit-parallel edit distance.
Classes of lines follow from the links, and of each class the first occurrence stays.

Exact copies are found by a 128-bit hash, with JVM functions alone. The first pass over the keys keeps
only those that two lines have; they go into a Bloom filter of fixed size, so that the second
pass sends on only lines that may have a partner. Where the filter is full it lets more
lines through, and the exact join after it still holds.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import Written, arrow_map, pick
from inkfield.llm.linkage import resolve

SPACE = " \t\r\f\v"  # cut off at both ends of a line
BLOOM_BITS = 1 << 26
BINS = 16


def segment_starts(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of even segments, the longer ones last."""
    base, longer = divmod(length, parts)
    sizes = [base + (k >= parts - longer) for k in range(parts)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(parts)]


def windows(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(start, end, seed of the hash) of a line's keys; the lines it is compared with are as long or shorter."""
    found = []
    for gap in range(edits + 1):
        other = length - gap
        if other <= edits:
            break
        for k, (start, size) in enumerate(segment_starts(other, edits + 1)):
            low = max(start - k, start + gap - (edits - k), 0)
            high = min(start + k, start + gap + (edits - k), length - size)
            found += [(p, p + size, other * (edits + 1) + k) for p in range(low, high + 1)]
    return found


def keys_of(line: str, layout: dict[int, list]) -> list[int]:
    """Signed 64-bit keys of a line; layout remembers windows by length."""
    raw = line.encode("latin-1") if line.isascii() else None
    out = []
    for start, end, seed in layout[len(line)]:
        part = raw[start:end] if raw is not None else line[start:end].encode("utf-8", "surrogatepass")
        out.append(xxhash.xxh3_64_intdigest(part, seed) - (1 << 63))
    return out


class Layout(dict):
    """Windows by line length; forgets them when there are many."""

    def __init__(self, edits: int):
        self.edits = edits

    def __missing__(self, length: int) -> list:
        if len(self) > 20_000:
            self.clear()
        self[length] = found = windows(length, self.edits)
        return found


def item_of(line: str) -> int:
    """What Spark's xxhash64 gives for the line."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8"), 42)
    return h - (1 << 64) if h >> 63 else h


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most edits (under 32): banded and bit-parallel.

    What the two share at both ends is cut off. Of each column of the distance matrix only a
    band of 64 rows is kept, as two bit vectors of the steps between rows; the value that
    is followed runs down the band's lower diagonal to the last row, and then along it.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    lead = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(a))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or len(b) <= edits:
        return len(b) <= edits
    a, b = b, a  # rows: the longer one
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    mask, top = (1 << 64) - 1, 1 << 63
    plus, minus = mask & ~((1 << (63 - edits)) - 1), 0
    value, first, row = edits, edits - 63, top >> 1
    for j, c in enumerate(b):
        at = places.get(c, 0)
        match = (at >> first if first >= 0 else at << -first) & mask
        down = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        right_plus = (minus | ~(down | plus)) & mask
        right_minus = down & plus
        if j < len(a) - edits:  # still on the diagonal
            value += not down & top
            if value > 2 * edits + len(a) - len(b):
                return False
        else:
            value += bool(right_plus & row) - bool(right_minus & row)
            row >>= 1
        plus = (right_minus | ~((down >> 1) | right_plus)) & mask
        minus = (down >> 1) & right_plus
        first += 1
    return value <= edits


def occurrences(rows: DataFrame, least: int) -> DataFrame:
    """item, more (128 bits of hash together) and the place of every line of at least `least` characters."""
    lines = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.length("line") >= least)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "line_no").alias("place")
    return lines.select(F.xxhash64("line").alias("item"), F.xxhash64(F.lit(7), "line").alias("more"), place)


def line_keys(rows: DataFrame, edits: int, least: int) -> DataFrame:
    """key, item of every line, once for each batch of texts."""

    def make():
        layout = Layout(edits)

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            for lines in some_lines(batch.column(0), least):
                keys = [keys_of(x, layout) for x in lines]
                items = np.fromiter((item_of(x) for x in lines), np.int64, len(lines))
                yield {"key": np.concatenate([np.array(k, np.int64) for k in keys]), "item": np.repeat(items, [len(k) for k in keys])}

        return step

    return arrow_map(rows.select("text"), make, "key long, item long")


def some_lines(texts, least: int, characters: int = 1 << 22):
    """Distinct lines of at least `least` characters, in lists of bounded size."""
    seen: set[str] = set()
    held = 0
    for text in texts:
        for line in (text.as_py() or "").split("\n"):
            line = line.strip(SPACE)
            if len(line) >= least and line not in seen:
                seen.add(line)
                held += len(line) + 200
        if held >= characters:
            yield list(seen)
            seen, held = set(), 0
    if seen:
        yield list(seen)


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """Words of a Bloom filter with two bits a key; the driver gets at most bits / 64 rows."""
    spots = keys.select(F.explode(F.array(*[F.expr(f"(shiftrightunsigned(key, {s})) & {bits - 1}") for s in (0, 32)])).alias("spot"))
    words = spots.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("mask"))
    table = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def candidate_lines(rows: DataFrame, edits: int, least: int, filled: np.ndarray) -> DataFrame:
    """item, line, counts of characters and the keys that the filter knows, of lines that have such keys."""
    sc = rows.sparkSession.sparkContext
    shipped, bits = sc.broadcast(filled), len(filled) * 64

    def make():
        layout, table = Layout(edits), shipped.value

        def known(keys: np.ndarray) -> np.ndarray:
            u = keys.view(np.uint64)
            hit = np.ones(len(u), bool)
            for s in (0, 32):
                spot = (u >> np.uint64(s)) & np.uint64(bits - 1)
                hit &= (table[(spot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (spot & np.uint64(63))) & np.uint64(1) == 1
            return hit

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            for lines in some_lines(batch.column(0), least):
                out = {"item": [], "line": [], "counts": [], "keys": []}
                per = [np.array(keys_of(x, layout), np.int64) for x in lines]
                ends = np.cumsum([len(k) for k in per])
                hits = np.split(known(np.concatenate(per)), ends[:-1])
                for line, keys, hit in zip(lines, per, hits, strict=True):
                    if hit.any():
                        out["item"].append(item_of(line))
                        out["line"].append(line)
                        out["counts"].append(np.bincount(np.frombuffer(line.encode("utf-32-le"), "<u4") % BINS, minlength=BINS).astype(np.int32))
                        out["keys"].append(keys[hit])
                yield out

        return step

    return arrow_map(rows.select("text"), make, "item long, line string, counts array<int>, keys array<long>").dropDuplicates(["item"])


def near(edits: int) -> str:
    """SQL condition on the counts of two lines: an edit changes the sum of differences by two at most."""
    return f"aggregate(zip_with(counts_a, counts_b, (p, q) -> abs(p - q)), 0, (s, d) -> s + d) <= {2 * edits}"


def line_classes(rows: DataFrame, edits: int, least: int, bits: int) -> Written:
    """node (item of a line), component of the lines that others are within `edits` edits of."""
    shared = Written(line_keys(rows, edits, least).groupBy("key").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("key"), "keys")
    lines = Written(candidate_lines(rows, edits, least, bloom(shared.read(), bits)), "lines")
    posted = lines.read().select("item", "counts", F.explode("keys").alias("key")).dropDuplicates(["item", "key"])
    buckets = Written(posted.join(shared.read(), "key", "left_semi").select("key", "item", "counts", F.xxhash64("item").alias("rank")), "postings")
    shared.drop()

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda name: lines.read().select(F.col("item").alias(name), F.col("line").alias(f"line_{name}"), F.col("counts").alias(f"counts_{name}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(near(edits))

        def make():
            def step(batch):
                if batch is not None and batch.num_rows:
                    held = [(a, b) for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if within(s, t, edits)]
                    yield {"a": [a for a, _ in held], "b": [b for _, b in held]}

            return step

        return arrow_map(met.select("a", "b", "line_a", "line_b"), make, "a long, b long")

    found = resolve(buckets.read(), verify, near(edits))
    for t in (lines, buckets):
        t.drop()
    return found


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 16, bits: int = BLOOM_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every row, and the columns of `keep`.

    Lines are split at line feeds and compared without white space at their ends. A line
    of at least `least` characters goes if an equal line, or one that chains of links of at
    most `edits` edits lead to, stands earlier: at a smaller id (null ids last), or earlier
    in the document. Shorter lines always stay. A null text stays null and has no line. Rows
    with one id and text are one document and come out alike; rows of one id with
    different texts stand in the order of their texts' hashes. Other columns are ignored;
    an empty table gives no row. Lines and texts of any length are compared whole. In the
    edit join a line is known by a 64-bit hash.
    """
    if not 0 <= edits < 32 or least <= edits:
        raise ValueError("edits must be under 32 and under the least length of a line")
    rows = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = line_classes(rows, edits, least, bits)
    places = occurrences(rows, least)
    classes = places.groupBy("item", "more").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    classes = classes.join(found.read().withColumnRenamed("node", "item"), "item", "left")
    merged = Written(classes.where("component is not null or first <> last"), "classes")
    close = merged.read().where("component is not null")
    best = close.groupBy("component").agg(F.min("first").alias("stays"))
    equal = merged.read().where("component is null").select("item", "more", F.col("first").alias("stays"))
    decided = close.join(best, "component").select("item", "more", "stays").union(equal)
    gone = places.join(decided, ["item", "more"]).where("place <> stays").select("place.doc_id", "place.text_hash", "place.line_no")
    gone = Written(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone")), "gone")
    for t in (found, merged):
        t.drop()
    lost = gone.read().toDF("g_id", "g_hash", "gone")
    names = [n for n in keep if n not in (id_col, text_col)]
    rows = pick(df, id_col, text_col, *names).toDF("doc_id", "text", *[f"c{i}" for i in range(len(names))]).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    told = rows.join(lost, rows.doc_id.eqNullSafe(lost.g_id) & (rows.text_hash == lost.g_hash), "left")
    lines = F.split("text", "\n")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return told.select("doc_id", text.alias("text"), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], count.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_digest(kept: DataFrame) -> DataFrame:
    """A row for each row of dedup_lines(), with the length and checksum of its text; null for a null text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))
