"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks. With weight w its block j is released at
slot floor(j / w) and due at slot ceil((j + 1) / w); of the released blocks the one due first
takes the next slot. As the weights sum to one, every block meets its window, so that at
any slot a source is less than one block away from its share. Weights are exact fractions
and hold over the whole phase. When a source runs out, a new phase starts in which the
others share its weight.

Weights are read as the decimal numbers that they are written as, so that they repeat after a period of as many slots as
their whole-number proportions sum to, by which every source has exactly its share. The driver plans
one period for each phase, whatever the number of documents; tasks plan the others from the same start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_map, pick

PERIOD = 1024  # slots of a cycle at least
PER_SOURCE = 8  # slots of a cycle a source at least
STRETCH = 65_536  # slots that a task plans
BLOCK = 16  # documents a block
BUCKET = 4096  # documents of a source that are ranked together, about
LEVELS = 16  # different weights by default, from 1 on
MOST_BROADCAST = 200_000  # blocks of a plan that is broadcast, at most
WIDTHS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")  # of fixed width
PLACE = ("rank", "phase", "cycle", "slot", "place")


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole numbers of slots that sum to the period, at least one each: largest remainders. mix() does not round."""
    total = sum(weights.values())
    exact = {k: w / total * (period - len(weights)) for k, w in weights.items()}
    whole = {k: 1 + int(x) for k, x in exact.items()}
    rest = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))
    for k in rest[: period - sum(whole.values())]:
        whole[k] += 1
    return whole


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """The least whole numbers in exactly the proportions of the weights, floats as the shortest decimals that give them."""
    parts = {k: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for k, w in weights.items()}
    unit = lcm(*(x.denominator for x in parts.values()))
    common = gcd(*(int(x * unit) for x in parts.values()))
    return {k: int(x * unit) // common for k, x in parts.items()}


def taken(whole: Mapping[str, int], done: Mapping[str, int], slot: int = 0) -> Iterator[str]:
    """The source of each slot from `slot` on, by which `done` blocks of each source are placed."""
    total = sum(whole.values())
    ready: list[tuple[int, str, int]] = []
    later = [(done[k] * total // n, -(-(done[k] + 1) * total // n), k, done[k]) for k, n in whole.items()]
    heapq.heapify(later)
    while True:
        while later and later[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        due, k, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its window")
        yield k
        j, n, slot = j + 1, whole[k], slot + 1
        heapq.heappush(later, (j * total // n, -(-(j + 1) * total // n), k, j))


def schedule(slots: Mapping[str, int]) -> list[str]:
    """The source of each slot of a period: released blocks, earliest deadline first, ties by name."""
    return list(islice(taken(slots, dict.fromkeys(slots, 0)), sum(slots.values())))


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD, stretch: int = STRETCH) -> list[dict]:
    """Phases until all blocks are placed: first block and blocks of each source, whole-number weights, cycle, stretches.

    A phase ends with the last block of the first of its sources to run out. A stretch is its first slot, its slots
    and the blocks that each source has placed before; None for stretches of whole periods, which placed_before() knows. The
    periods that no source can run out in are not run through here.
    """
    left, first, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        whole = exact({k: weights[k] for k in left})
        total = sum(whole.values())
        periods = min((n - 1) // whole[k] for k, n in left.items())
        step, begin = max(1, stretch // total) * total, periods * total
        stretches: list[tuple] = [(at, min(step, begin - at), None) for at in range(0, begin, step)]
        done, starts = {k: periods * n for k, n in whole.items()}, []
        for slot, k in enumerate(taken(whole, done.copy(), begin), begin):
            if (slot - begin) % stretch == 0:
                starts.append((slot, done.copy()))
            done[k] += 1
            if done[k] == left[k]:
                break
        ends = [at for at, _ in starts[1:]] + [slot + 1]
        stretches += [(at, end - at, before) for (at, before), end in zip(starts, ends, strict=True)]
        out.append({"first": {k: first[k] for k in left}, "slots": done, "periods": 1, "weights": whole, "cycle": max(period, PER_SOURCE * len(left)), "stretches": stretches})
        for k, n in done.items():
            first[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
    return out


def placed_before(phase: dict, start: int) -> dict[str, int]:
    """Blocks of each source before a slot at which a period begins."""
    periods = start // sum(phase["weights"].values())
    return {k: n * periods for k, n in phase["weights"].items()}


def tempered(counts: Mapping[str, int], levels: int = LEVELS) -> dict[str, int]:
    """Target weights: the root of each source's documents, in whole numbers up to `levels` for the largest, so that large sources give way."""
    most = max(counts.values())
    return {k: max(1, round(levels * (n / most) ** 0.5)) for k, n in counts.items()}


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD, carry: bool = False) -> DataFrame:
    """All rows' places in the mixture: doc_id, source, rank, phase, cycle, slot, place.

    Documents of a source follow in the order of a hash of their id; `block` of them in a row are a
    block. (phase, cycle, slot, place) sorts the mixture: place is the number inside a
    block. weights: target by source, by default the square root of its documents; a
    source without a positive weight gets the smallest positive one (1 if there is none), so
    that no row is lost. A null source is a source of its own, with the empty name. Null ids
    and repeated rows are placed like others, their ties in any order. An empty table gives
    no row; other columns are ignored, or with carry kept in a struct `row` (fields c0, c1, ...).
    (phase, cycle, slot) is the slot in the whole phase, in cycles of `period` slots or 8 a source.
    The driver gets a count for each source and plans a period of every phase: as many steps as the
    weights sum to in whole numbers, at most LEVELS a source by default. Rows are
    ranked in hash buckets of bounded size with counts before each bucket, so that a large source
    is spread over all tasks; a null id is hashed by its row's other columns, without carry by those of fixed width.
    """
    rows = with_row(df, id_col, source_col, carry).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    counts = dict(rows.groupBy("source").count().collect())
    if not counts:
        return rows.select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in PLACE], *(["row"] if carry else []))  # no row
    given = dict(weights or tempered(counts))
    floor = min((w for w in given.values() if w > 0), default=1.0)
    given = {k: given[k] if given.get(k, 0) > 0 else floor for k in counts}
    bits = (max(counts.values()) // BUCKET).bit_length()
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNull(), F.col("other")).otherwise(F.xxhash64("doc_id"))).withColumn("bucket", F.expr(f"shiftrightunsigned(h, {64 - bits})") if bits else F.lit(0).cast("long"))
    per = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).select("source", "bucket", "before")
    inside = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "other")))
    ranked = inside.join(before, ["source", "bucket"]).withColumn("rank", F.col("before") + F.col("r") - 1).drop("h", "bucket", "before", "r", "other")
    plan = phases({k: -(-n // block) for k, n in counts.items()}, given, period)
    return placed(ranked, plan, block)


def with_row(df: DataFrame, id_col: str, source_col: str, carry: bool) -> DataFrame:
    """doc_id, source, a hash `other` of the columns of fixed width, so that no text is read for it, and with carry of all
    that can be hashed, and a struct of all columns by position, so that no names clash."""
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    both = pick(df, id_col, source_col).columns  # tells of a column that is missing
    found = [next((i for i, c in enumerate(df.columns) if c == n), None) for n in both]
    found = [next(i for i, c in enumerate(df.columns) if c.lower() == n.lower()) if at is None else at for at, n in zip(found, both, strict=True)]
    kinds = [(f.name, f.dataType.simpleString()) for f in unique.schema]
    hashed = [F.col(n) for n, kind in kinds if ("map<" not in kind and "variant" not in kind if carry else kind.partition("(")[0] in WIDTHS)]
    return unique.select(*[F.col(f"c{i}").alias(n) for i, n in zip(found, ("doc_id", "source"), strict=True)], (F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")).alias("other"), *([F.struct("*").alias("row")] if carry else []))


def placed(ranked: DataFrame, plan: list[dict], block: int) -> DataFrame:
    """Joins ranks with the plan: the phase and slot of each block of a source."""
    spark = ranked.sparkSession
    todo = [(p, i) for p, phase in enumerate(plan) for i in range(len(phase["stretches"]))]
    shipped = spark.sparkContext.broadcast(plan)

    def make():
        def step(batch):
            if batch is None:
                return
            for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                phase = shipped.value[p]
                start, n, before = phase["stretches"][i]
                before = before or placed_before(phase, start)
                sources = list(islice(taken(phase["weights"], before, start), n))
                at, numbers = {k: phase["first"][k] + x for k, x in before.items()}, []
                for k in sources:
                    numbers.append(at[k])
                    at[k] += 1
                yield {"source": sources, "number": numbers, "phase": [p] * n, "at": range(start, start + n), "per": [phase["cycle"]] * n}

        return step

    tasks = min(len(todo), 4 * spark.sparkContext.defaultParallelism)
    order = arrow_map(spark.createDataFrame(todo, "phase int, stretch int").repartition(tasks), make, "source string, number long, phase long, at long, per long")
    blocks = sum(sum(phase["slots"].values()) for phase in plan)
    small = (lambda x: F.broadcast(x)) if blocks <= MOST_BROADCAST else (lambda x: x)
    told = ranked.withColumn("number", F.floor(F.col("rank") / block)).join(small(order), ["source", "number"])
    told = told.withColumn("cycle", F.expr("at div per")).withColumn("slot", F.col("at") % F.col("per")).withColumn("place", F.col("rank") % block)
    return told.select("doc_id", "source", *PLACE, *(["row"] if "row" in ranked.columns else []))


def mixed_documents(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The table itself, all rows and columns, in the order of the mixture over its sorted partitions.

    As mix() does: null and repeated ids and null sources are rows like others, names may clash, an empty table gives no row.
    """
    places = mix(df, weights, id_col, source_col, block, carry=True)
    rows = places.orderBy("phase", "cycle", "slot", "place")
    return rows.select(*[F.col(f"row.c{i}") for i in range(len(df.columns))]).toDF(*df.columns)
