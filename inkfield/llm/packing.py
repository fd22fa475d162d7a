"""Packing by minimum bin slack.

Every task packs the documents it reads. A document longer than a sequence gives full
pieces and a remainder. Remainders gather until a window is full; then, sequence by
sequence, the longest one left is taken and a subset-sum dynamic programme over bitsets
finds the multiset of remaining lengths that fills what is left best. Counts are
backtracked from the stored bitsets, and the same multiset is used again as long as all
its lengths last. What no multiset fills exactly is topped up with a cut, so that only a
task's last sequence has padding. Nothing is shuffled and a task holds one window.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_map, pick
from inkfield.llm.wordtok import WordEncoder, load_spec, per_worker, spec_key

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
WINDOW = 1 << 20  # tokens a task gathers before it packs


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length bring the sum closest to room from below.

    lengths: those with a count, descending. Bit s of a bitset says that sum s can be reached;
    copies of a length are added in powers of two, and the bitset before each addition is kept.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for size in lengths:
        left = min(counts[size], room // size) if size <= room else 0
        copies = 1
        while left:
            copies = min(copies, left)
            trail.append((size, copies, reach))
            reach |= (reach << (copies * size)) & mask
            left -= copies
            copies *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for size, copies, before in reversed(trail):
        if not before >> at & 1:
            at -= copies * size
            used[size] += copies
    return used


class Packer:
    """Packs pieces (payload, length) into sequences; state of one task."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.waiting: dict[int, list] = defaultdict(list)  # by length
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        """piece: (doc_id, start, ids, doc_tokens) of at most the capacity."""
        self.waiting[len(piece[2])].append(piece)
        self.tokens += len(piece[2])

    def take(self, size: int) -> tuple:
        held = self.waiting[size]
        piece = held.pop()
        if not held:
            del self.waiting[size]
        self.tokens -= size
        return piece

    def sequences(self, last: bool):
        """Full sequences, as lists of pieces; with last also the one that stays short."""
        while self.tokens >= self.capacity or last and self.tokens:
            anchor = max(self.waiting)
            room = self.capacity - anchor
            counts = {k: len(v) for k, v in self.waiting.items()}
            counts[anchor] -= 1
            used = best_fill(sorted((k for k, v in counts.items() if v), reverse=True), counts, room) if room else {}
            filled = anchor + sum(k * n for k, n in used.items())
            counts[anchor] += 1
            need = dict(used)
            need[anchor] = need.get(anchor, 0) + 1
            repeats = min(counts[k] // n for k, n in need.items()) if filled == self.capacity else 1
            for _ in range(repeats):
                bin_ = [self.take(k) for k in sorted(need, reverse=True) for _ in range(need[k])]
                slack = self.capacity - filled
                if slack and self.tokens:  # every piece left is longer than the slack
                    doc, start, ids, total = self.take(min(self.waiting))
                    bin_.append((doc, start, ids[:slack], total))
                    self.add((doc, start + slack, ids[slack:], total))
                yield bin_


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `capacity` tokens.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset; the pieces of a sequence are gapless from offset 0. A null or
    empty text is a document of the end id alone. Null ids and repeated rows are documents
    of their own; an empty table gives no piece; other columns are ignored. Long texts
    are cut into full sequences and a remainder. A sequence id holds the number of
    the task that made it, so a task that is run again gives the same rows.
    """
    spec = load_spec(tokenizer)
    shipped, key = df.sparkSession.sparkContext.broadcast(spec), ("ids", spec_key(spec))

    def make():
        encoder = per_worker(key, lambda: WordEncoder(shipped.value))
        packer = Packer(capacity)
        number = TaskContext.get().partitionId() << 32
        out: dict[str, list] = {}

        def clear() -> None:
            nonlocal out
            out = {k.split()[0]: [] for k in SCHEMA.split(", ")}

        def put(bin_: list) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in bin_:
                row = (doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                offset += len(ids)
            number += 1

        clear()
        held = 0

        def step(batch):
            nonlocal held
            if batch is not None:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.append(encoder.encode(text.as_py()), encoder.kind.type(end_id))
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        put([(doc, start, ids[start : start + capacity], len(ids))])
                    if whole < len(ids):
                        packer.add((doc, whole, ids[whole:].copy(), len(ids)))
                    held += len(ids)
                    if packer.tokens >= window:
                        for bin_ in packer.sequences(last=False):
                            put(bin_)
                    if held >= window:
                        yield out
                        clear()
                        held = 0
            else:
                for bin_ in packer.sequences(last=True):
                    put(bin_)
                if out["doc_id"]:
                    yield out

        return step

    rows = pick(df, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col))
    return arrow_map(rows, make, SCHEMA, even=False)  # every further task pads a sequence more


def pack_digest(pieces: DataFrame) -> DataFrame:
    """A row for each piece of pack(), the checksum of its ids instead of the ids; null ids and empty texts as there."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
