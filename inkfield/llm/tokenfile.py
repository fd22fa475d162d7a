"""Token ids in files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents as one stream, cut into blocks. Of a
block the minimum is subtracted; what is left is packed at the width that holds a given
percentile of the values, and values above it keep their low bits there and put the rest in
an exception list. The footer has the start of every block, so any id is found
with one seek, and the documents' ids and lengths.

    shard   = block* footer trailer
    block   = u32 minimum, u32 count, u8 width, u32 exceptions,
              positions u32[exceptions], high parts u32[exceptions], packed bits
    footer  = u64 block start[blocks], i64 doc id[docs], u8 id is not null[docs], i64 tokens[docs]
    trailer = u64 footer start, u64 blocks, u64 docs, u32 block size, u32 crc of footer, 8 bytes "PFORIDS1"
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_map, new_path, pick
from inkfield.llm.wordtok import WordEncoder, load_spec, per_worker, spec_key

MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<IIBI")
TRAILER = struct.Struct("<QQQII8s")
BLOCK = 8192
PERCENTILE = 0.98
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
FLUSH = 1 << 22  # bytes of ids a reading task sends at a time


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    place = min(len(rest) - 1, int(percentile * len(rest)))
    width = int(np.partition(rest, place)[place]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    odd = np.flatnonzero(high).astype("<u4")
    kept = rest & np.uint32((1 << width) - 1)
    bits = np.unpackbits(kept.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return HEAD.pack(low, len(rest), width, len(odd)) + odd.tobytes() + high[odd].astype("<u4").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    low, count, width, odd = HEAD.unpack_from(raw)
    at = HEAD.size
    place = np.frombuffer(raw, "<u4", odd, at)
    high = np.frombuffer(raw, "<u4", odd, at + 4 * odd)
    packed = np.frombuffer(raw, np.uint8, (count * width + 7) // 8, at + 8 * odd)
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(packed, bitorder="little", count=count * width).reshape(count, width)
    values = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    values[place] |= high << np.uint32(width)
    return values + np.uint32(low)


def filesystem(uri: str):
    """The Arrow file system and path of a URI; on a cluster any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard under a name of its own and moves it to its place at the end."""

    def __init__(self, uri: str, block: int = BLOCK):
        self.uri, self.block = uri, block
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.at, self.starts, self.docs, self.pending, self.held = 0, [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.pending)
            whole = len(joined) // self.block * self.block
            for i in range(0, whole, self.block):
                self.write(joined[i : i + self.block])
            self.pending, self.held = [joined[whole:]], len(joined) - whole

    def write(self, ids: np.ndarray) -> None:
        raw = encode_block(ids)
        self.starts.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> tuple[int, int]:
        """Documents and ids of the shard."""
        if self.held:
            self.write(np.concatenate(self.pending))
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        lengths = np.array([n for _, n in self.docs], "<i8")
        footer = np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + known.tobytes() + lengths.tobytes()
        self.out.write(footer + TRAILER.pack(self.at, len(self.starts), len(self.docs), self.block, zlib.crc32(footer), MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.docs), int(lengths.sum())


class ShardReader:
    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        self.end, blocks, docs, self.block, crc, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        footer = self.file.read_at(size - TRAILER.size - self.end, self.end)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{uri} is no whole token file")
        self.starts = np.frombuffer(footer, "<u8", blocks)
        self.ids = np.frombuffer(footer, "<i8", docs, 8 * blocks)
        self.known = np.frombuffer(footer, np.uint8, docs, 8 * (blocks + docs))
        self.lengths = np.frombuffer(footer, "<i8", docs, 8 * (blocks + docs) + docs)

    def read_block(self, k: int) -> np.ndarray:
        at = int(self.starts[k])
        to = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.end
        return decode_block(self.file.read_at(to - at, at))

    def read(self, start: int, count: int) -> np.ndarray:
        """Any ids of the shard's stream, through the index of block starts."""
        if not count:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        joined = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return joined[start - first * self.block :][:count]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in order; every block is read once."""
        held, k = np.empty(0, "<u4"), 0
        for doc, known, n in zip(self.ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.read_block(k))
                have += len(parts[-1])
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else held
            yield doc if known else None, joined[:n]
            held = joined[n:]

    def close(self) -> None:
        self.file.close()


def write_token_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> list[dict]:
    """Writes all documents' ids below path in ascending id order; returns the shards in order.

    Every shard: uri, docs, ids, base (ids before it); the list grows with the partitions,
    not with the documents. A null or empty text gives the end id alone; null ids come
    first; rows with equal ids stand in the order of their texts' hashes. An empty table
    gives no shard. Other columns are ignored. The rows are dealt out by range and sorted by
    Spark, which spills; a task that is run again writes the same shard anew.
    """
    spec = load_spec(tokenizer)
    shipped, key = df.sparkSession.sparkContext.broadcast(spec), ("ids", spec_key(spec))
    rows = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def make():
        encoder = per_worker(key, lambda: WordEncoder(shipped.value))
        number, writer = TaskContext.get().partitionId(), None

        def step(batch):
            nonlocal writer
            if batch is None:
                if writer:
                    docs, ids = writer.close()
                    yield {"shard": [number], "docs": [docs], "ids": [ids]}
                return
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or ShardWriter(f"{path}/{number:06d}.pfor")
                writer.add(doc, np.append(encoder.encode(text.as_py()), encoder.kind.type(end_id)))

        return step

    made = sorted(arrow_map(dealt, make, "shard long, docs long, ids long").collect())
    shards, base = [], 0
    for shard, docs, ids in made:
        shards.append({"uri": f"{path}/{shard:06d}.pfor", "docs": docs, "ids": ids, "base": base})
        base += ids
    return shards


def read_token_files(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, a task a shard."""
    if not shards:
        return spark.createDataFrame([], READ_SCHEMA)
    listed = [(s["uri"], s["base"]) for s in shards]

    def make():
        def step(batch):
            for n in batch.column(0).to_pylist() if batch is not None else ():
                uri, start = listed[n]
                reader = ShardReader(uri)
                out, size = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}, 0
                for doc, ids in reader.documents():
                    raw = ids.astype("<u4", copy=False).tobytes()
                    for column, value in zip(out.values(), (doc, start, len(ids), raw), strict=True):
                        column.append(value)
                    start += len(ids)
                    size += len(raw)
                    if size >= FLUSH:
                        yield out
                        out, size = {k: [] for k in out}, 0
                reader.close()
                yield out

        return step

    return arrow_map(spark.range(0, len(listed), 1, len(listed)), make, READ_SCHEMA)


def token_file_digest(spark: SparkSession, df: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each document, read back from files written below the shared folder: its place, length and checksum.

    Null and repeated ids, null texts, clashing columns and empty tables as write_token_files() has them.
    """
    shards = write_token_files(df, tokenizer, new_path(spark, "ids"))
    return read_token_files(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

