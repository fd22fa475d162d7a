"""Language identification by compression.

Every language has a raw-content zstandard dictionary, made of a bounded sample of labelled texts.
A text is cut into blocks, so that the dictionary counts and not the text's own
history; each block is compressed with each dictionary, and the language with the smallest
sum wins. Where the runner-up's sum is too close, the text is rejected.
"""

from __future__ import annotations

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_map, pick
from inkfield.llm.wordtok import per_worker

SAMPLE_TEXTS = 400  # different labelled texts taken a language, at most
SAMPLE_CHARS = 4_000  # characters taken of each, in a row, from a place that its hash tells
DICTIONARY = 1 << 17  # bytes of a dictionary at most
BLOCK = 1 << 10  # bytes compressed at a time
MARGIN = 0.002  # least share of the bytes by which the winner has to be smaller
UNKNOWN = "und"
TOLD = "lang_pred string, score double, margin double"
SCHEMA = f"doc_id long, {TOLD}"
LETTER = regex.compile(r"\p{L}")
SPACES = regex.compile(r"\s+")


def folded(text: str) -> bytes:
    """Lower case with single spaces: what is compressed."""
    return SPACES.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for each language among the labelled rows whose crc32(id) mod 3 is not 1,
    the language with the most rows first.

    The sample is those different texts with the smallest hashes, at most `texts` for each language and
    `chars` characters of each, from a place in the text that the hash tells: its size does not grow with the
    table, and it does not depend on the order of rows. Rows with a null id, text or language teach nothing; a
    row that is repeated teaches once.
    """
    rows = pick(df, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    taught = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    counts = dict(taught.groupBy("lang").count().collect())
    if not counts:
        return {}
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 63) * min(1.0, 4 * texts / n)) - 1)])
    begin = 1 + F.pmod(F.col("spot"), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    some = taught.withColumn("spot", spot).where(F.col("spot") <= bound[F.col("lang")]).select("lang", "spot", F.substring("text", begin, F.lit(chars)).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    some = some.groupBy("lang", "spot").agg(F.min("text").alias("text")).withColumn("n", first).where(F.col("n") <= texts)
    sample: dict[str, list] = {k: [] for k in counts}
    for lang, at, text in some.select("lang", "spot", "text").collect():
        sample[lang].append((at, text))
    return {lang: dictionary([t for _, t in sorted(found)], size) for lang, found in sorted(sample.items(), key=lambda x: (-counts[x[0]], x[0]))}


def dictionary(texts: list[str], size: int) -> bytes:
    """Different texts in turn, a few hundred bytes of each, until the dictionary is full."""
    own = list(dict.fromkeys(folded(t) for t in texts if LETTER.search(t)))
    step, parts, total, at = 512, [], 0, 0
    while own and total < size:
        own = [t for t in own if len(t) > at]
        for t in own:
            parts.append(t[at : at + step])
            total += len(parts[-1])
            if total >= size:
                break
        at += step
    return b" ".join(parts)[-size:]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int):
        self.block = block
        options = zstandard.ZstdCompressionParameters.from_level(3, window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.by_lang = {}
        for lang, raw in dictionaries.items():
            shaped = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shaped.precompute_compress(compression_params=options)
            self.by_lang[lang] = zstandard.ZstdCompressor(dict_data=shaped, compression_params=options)

    def sizes(self, raw: bytes) -> list[tuple[int, int, str]]:
        """Compressed bytes, rank and name of every language, smallest first; a tie goes to the language with more labelled rows."""
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), rank, lang) for rank, (lang, c) in enumerate(self.by_lang.items()))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, margin as a share of the smallest size."""
        if not text or not self.by_lang or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        found = self.sizes(folded(text))
        if len(found) == 1:
            return found[0][2], 1.0, 1.0
        best, other = found[0][0], found[1][0]
        margin = (other - best) / max(best, 1)
        return found[0][2], min(1.0, 0.5 + 5 * margin), margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, margin: float = MARGIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row, and the columns of `keep`.

    The whole text is compressed. A null text or one without a letter is `und` with score 0, and rejected;
    so is everything if no language was learned. Other texts get the language with the
    smallest size (ties: the one with more labelled rows) and are rejected if the margin over
    the second is under `margin`, texts of any length alike; so a tie is rejected. Repeated rows and null
    ids are rows like others; other columns are ignored; an empty table gives no row.
    """
    shipped = df.sparkSession.sparkContext.broadcast(dictionaries)
    key = ("language", hash(tuple(sorted(dictionaries.items()))), block)
    names = [id_col, text_col, *(k for k in keep if k not in (id_col, text_col))]
    rows = pick(df, *names)
    if keep:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + f", {TOLD}"
    else:
        rows, schema = rows.select(F.col(id_col).cast("long").alias("doc_id"), text_col), SCHEMA

    def make():
        known = per_worker(key, lambda: Classifier(shipped.value, block))

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            found = [known.classify(t.as_py()) for t in batch.column(1)]
            told = {n: batch.column(i) for i, n in enumerate(names) if n in keep} if keep else {"doc_id": batch.column(0)}
            yield told | {n: [x[i] for x in found] for i, n in enumerate(("lang_pred", "score", "margin"))}

        return step

    return arrow_map(rows, make, schema).withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < margin))


def language_digest(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row, learned from the table itself.

    held_out is false for a null id. With no row to learn from, all texts are `und`; an empty table gives no row.
    """
    told = identify(df, learn(df))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
