"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone; those that come out as
their own single token are proven whole. A pre-token among them counts one without any
merging. The rest are merged by the library's model, and the count of each chunk of text
between two spaces is remembered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import arrow_map, pick
from inkfield.llm.wordtok import WordEncoder, byte_letters, load_spec, per_worker, spec_key

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def prove_whole(spec: str) -> frozenset[str]:
    """The pre-tokens that encode alone as one token; at most the vocabulary."""
    encoder = WordEncoder(spec)
    letters = byte_letters()
    names = []
    suffix = encoder.bare.model.end_of_word_suffix
    for name, number in encoder.bare.get_vocab(with_added_tokens=False).items():
        if not name.endswith(suffix) or any(c not in letters for c in name.removesuffix(suffix)):
            continue
        try:
            text = bytes(letters[c] for c in name.removesuffix(suffix)).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text and encoder.words.fullmatch(text) and not text.isspace():
            names.append((text, number))
    coded = encoder.bare.encode_batch_fast([t for t, _ in names], add_special_tokens=False)
    return frozenset(t for (t, n), e in zip(names, coded, strict=True) if e.ids == [n])


class TokenCounter(WordEncoder):
    def __init__(self, spec: str, whole: frozenset[str]):
        super().__init__(spec)
        self.whole = whole

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        normal = self.normal(text)
        if normal is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total = 0
        for chunks in self.slices(normal):
            known = self.known(chunks)
            total += sum(map(known.__getitem__, chunks))
        return total

    def word(self, word: str) -> int:
        """A pre-token proven whole counts one; another one is merged."""
        return 1 if word in self.whole else len(self.merged(word))

    def joined(self, parts: list[int]) -> int:
        return sum(parts)

    def split_by_library(self, chunks: list[str]) -> list[int]:
        """Counts of chunks, their pre-tokens proven whole at once and the others in one call."""
        counts, rest, owner = [], [], []
        for i, c in enumerate(chunks):
            words = self.words.findall(c)
            others = [w for w in words if w not in self.whole]
            counts.append(len(words) - len(others))
            rest += others
            owner += [i] * len(others)
        if rest:
            for i, raw in zip(owner, super().split_by_library(rest), strict=True):
                counts[i] += len(raw) // self.kind.itemsize
        return counts


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, as the library counts them.

    tokenizer: path of a tokenizers file with a word-level BPE. A null or empty text has no
    bytes and no tokens. Null ids and repeated rows stay as they are, a row for each row;
    an empty table gives none; other columns are ignored. Texts of any length are counted
    whole, in slices of bounded size. over_limit: more than `limit` tokens.
    """
    spec = load_spec(tokenizer)
    sc = df.sparkSession.sparkContext
    shipped, proven, key = sc.broadcast(spec), sc.broadcast(prove_whole(spec)), ("count", spec_key(spec))

    def make():
        counter = per_worker(key, lambda: TokenCounter(shipped.value, proven.value))

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            texts = batch.column(1).to_pylist()
            yield {
                "doc_id": batch.column(0),
                "n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts],
                "n_tokens": [counter.count(t) for t in texts],
            }

        return step

    rows = pick(df, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col))
    return arrow_map(rows, make, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
