"""Fast exact encoding with a word-level BPE of the tokenizers library.

A text is normalised as the library does it and split at white space. White space
never lies inside a pre-token, so what a chunk between two spaces encodes to does not
depend on its surroundings: it is looked up, and only chunks not seen before are cut into
pre-tokens, whose merges the library's model makes. Chunks beyond Latin-1, where versions of
Unicode may differ in what a letter is, go to the library's own splitting, many at a time. Texts with
a special string or a control character that the two notions of white space treat differently go to
the library whole.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import regex

SLICE = 1 << 19  # characters handled at a time
CACHE = 300_000  # chunks a generation of the cache holds; two generations are kept
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPLITS = [{"behavior": "Removed", "invert": True}, {"add_prefix_space": False, "use_regex": False}]  # what a spec has to do with pre-tokens


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in own):
        table[chr(256 + n)] = b
    return table


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Encodes whole texts as Tokenizer.encode(text, add_special_tokens=False) does."""

    def __init__(self, spec: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        suffix = parsed["model"].get("end_of_word_suffix")
        if parsed["model"]["type"] != "BPE" or not suffix:
            raise ValueError("a BPE whose words end in a suffix is needed")
        self.bare = Tokenizer.from_str(json.dumps(parsed | {"normalizer": None, "added_tokens": []}))
        vocab = parsed["model"]["vocab"]
        self.size = 1 + max(max(vocab.values()), max((t["id"] for t in parsed["added_tokens"]), default=0))
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        steps = parsed["pre_tokenizer"].get("pretokenizers", [])
        if [p["type"] for p in steps] != ["Split", "ByteLevel"] or any(p[k] != v for p, least in zip(steps, SPLITS, strict=True) for k, v in least.items()):
            raise ValueError("a pre-tokenizer that splits by a pattern and maps bytes is needed")
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.model = self.bare.model
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.specials = [t["content"] for t in parsed["added_tokens"]]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normal(self, text: str) -> str | None:
        """The library's normal form up to white space; None if the text has to go to the library whole."""
        if ODD_SPACE.search(text) or any(s in text for s in self.specials):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text)
        return text.lower()  # below U+0100 all is composed and lower case is one to one

    def slices(self, text: str) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > SLICE:
            cut = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
            if cut <= at:  # one word beyond the slice: take it whole
                found = regex.compile(r"\s").search(text, at + SLICE)
                cut = found.start() if found else len(text)
            yield text[at:cut].split()
            at = cut
        yield text[at:].split()

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; none for null."""
        if not text:
            return np.empty(0, self.kind)
        normal = self.normal(text)
        if normal is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        out = []
        for chunks in self.slices(normal):
            known = self.known(chunks)
            out.append(b"".join(map(known.__getitem__, chunks)))
        return np.frombuffer(b"".join(out), self.kind)

    def known(self, chunks: list[str]) -> dict[str, bytes]:
        """A dict with all of these chunks: the newer generation of the cache."""
        new = self.new
        missing = {c for c in chunks if c not in new}
        if missing:
            if len(new) + len(missing) > CACHE:
                self.old, self.new = new, {}
                new, missing = self.new, set(chunks)
            old = self.old
            unseen = []
            for c in missing:
                if c in old:
                    new[c] = old[c]
                else:
                    unseen.append(c)
            if unseen:
                new.update(zip(unseen, self.resolve(unseen), strict=True))
        return new

    def resolve(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: those of their pre-tokens, one after the other."""
        out: list = [None] * len(chunks)
        far = []
        for i, c in enumerate(chunks):
            if not c.isascii() and max(c) > "\xff":
                far.append(i)
            elif c.isalpha():
                out[i] = self.word(c)
            else:
                out[i] = self.joined([self.part(w) for w in self.words.findall(c)])
        if far:
            for i, found in zip(far, self.split_by_library([chunks[i] for i in far]), strict=True):
                out[i] = found
        return out

    def part(self, word: str):
        """What a pre-token of a longer chunk has; remembered as a chunk is."""
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            self.new[word] = found = self.word(word) if found is None else found
        return found

    def word(self, word: str):
        """Ids of a pre-token."""
        return array(self.code, self.merged(word)).tobytes()

    def merged(self, word: str) -> list[int]:
        raw = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(raw)]

    def joined(self, parts: list):
        return b"".join(parts)

    def split_by_library(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, encoded in one call and cut apart at the tokens that end a pre-token."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, self.kind)
        counts = np.fromiter((len(self.words.findall(c)) for c in chunks), np.int64, len(chunks))
        last = np.flatnonzero(self.ends[ids])
        if len(last) != counts.sum():  # never so with a vocabulary whose words all end in the suffix
            return [np.array(self.bare.encode(c, add_special_tokens=False).ids, self.kind).tobytes() for c in chunks]
        bounds = np.concatenate(([0], last + 1))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        raw, w = ids.tobytes(), self.kind.itemsize
        return [raw[a * w : b * w] for a, b in zip(bounds, bounds[1:], strict=False)]


_ready: dict[tuple, object] = {}


def per_worker(key: tuple, build):
    """One object a Python worker for a key; workers live on over tasks, so caches stay warm."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = build()
    return _ready[key]


def spec_key(spec: str) -> int:
    return zlib.crc32(spec.encode("utf-8"))
