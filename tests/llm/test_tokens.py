import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkfield.llm.packing import Packer, best_fill, pack, pack_digest
from inkfield.llm.tokencount import TokenCounter, count_tokens, prove_whole
from inkfield.llm.tokenfile import ShardReader, decode_block, encode_block, read_token_files, token_file_digest, write_token_files
from inkfield.llm.wordtok import WordEncoder, load_spec

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPEC = load_spec(PATH)
ENCODER = WordEncoder(SPEC)
WHOLE = prove_whole(SPEC)
COUNTER = TokenCounter(SPEC, WHOLE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcAZ '.,\n\t\x1c\x85\xa0éßİıΣσς0９٣Ǆ가각ﬁ́<|endoftext>🙂")), max_size=40) | st.text(max_size=30))
def test_encoding_and_counts_are_the_librarys(text):
    assert ENCODER.encode(text).tolist() == ids(text)
    assert COUNTER.count(text) == len(ids(text))


def test_special_strings_and_long_texts():
    for text in ("a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", "word " * 200_000, "z" * 700_000, "'s's don't I'LL"):
        assert ENCODER.encode(text).tolist() == ids(text)
        assert COUNTER.count(text) == len(ids(text))


def test_proven_words_are_single_tokens():
    assert len(WHOLE) > 30_000
    some = sorted(WHOLE)[::97]
    assert all(len(ids(w)) == 1 for w in some)


def test_counts(messy, nothing):
    found = count_tokens(messy, PATH, limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [tuple(r)[1] for r in messy.collect()]
    told = [(r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()]
    assert sorted(told) == sorted((len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for t in texts)
    assert count_tokens(nothing, PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 40))
def test_best_fill_is_the_best_subset(sizes, room):
    counts = {s: sizes.count(s) for s in sizes}
    used = best_fill(sorted(counts, reverse=True), counts, room)
    assert all(n <= counts[s] for s, n in used.items())
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums}
    assert sum(s * n for s, n in used.items()) == max(x for x in sums if x <= room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_only_the_last_sequence_is_short(sizes):
    packer = Packer(64)
    for i, n in enumerate(sizes):
        packer.add((i, 0, np.full(n, i), n))
    bins = list(packer.sequences(last=True))
    filled = [sum(len(p[2]) for p in x) for x in bins]
    assert sum(filled) == sum(sizes) and all(f == 64 for f in filled[:-1]) and all(f <= 64 for f in filled)


def documents(messy):
    return [(r[0], [*ids(r[1]), 1]) for r in map(tuple, messy.collect())]


def test_packing_keeps_every_id_once(messy, nothing):
    pieces = pack(messy, PATH, capacity=256, window=2000).collect()
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0) and p.length == len(p.ids) // 4 > 0
        at[p.sequence_id] = p.offset + p.length
    assert max(at.values()) <= 256
    assert sum(n < 256 for n in at.values()) <= messy.rdd.getNumPartitions()
    want = {}
    for doc, tokens in documents(messy):
        for token in tokens:
            want[doc, token] = want.get((doc, token), 0) + 1
    got = {}
    for p in pieces:
        for token in np.frombuffer(p.ids, "<u4").tolist():
            got[p.doc_id, token] = got.get((p.doc_id, token), 0) + 1
    assert got == want
    assert pack(nothing, PATH).collect() == []
    row = pack_digest(pack(messy, PATH)).where("doc_id = 200").first()
    assert (row.start, row.length, row.doc_tokens, row.ids_crc32) == (0, 1, 1, zlib.crc32(np.array([1], "<u4").tobytes()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=300))
def test_blocks_round_trip(values):
    block = np.array(values, "<u4")
    assert decode_block(encode_block(block)).tolist() == values


def test_outliers_go_to_the_exception_list():
    block = np.array([5] * 990 + [2**31] * 10, "<u4")
    assert len(encode_block(block)) < 120 and (decode_block(encode_block(block)) == block).all()


def test_token_files(spark, messy, nothing, tmp_path):
    shards = write_token_files(messy, PATH, f"file://{tmp_path}/t")
    rows = sorted(read_token_files(spark, shards).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    want = sorted((-1 if d is None else d, tuple(t)) for d, t in documents(messy))
    assert sorted((k, tuple(np.frombuffer(r.ids, "<u4").tolist())) for k, r in zip(keys, rows, strict=True)) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    shard = max(shards, key=lambda s: s["ids"])
    reader = ShardReader(shard["uri"])
    for start, count in ((0, 5), (8190, 9), (shard["ids"] - 3, 3), (20_000, 20_000)):
        assert (reader.read(start, count) == whole[shard["base"] + start :][:count]).all()
    reader.close()
    assert write_token_files(nothing, PATH, f"file://{tmp_path}/n") == [] and token_file_digest(spark, nothing, PATH).collect() == []


def test_a_damaged_file_is_refused(spark, messy, tmp_path):
    shard = write_token_files(messy, PATH, f"file://{tmp_path}/t")[0]
    path = shard["uri"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[-60] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        ShardReader(shard["uri"])
