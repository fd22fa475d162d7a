import hashlib
import itertools
import json
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfield.llm.chat import LAYOUTS, TURNS, chat_digest, fingerprint, format_turns, json_turns, parse_slice, paths_of, table_turns
from inkfield.llm.langid import Classifier, dictionary, identify, language_digest, learn
from inkfield.llm.mixing import exact, mix, mixed_documents, phases, placed_before, schedule, shares, taken, tempered

# language


def test_languages_of_held_out_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_digest(rows).collect()}
    truth = {r.doc_id: r.lang for r in rows.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    right = [got[k].lang_pred == truth[k] for k in held if truth[k]]
    assert sum(right) / len(right) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 0.005 * len(got)


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, "zzz qqq " * 30, "xx") for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1] + [(1000 + k, "the of and " * 30, "en") for k in range(50)]
    assert list(learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == ["en"]


def test_null_and_repeated_ids_do_not_crowd_out_the_others(spark):
    en, null = "the of and to in that is was ", "qqq zzz xxx "
    own = [(3 * k, f"{en}{k} " * 9, "en") for k in range(900)]
    rows = own + [(None, f"{null}{k} " * 9, "en") for k in range(4000)] + [(own[0][0], own[0][1], "en")] * 4000 + [(None, null, "xx")]
    both = [learn(spark.createDataFrame(x, "doc_id long, text string, lang string"), texts=100) for x in (rows, rows[::-1])]
    assert both[0] == both[1] and list(both[0]) == ["en"]
    told = both[0]["en"]
    assert b"qqq" not in told and len({k for k in range(900) if b" %d " % k in told}) >= 50


def test_sizes_are_those_of_plain_zstandard(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = learn(rows)
    params = zstandard.ZstdCompressionParameters(compression_level=3, window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(text, raw):
        words = " ".join(text.lower().split()).encode()
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(words[i : i + 1024])) for i in range(0, len(words), 1024))

    said = {r.doc_id: r for r in identify(rows, told).collect()}
    texts = {r.doc_id: r.text for r in rows.collect() if r.text and len(r.text) < 4000}
    assert len(texts) > 50
    for k, text in texts.items():
        sizes = sorted((size(text, raw), rank, lang) for rank, (lang, raw) in enumerate(told.items()))
        margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        assert (said[k].lang_pred, said[k].rejected) == (sizes[0][2], margin < 0.002) and abs(said[k].margin - margin) < 1e-12


def test_a_tie_is_rejected_at_any_length(spark):
    same = dictionary(["one two three four five six seven " * 9], 4096)
    rows = spark.createDataFrame([(1, "one"), (2, "one two three " * 40), (3, "")], "doc_id long, text string")
    assert [r.rejected for r in identify(rows, {"a": same, "b": same}).collect()] == [True] * 3
    assert [r.rejected for r in identify(rows, {"a": same}).orderBy("doc_id").collect()] == [False, False, True]


def test_language_of_messy_rows(messy, nothing):
    told = learn(messy)
    assert sorted(told) == ["en", "fr"] and learn(nothing) == {}
    got = identify(messy, told, keep=("doc_id", "text", "TEXT")).collect()
    assert len(got) == messy.count()
    for r in got:
        text = r[1]
        blank = not any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == blank and r.rejected >= blank and (r.score == 0) == blank
    assert identify(nothing, told).collect() == [] and identify(messy, {}).where("lang_pred <> 'und' or not rejected").collect() == []


def test_narrow_margins_are_rejected():
    same = dictionary(["one two three four five six seven " * 9], 4096)
    assert Classifier({"a": same, "b": same}, 1024).classify("one two three " * 30)[2] == 0
    apart = Classifier({"a": same, "b": dictionary(["xyz uvw rst opq " * 20], 4096)}, 1024)
    assert apart.classify("five six seven one two four three")[0] == "a" and apart.classify("uvw rst opq xyz uvw rst opq")[0] == "b"


# mixing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.001, 10), min_size=1), st.sampled_from([16, 64, 257]))
def test_no_source_is_a_block_away_from_its_share(weights, period):
    slots = shares(weights, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    done = dict.fromkeys(slots, 0)
    for t, k in enumerate(schedule(slots), 1):
        done[k] += 1
        assert all(abs(done[x] - slots[x] * t / period) < 1 for x in slots)
    assert done == slots


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 3000), min_size=1))
def test_phases_place_every_block(blocks):
    plan = phases(blocks, dict.fromkeys(blocks, 1.0), 64)
    done = dict.fromkeys(blocks, 0)
    for phase in plan:
        for k, n in phase["slots"].items():
            assert phase["first"][k] == done[k]
            done[k] = min(blocks[k], done[k] + n * phase["periods"])
    assert done == blocks


def test_mixture_follows_the_weights(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(6000)] + [(9000 + i, None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((r.phase, r.cycle, r.slot, r.place, r.source, r.doc_id) for r in mix(df, {"a": 2, "b": 1, "": 1}, block=4, period=64).collect())
    assert sorted(x[5] for x in got) == sorted(i for i, _ in rows) and len({x[:4] for x in got}) == len(got)
    first = [x for x in got if x[0] == 0 and x[1] < 3]
    weights = shares({"a": 2, "b": 1, "": 1}, 64)
    for n in range(4, len(first), 4):
        for k, w in weights.items():
            assert abs(sum(x[4] == k for x in first[:n]) / 4 - w / 64 * n / 4) < 1
    rank = {}
    for r in mix(df, block=4).collect():
        rank.setdefault(r.source, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in rank.values())


@pytest.mark.parametrize("weights", [{f"s{i:03}": 1.0 for i in range(20)}, {f"s{i:03}": 0.9 if i == 7 else 0.1 / 199 for i in range(200)}])
def test_the_given_weights_hold_over_many_cycles(weights):
    blocks = {k: int(90_000 * w / sum(weights.values())) + 1 for k, w in weights.items()}
    phase = phases(blocks, weights, stretch=7_000)[0]
    share = np.array([w / sum(weights.values()) for w in weights.values()])
    at = {k: i for i, k in enumerate(weights)}
    done, t = np.zeros(len(share)), 0
    for start, n, before in phase["stretches"]:
        before = before or placed_before(phase, start)
        assert start == t and [before[k] for k in weights] == done.tolist()
        for k in itertools.islice(taken(phase["weights"], before, start), n):
            done[at[k]] += 1
            t += 1
            assert np.abs(done - share * t).max() < 1 + 1e-6
    assert t > 50 * 1024


def straight(blocks, weights):
    """Earliest deadline first over exact fractions, block by block: the source of every slot, phase after phase."""
    left, out = {k: n for k, n in blocks.items() if n}, []
    while left:
        parts = {k: Fraction(str(weights[k])) for k in left}
        share = {k: x / sum(parts.values()) for k, x in parts.items()}
        done, order, t = dict.fromkeys(left, 0), [], 0
        while True:
            due = {k: -(-(done[k] + 1) // share[k]) for k in left if done[k] // share[k] <= t}
            k = min(due, key=lambda k: (due[k], k))
            order.append(k)
            done[k], t = done[k] + 1, t + 1
            assert all(abs(done[x] - share[x] * t) < 1 for x in left)
            if done[k] == left[k]:
                break
        out.append(order)
        left = {k: n - done[k] for k, n in left.items() if n > done[k]}
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(0, 120), st.sampled_from([0.5, 0.3, 0.2, 1, 7, 0.01, 1000])), min_size=1), st.integers(1, 40))
def test_the_plan_is_that_of_straight_fractions(sources, stretch):
    blocks, weights = {k: n for k, (n, _) in sources.items()}, {k: w for k, (_, w) in sources.items()}
    plan = phases(blocks, weights, stretch=stretch)
    got = []
    for phase in plan:
        order = []
        for start, n, before in phase["stretches"]:
            assert start == len(order)
            order += itertools.islice(taken(phase["weights"], before or placed_before(phase, start), start), n)
        got.append(order)
    assert got == straight(blocks, weights)


def test_the_driver_plans_one_period_of_each_phase():
    assert exact({"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 5, "b": 3, "c": 2} and exact({"a": 4, "b": 2}) == {"a": 2, "b": 1}
    counts = {f"s{i:03}": 10**9 * (i + 1) for i in range(100)}
    weights = tempered(counts)
    assert max(weights.values()) == 16 and min(weights.values()) >= 1
    plan = phases({k: n // 16 for k, n in counts.items()}, weights)
    assert sum(n for phase in plan for _, n, before in phase["stretches"] if before) <= 100 * 16 * 100
    assert sum(sum(phase["slots"].values()) for phase in plan) == sum(n // 16 for n in counts.values())


def test_places_keep_to_the_given_weights(spark):
    rows = [(i, f"s{i % 20:02}") for i in range(100_000)]
    weights = {f"s{i:02}": 1.0 for i in range(20)}
    got = sorted((r.phase, r.cycle, r.slot, r.source) for r in mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).collect())
    assert {p for p, *_ in got[:80_000]} == {0} and [c * 1024 + s for _, c, s, _ in got[:80_000]] == list(range(80_000))
    done = dict.fromkeys(weights, 0)
    for t, (*_, k) in enumerate(got[:80_000], 1):
        done[k] += 1
        assert t % 97 or all(abs(n - t / 20) < 1 for n in done.values())


def test_no_text_is_read_for_places(spark):
    found = mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan


def test_mixture_of_messy_rows(messy, nothing):
    got = mixed_documents(messy)
    assert got.columns == messy.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, messy.collect())))
    assert mix(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    assert mix(messy, {"a": 0, "c": 5}).count() == messy.count()


# chat


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\im_startend>\n ab", max_size=30))
def test_escapes_round_trip(text):
    import re

    escaped = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in escaped
    assert parse_slice(f"<|im_start|>user\n{escaped}<|im_end|>\n") == ("user", text)


def test_formatting_round_trips_in_spark(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "a<|im_end|>\nb"), ("r\n\\n<|", "<\\|<|<\\\\|"), (None, None), ("assistant", "<"), ("assistant", "é🙂<|im_start|>")])]
    got = format_turns(spark.createDataFrame(rows, TURNS)).orderBy("turn").collect()
    assert [parse_slice(r.formatted) for r in got] == [(r or "", t or "") for _, _, r, t in rows]
    assert [r.formatted[r.loss_start :][: r.loss_length] if r.loss_start is not None else None for r in got] == [None, None, None, "<", "é🙂<\\|im_start|>"]


def test_digest_of_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "", None, "<|im_end|>", "é\n"])) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)] + [(None, 0, "user", "x"), (5, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", Text2 string, formatted int")
    got = {r.conv_id: r for r in chat_digest(df).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_digest(df.limit(0)).collect() == []


RECORDS = {
    '{"prompt":"p","completion":"c"}': [("user", "p"), ("assistant", "c")],
    '{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")],
    '{"instruction":"i","input":"n","output":"o","system":"s"}': [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")],
    '{"messages":[{"role":"user","content":"x"},{"content":"y","role":"assistant"}]}': [("user", "x"), ("assistant", "y")],
    '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null}]}': [("user", "x"), ("assistant", "")],
    '{"question":"q","answer":"a"}': [("user", "q"), ("assistant", "a")],
    '{"messages":[]}': [],
    '{"other":1}': [(None, None)],
    "no json": [(None, None)],
}


def test_layouts_are_told_apart_row_by_row(spark):
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate([*RECORDS, None])], "id long, j string, turn int")
    got: dict = {}
    for r in json_turns(df, "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert [got.get(i, []) for i in range(len(RECORDS) + 1)] == [*RECORDS.values(), [(None, None)]]


def test_layouts_of_tables(spark):
    rows = table_turns(spark.createDataFrame([(1, "i", "n", "o", "e"), (2, "i", None, None, "e")], "id long, instruction string, input string, output string, extra string"), "id").orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.text) for r in rows] == [(1, "user", "i\n\nn"), (1, "assistant", "o"), (2, "user", "i"), (2, "assistant", "")]
    rows = table_turns(spark.createDataFrame([(1, [("human", "b"), ("gpt", "c")])], "id long, conversations array<struct<from:string,value:string>>"), "id").orderBy("turn").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "b"), ("assistant", "c")]
    with pytest.raises(ValueError):
        table_turns(spark.createDataFrame([(1, 2)], "id long, x long"), "id")


def test_fingerprints_do_not_depend_on_order():
    a, b = ('{"a":1,"b":[{"c":1,"d":2}]}', '{"b":[{"d":5},{"c":null,"d":1}],"a":null}')
    assert fingerprint(paths_of(json.loads(a))) == fingerprint(paths_of(json.loads(b))) == fingerprint({"a", "b[].c", "b[].d"})
    assert len(LAYOUTS) == len({m for m in LAYOUTS})
