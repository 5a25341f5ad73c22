import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folialis.llm import bpe
from folialis.llm.packing import Plan, context_length, context_lengths, pack, tier_of

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.tokenizer_file()), reason="no tokenizer files")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_file())
    t.encode_special_tokens = True
    v = bpe.Vocabulary(bpe.tokenizer_file())
    return bpe.Replay(v.byte_ids, v.merges), t


CASES = ["", " ", "a", "aaaaaaaaaaaa", "<|endoftext|> is text", "  \n\t x", "it's we'll", "图像融合研究，方法", "é ﬁ ½ 👍🏽", "x" * 5000, "12345 6.7e8", "ab ab  ab\r\n"]


@pytest.mark.parametrize("s", CASES)
def test_like_the_public_tokenizer(both, s):
    own, public = both
    assert next(own.encode([s])) == public.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, s):
    own, public = both
    assert next(own.encode([s])) == public.encode(s, add_special_tokens=False).ids


def test_column(spark, both):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CASES)] + [(99, None), (0, "")], "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    rows = bpe.token_ids(df, "doc_id", "text").collect()
    assert len(rows) == len(CASES) + 2 and all(r.ids == [] for r in rows if r.doc_id == 99)
    assert {r.doc_id: len(r.ids) for r in rows if r.doc_id} == {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect() if r.doc_id}
    assert bpe.token_ids(df.where("false"), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(64, 100))
def test_plan_holds_every_item_once(lengths, capacity):
    counts = {x: lengths.count(x) for x in lengths}
    p = Plan(counts, capacity)
    held = {x: 0 for x in counts}
    for m, pattern in p.patterns:
        assert m > 0 and sum(s * u for s, u in pattern.items()) <= capacity
        for s, u in pattern.items():
            held[s] += m * u
    assert held == counts
    assert p.windows <= -(-sum(lengths) // capacity) * 1.5 + 1
    for s in counts:
        spans = sorted((a, b) for x, a, b, *_ in p.rows() if x == s)
        assert spans[0][0] == 0 and spans[-1][1] == counts[s] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_pack(spark):
    texts = [(i, " word" * (i % 37)) for i in range(300)] + [(1000, " word" * 205), (1001, None), (1002, ""), (5, " word" * 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 as len", "'x' as item", "1 as rank")
    rows = pack(df, "doc_id", "text", 64, group=4).collect()
    load, slots = {}, set()
    for r in rows:
        load[r.prompt_id] = load.get(r.prompt_id, 0) + r.n_tokens
        if r.n_tokens:
            assert (r.prompt_id, r.slot) not in slots and r.tier == tier_of(r.n_tokens, 64)
            slots.add((r.prompt_id, r.slot))
    total = sum(len(t or "") // 5 for _, t in texts)
    assert max(load.values()) <= 64 and sum(load.values()) == total and len(load) <= -(-total // 64) + 2
    assert [(r.piece, r.first_token, r.n_tokens) for r in sorted((r for r in rows if r.doc_id == 1000), key=lambda r: r.piece)] == [(1, 0, 64), (2, 64, 64), (3, 128, 64), (4, 192, 13)]
    assert all(sum(1 for r in rows if r.doc_id == i) == 1 for i in range(300) if i != 5)
    steps = {}
    for r in rows:
        steps[r.step_id] = steps.get(r.step_id, 0) + r.n_tokens
    assert max(steps.values()) <= 4 * 64
    assert pack(df.where("false"), "doc_id", "text", 64).count() == 0
    assert pack(df.where("doc_id = 1001"), "doc_id", "text", 64).first().prompt_id == 0


def test_context_length(spark):
    m = spark.createDataFrame([(" a ", None, 512), ("b", "x", None), ("", "y", 1)], "id string, name string, context_length int")
    assert context_length(m, "a") == 512
    with pytest.raises(ValueError, match="b"):
        context_length(m, "b")


def test_several_lengths(spark):
    import random

    r = random.Random(4)
    sizes = [r.choice([1, 3, 7, 20, 60, 61, 120, 250, 300]) for _ in range(600)]
    df = spark.createDataFrame([(i, " word" * n) for i, n in enumerate(sizes)] + [(1000, None)], "doc_id long, text string")
    rows = pack(df, "doc_id", "text", [64, 256, 128]).collect()
    load, room = {}, {}
    for x in rows:
        load[x.prompt_id] = load.get(x.prompt_id, 0) + x.n_tokens
        assert room.setdefault(x.prompt_id, x.context_length) == x.context_length
    assert set(room.values()) == {64, 128, 256} and all(n <= room[p] for p, n in load.items())
    assert sum(room.values()) - sum(load.values()) <= 0.03 * sum(sizes) + 256
    split = {x.doc_id for x in rows if x.piece > 1}
    assert split == {i for i, n in enumerate(sizes) if n > 256}
    with pytest.raises(ValueError, match="one token"):
        pack(df, "doc_id", "text", [])


def test_plans_are_nearly_linear():
    import time

    counts = {n: 1 + 7919 * n % 13 for n in range(1, 131_073)}
    began = time.perf_counter()
    p = Plan(counts, [131_072, 16_384, 2_048])
    assert time.perf_counter() - began < 30 and sum(m * u for m, x in p.patterns for u in x.values()) == sum(counts.values())


def test_context_lengths(spark):
    m = spark.createDataFrame([("b", "x", 512, ["chat"]), (" a ", None, 512, None), ("c", "y", 64, ["embeddings"]), ("d", "z", 1024, [])], "id string, name string, context_length int, supported_protocols array<string>")
    assert context_lengths(m) == {512: "a", 1024: "d"}
