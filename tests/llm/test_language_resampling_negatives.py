"""Language model, resampling and hard negatives against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hmm
from tallyloom.llm import negatives
from tallyloom.llm.negatives import FEW, hard_negatives
from tallyloom.llm.resampling import resampled

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- language model


def random_model(rng, symbols, states):
    share = lambda *n: (x := rng.random(n) + 0.01) / x.sum(-1, keepdims=True)
    return hmm.Model(share(states), share(states, states), share(states, symbols).T)


def by_paths(model, x):
    """(probability, expected starts, steps and emissions) over all paths of states."""
    states = len(model.start)
    total, starts, steps, emitted = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for path in itertools.product(range(states), repeat=len(x)):
        p = model.start[path[0]] * model.emit[x[0], path[0]]
        for a, b, s in zip(path, path[1:], x[1:]):
            p *= model.step[a, b] * model.emit[s, b]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            steps[a, b] += p
        for a, s in zip(path, x):
            emitted[s, a] += p
    return total, starts / total, steps / total, emitted / total


def test_recursions_equal_all_paths():
    rng = np.random.default_rng(3)
    model = random_model(rng, 5, 3)
    sequences = [rng.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6, 6, 2)]
    want = [by_paths(model, s) for s in sequences]
    assert np.allclose(hmm.log_likelihoods(model, sequences), [math.log10(w[0]) for w in want], rtol=1e-12)
    found = hmm.Expected(5, 3)
    found.add(model, sequences)
    for got, i in ((found.starts, 1), (found.steps, 2), (found.emitted, 3)):
        assert np.allclose(got, sum(w[i] for w in want), rtol=1e-9)
    found.add(model.single(), sequences[:2])
    assert np.allclose(found.emitted.sum(), sum(map(len, sequences)) + 5, rtol=1e-5)


def test_no_sequences_and_one_of_very_many_tokens():
    model = random_model(np.random.default_rng(4), 5, 3)
    assert len(hmm.log_likelihoods(model, [])) == 0
    hmm.Expected(5, 3).add(model, [])
    x = np.tile(np.arange(5, dtype=np.int32), 40_000)
    alone = hmm.log_likelihoods(model, [x])[0]
    assert math.isfinite(alone) and np.allclose(hmm.log_likelihoods(model, [x, x[:7]])[0], alone)


def test_emissions_are_distributions():
    rng = np.random.default_rng(5)
    count = rng.integers(1, 90, 40).astype(float)
    first = hmm.Model.first(count, 4)
    fitted = hmm.Model.fitted(np.ones(4), rng.random((4, 4)), rng.random((40, 4)) * count[:, None], count)
    for m in (first, fitted):
        assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.step.sum(1), 1) and math.isclose(m.start.sum(), 1) and (m.emit > 0).all()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain_base(rows):
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w] + [""]) for i, t in rows]
    count = Counter(w for i, ws in split if not held_out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, held_out(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in split]


TEXTS = ["The cat\tsat on THE mat.", "the dog\x0bsat", "", None, "  ", "É é É the", "un mot un autre mot", "the cat sat the cat sat " * 40, "w" * 5_000 + " the", "a b a b the", "x\x1cy the"]
DOCS = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"the cat {i} sat on mat {i % 7}") for i in range(60)] + [(3, "again"), (3, "again"), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def language(spark, docs):
    return hmm.scores(docs(DOCS), head=12).collect()


def test_base_scores_equal_a_plain_count(language):
    order = lambda r: (str(r[0]), r[2], r[5])
    want, got = sorted(plain_base(DOCS), key=order), sorted((tuple(r) for r in language), key=order)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert np.allclose([w[5] for w in want], [g[5] for g in got], rtol=1e-12)


def test_scores_of_equal_texts_are_equal_and_finite(language):
    assert all(math.isfinite(r.score) and r.score < 0 for r in language)
    again = [r.score for r in language if r.doc_id == 3 and r.n_tokens == 2]
    assert len(again) == 2 and again[0] == again[1]


def test_probabilities_of_all_words_add_up_to_one(spark, docs):
    """Texts of one word: those of every known word and of one unknown word per ending, all but the ends' share."""
    rows = [(i, f"aa{i % 3}x bb{i % 5}y") for i in range(40)]
    train = [(i, t) for i, t in rows if not held_out(i)]
    known = sorted({w for _, t in train for w in t.split()})
    unknown = {}
    for a in "abcdefghijklmnopqrstuvwxyz0123456789":
        for b in "abcdefghijklmnopqrstuvwxyz0123456789":
            unknown.setdefault(int(hmm.endings(pa.array([f"_{a}{b}"]))[0]), f"_{a}{b}")
    probes = known + [w for w in unknown.values() if w not in known]
    ids = [i for i in range(1000, 40_000) if held_out(i)][: len(probes)]
    got = {r.doc_id: r for r in hmm.scores(docs(rows + list(zip(ids, probes))), head=4).collect() if r.held_out and r.doc_id >= 1000}
    # of one-word texts the sum is the chance that the second token is the end; it can't pass one, and known words take most of it
    total = sum(10 ** got[i].score for i in ids)
    assert 0 < total <= 1


def test_training_ignores_held_out_rows_and_beats_the_base(spark, docs):
    rng = np.random.default_rng(8)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("ab", "cd", "ef")]
    rows = [(i, " ".join(rng.choice(tongues[i % 3], 40))) for i in range(300)]
    got = hmm.scores(docs(rows), states=4).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)
    other = hmm.scores(docs([(i, "something else" if held_out(i) else t) for i, t in rows]), states=4).collect()
    by = {r.doc_id: r.score for r in other}
    assert all(abs(by[r.doc_id] - r.score) < 1e-9 for r in got if not r.held_out)


def test_every_round_learns_from_all_training_texts(spark, docs):
    """Scores are those of plain rounds over all training texts; all words stand often enough for the head."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice([f"{'ab' if i % 2 else 'cd'}{k}" for k in range(9)], 30))) for i in range(120)]
    count = Counter(w for i, t in rows if not held_out(i) for w in t.split())
    head = [hmm.END, *sorted(count, key=lambda w: (-count[w], w))]
    at = {w: n for n, w in enumerate(head)}
    coded = {i: np.array([at[w] for w in t.split()] + [0]) for i, t in rows}
    train = [x for i, x in coded.items() if not held_out(i)]
    own = np.concatenate(([len(train)], [count[w] for w in head[1:]], np.full(hmm.CLASSES, 0.5)))
    model = hmm.Model.first(own, 3)
    for _ in range(hmm.ROUNDS):
        found = hmm.Expected(len(own), 3)
        found.add(model, train)
        model = hmm.Model.fitted(found.starts, found.steps, found.emitted, own)
    got = {r.doc_id: r.score for r in hmm.scores(docs(rows), states=3).collect()}
    assert np.allclose([got[i] for i, _ in rows], hmm.log_likelihoods(model, [coded[i] for i, _ in rows]), rtol=1e-3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(i, "only held out") for i in range(50) if held_out(i)]])
def test_language_of_nothing_to_learn_from(spark, docs, rows):
    got = hmm.scores(docs(rows)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    if rows and rows[0][1]:
        assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)


# ---------------------------------------------------------------- resampling


def plain_resampled(rows, target, order, percent=10, least=20, buckets=10_000):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    runs = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]
    hashed = lambda ws: [zlib.crc32(r.encode()) % buckets for r in runs(ws)]
    own = [(i, word(t)) for i, t in rows]
    s, t = Counter(b for _, ws in own for b in hashed(ws)), Counter(b for x in target for b in hashed(word(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, ws in own:
        h = hashed(ws)
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(ws)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = n
    return sorted(map(tuple, out), key=str)


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(["The", "sea", "is", "é", "old,", "ship", "7", "x_y", "and", "far"], rng.integers(1, 60)))) for i in range(n)]


CASES = {
    "prose": prose(150, 1),
    "repeated rows and ids": prose(60, 2) + [(7, "the sea " * 30)] * 2_500 + [(7, "another text " * 30), (None, "no id " * 20), (None, "no id " * 20), (8, None), (9, ""), (10, "!!!")],
    "a very long text": prose(30, 3) + [(99, "the old ship sails " * 30_000)],
    "nothing": [],
    "no words": [(1, None), (2, "..."), (2, "...")],
}


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("case", sorted(CASES))
def test_resampled_equals_a_plain_version(spark, docs, case, order):
    rows = CASES[case]
    target = [(0, "the old ship"), (1, "Far and far."), (2, None)]
    for want_target in (target, []) if order == 1 else (target,):
        got = resampled(docs(rows), docs(want_target), order=order)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
        got, want = sorted((tuple(r) for r in got.collect()), key=str), plain_resampled(rows, [t for _, t in want_target], order)
        if case == "repeated rows and ids":  # which of the equal rows is drawn first is not told
            assert Counter(got) == Counter(want)
        else:
            assert got == want


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, positives=5, negatives=3):
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(v)) for i, v, y in rows if i is not None and y is not None and good(v)}
    d = Counter(len(v) for _, _, v in kept)
    most = min(d, key=lambda k: (-d[k], k)) if d else 0
    kept = [(i, y, v, [math.floor(256 * x) for x in v]) for i, y, v in kept if len(v) == most]
    out = []
    for a in kept:
        if a[0] % 50:
            continue
        scored = [(-sum(x * z for x, z in zip(a[3], r[3])), r[0], r[1]) for r in kept if r[:3] != a[:3]]
        for s, p, _ in sorted(r for r in scored if r[2] == a[1])[:positives]:
            fit = sorted(r for r in scored if r[2] != a[1] and 50 * -s <= 100 * -r[0] <= 95 * -s)[:negatives]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, d, seed, ids=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(ids[i]) if ids is not None else i, [float(c) for c in x[i]], int(rng.integers(0, 3))) for i in range(n)]


ONE = [0.5, 0.5, 0.5, 0.5]
VECTORS = {
    "plain": vectors(400, 8, 1),
    "few": vectors(3, 4, 2),
    "nothing": [],
    "ids far apart": vectors(300, 3, 3, ids=[(i - 150) * 50 * 10**15 for i in range(300)]),
    "equal vectors": [(i, ONE, i % 2) for i in range(4 * FEW)] + [(i, [0.4, 0.5, 0.5, 0.4], i % 2) for i in range(1000, 1000 + 4 * FEW)] + vectors(100, 4, 5, ids=range(2000, 2100)),
    "odd rows": vectors(120, 4, 6) + vectors(120, 4, 6) + [(50, ONE, None), (100, None, 1), (None, ONE, 1), (150, [], 1), (200, [0.1, None, 0.2, 0.3], 1), (250, [0.1, float("nan"), 0.2, 0.3], 1), (300, [float("inf"), 0.0, 0.0, 0.0], 2), (350, [0.1, 0.2], 1), (0, ONE, 1), (0, ONE, 2), (400, [0.0] * 4, 1)],
    "large components": [(i, [float(c) * 1e5 for c in v], y) for i, v, y in vectors(120, 4, 7)],
}


@pytest.mark.parametrize("case", sorted(VECTORS))
def test_hard_negatives_equal_a_plain_version(spark, case):
    rows = [(i, v, y, "x", 1) for i, v, y in VECTORS[case]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, w string, id int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, label)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in VECTORS[case]]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(f32)


def test_blocks_hold_few_scores_and_pass_on_few_parts(monkeypatch):
    rng, n, need = np.random.default_rng(5), 900, 3
    q = rng.integers(-200, 200, (n, 4))
    ids, labels = np.arange(n), rng.integers(0, 2, n)
    block = pd.DataFrame({"ids": [ids.tobytes()], "tags": [ids.tobytes()], "labels": [labels.tobytes()], "q": [q.astype("i2").tobytes()], "width": 2})
    anchors = pd.DataFrame({"aid": ids[:300], "atag": ids[:300], "label": labels[:300], "q": [v.tobytes() for v in q[:300]]})
    held, scores = [], negatives.Block.scores
    monkeypatch.setattr(negatives, "SCORES", 5_000)
    monkeypatch.setattr(negatives.Block, "scores", lambda self, a: held.append(len(a) * len(self.ids)) or scores(self, a))
    lo, hi, shift = -1 << 18, 1 << 18, 11
    run = lambda asked: [(asked.anchor["aid"], asked.score, *asked.counts(False, 0, np.zeros(1, np.int64), lo, hi, shift, need))]
    for aid, score, parts, counts in negatives.of_blocks(block, anchors, run):
        assert (score == q @ q[aid]).all()
        there = np.bincount((-score[labels != labels[aid]] - lo) >> shift)
        last = int(np.flatnonzero(np.cumsum(there) >= need)[0])
        assert len(parts) <= need and parts[-1] == last and (counts == there[parts]).all() and counts.sum() == there[: last + 1].sum()
    assert len(held) == 60 and max(held) <= 5_000
