import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyloom.llm.neighbours import neighbours
from tallyloom.llm.suffixes import minimisers, repeated_passages


def test_repeated_passages_same_as_brute_force(docs):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    shared, longer, short = text(60), text(200), text(49)
    rows = [(k, text(rng.randrange(0, 150))) for k in range(20)]
    rows += [(30 + k, text(rng.randrange(0, 90)) + p + text(rng.randrange(0, 90))) for k, p in enumerate([shared, shared, shared, longer, longer[:120], short, short, longer + shared])]
    rows += [(50, ["der"] * 400), (51, text(55) * 2)]
    table = [(i, " ".join(w).upper() if i % 2 else " ".join(w)) for i, w in rows] + [(60, None), (61, ""), (62, " "), (None, " ".join(shared))]
    got: dict = {}
    for r in repeated_passages(docs(table + table[-1:])).collect():
        assert r.to_word - r.from_word == r.n_words >= 50
        got.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    rows.append((None, shared))
    where: dict = {}
    for i, w in rows:
        for p in range(len(w) - 49):
            where.setdefault(tuple(w[p : p + 50]), set()).add(i)
    want: dict = {}
    for i, w in rows:
        for p in range(len(w) - 49):
            if len(where[tuple(w[p : p + 50])]) > 1:
                want.setdefault(i, set()).update(range(p, p + 50))
    assert got == want
    assert repeated_passages(docs([])).count() == 0


def test_minimisers_depend_on_the_window_only():
    h = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    whole, part = set(minimisers(h, 39).tolist()), minimisers(h[100:200], 39)
    assert {int(p) + 100 for p in part} <= whole and len(minimisers(h[:10], 39)) == 0


def passages(rows, least=50):
    """Words of each document that stand in a window which another document holds as well."""
    where: dict = {}
    for i, w in rows:
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), set()).add(i)
    want: dict = {}
    for i, w in rows:
        for p in range(len(w) - least + 1):
            if len(where[tuple(w[p : p + least])]) > 1:
                want.setdefault(i, set()).update(range(p, p + least))
    return want


@pytest.fixture
def crossed():
    """Passages whose beginnings and ends stand in different company, and within one document again."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    core, left, right = text(20), [text(60) for _ in range(4)], [text(60) for _ in range(4)]
    rows = [(k, text(rng.randrange(30)) + left[rng.randrange(4)][-rng.randrange(1, 60) :] + core + right[rng.randrange(4)][: rng.randrange(1, 60)] + text(rng.randrange(30))) for k in range(120)]
    rows += [(200 + k, sum((left[rng.randrange(4)] + core + right[rng.randrange(4)] for _ in range(6)), [])) for k in range(4)]
    rows += [(300 + k, rows[5][1]) for k in range(40)]  # copies
    return rows + [(400, ["der"] * 300), (401, ["der"] * 70), (402, text(500) * 2)]


@pytest.mark.parametrize("partitions,held", [(1, 4_096), (4, 4_096), (37, 4_096), (3, 7)])
def test_passages_are_those_of_all_windows_on_any_partitioning(spark, docs, crossed, monkeypatch, partitions, held):
    from tallyloom.llm import suffixes

    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(suffixes, "HELD", held)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got: dict = {}
        rows = repeated_passages(docs([(i, " ".join(w)) for i, w in crossed])).collect()
        for r in rows:
            got.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == passages(crossed)
    assert len({(r.doc_id, r.from_word) for r in rows}) == len(rows)


def brute(vectors, k, asks):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if asks(i)}):
        score = (x * x[ids == q][0]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_same_as_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[::3] = x[0]
    x[5] *= 30
    vectors = [(i, x[i].tolist()) for i in range(700)]
    bad = [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [None] * 24), (980, []), (None, x[1].tolist()), (1000, [1.0] * 3), (20, x[20].tolist())]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors + bad], "vec_id bigint, embedding array<float>, rank int, score double")
    got: dict = {}
    for r in neighbours(table, F.col("vec_id") % 20 == 0, k=20, block_bytes=16 * 8 * 24).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(vectors, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * 20 * len(want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if {i for i, _ in got[q]} == {i for i, _ in want[q]})


def test_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    ask = F.col("vec_id") % 20 == 0
    assert neighbours(spark.createDataFrame([], schema), ask).count() == 0
    assert neighbours(spark.createDataFrame([(20, [1.0, 2.0])], schema), ask).count() == 0
    two = neighbours(spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])], schema), ask).orderBy("rank").collect()
    assert [(r.vec_id, r.rank, r.score) for r in two] == [(1, 1, 5.0), (2, 2, -1.0)]


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 8)).astype(np.float32)
    x[:40] = x[0]
    vectors = [(i, x[i].tolist()) for i in range(120)]
    often = [(0, x[0].tolist())] * 300 + [(5, x[5].tolist())] * 60
    odd = [(1000 + i, [1.0] * 3) for i in range(110)]  # first, but fewer than the others
    table = spark.createDataFrame(odd + vectors + often, "vec_id bigint, embedding array<float>").coalesce(1)
    got: dict = {}
    for r in neighbours(table, F.col("vec_id") % 20 == 0, k=20, block_bytes=16 * 8 * 24).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in rows] for q, rows in brute(vectors, 20, lambda i: i % 20 == 0).items()}


def test_passages_meet_across_partition_borders(spark, docs):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    rows = [(k, sum((text(55) + shared for _ in range(n)), [])) for k, n in enumerate([9, 7, 1, 12])]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got: dict = {}
        for r in repeated_passages(docs([(i, " ".join(w)) for i, w in rows])).collect():
            got.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: {p for p in range(len(w)) if w[p] in set(shared)} for i, w in rows}


def test_one_product_counts_the_bits_of_all_planes():
    from tallyloom.llm.neighbours import PLANES, Query, codes, rotation, unpacked

    x = np.random.default_rng(5).standard_normal((50, 70))
    centre, turn = x.mean(axis=0), rotation(70)
    bits, scalars = codes(x, centre, turn)
    asked = Query(x[:3], centre, turn)
    counts = [[sum(int(w) >> j & 1 and 1 << j for w, b in zip(row, bit) if b for j in range(PLANES)) for bit in unpacked(bits, 70)] for row in asked.whole]
    assert unpacked(bits, 70).sum(axis=1).tolist() == scalars[:, 3].tolist() and (asked.whole @ unpacked(bits, 70).T).tolist() == counts
