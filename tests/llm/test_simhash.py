import random

import numpy as np
import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.simhash import fingerprint_links, near_duplicates, signed, without_near_duplicates


def fp(t, n):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_near_duplicates_same_as_brute_force(docs):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(rng.choice([2, 5, 60, 400]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = "new"
        texts += [" ".join(c), " ".join(b).upper()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \t\n"), (None, texts[0])]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs(rows + rows[:1])).collect()]
    assert len(got) == len(rows) + 1
    fps = [fp(t, 4) for _, t in rows]
    root = groups(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None) for r in set(root)}
    want = {(rows[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(rows))}
    assert set(got) == want
    assert near_duplicates(docs([])).count() == 0


def test_points_where_very_many_meet_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63)
    fps = {int(centre)}
    for _ in range(150):
        f = int(centre)
        for b in rng.permutation(64)[: rng.integers(1, 6)]:
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = {(r.a, r.b) for r in fingerprint_links(df, reach=3).collect()}
    at = {signed(f): i for i, f in enumerate(fps)}
    near = lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4
    assert all(near(at[a], at[b]) for a, b in links)
    pairs = {frozenset((at[a], at[b])) for a, b in links}
    assert groups(len(fps), near) == groups(len(fps), near)
    mine = groups(len(fps), lambda i, j: frozenset((i, j)) in pairs)
    want = groups(len(fps), near)
    same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == r) for r in set(g)}
    assert same(mine) == same(want)


def test_one_of_each_group_stays(docs):
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b = text(300), text(200)
    near = list(a)
    near[150] = "other"
    far = a[:150] + text(150)
    rows = [(5, " ".join(a)), (3, " ".join(near)), (9, " ".join(a)), (4, " ".join(far)), (7, " ".join(b)), (None, " ".join(b)), (8, None), (10, ""), (5, " ".join(a)), (11, " ".join(text(20))), (12, "x " * 3000), (12, "x " * 3000)]
    kept = without_near_duplicates(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 8, 11, 12]
    assert without_near_duplicates(docs([])).count() == 0
    only_null = without_near_duplicates(docs([(None, "a b c"), (None, "a b c")])).collect()
    assert len(only_null) == 1


def test_long_texts_are_summed_in_steps(monkeypatch):
    hashes = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    whole = simhash.fingerprint(hashes)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(hashes) == whole


def jaccard_groups(texts, n=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return groups(len(sets), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9)


def least_of_groups(rows):
    root = jaccard_groups([t for _, t in rows])
    return sorted(min(i for (i, _), r in zip(rows, root) if r == k) for k in set(root))


def test_dense_group_same_as_brute_force(docs):
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(220):
        c = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 5)):
            c[at] = f"e{k}_{at}"
        rows.append((k, " ".join(c)))
    # chains: each is similar to the one before it only
    step = list(base)
    for k in range(300, 340):
        step[(k * 17) % 120] = f"s{k}"
        step[(k * 29 + 5) % 120] = f"t{k}"
        rows.append((k, " ".join(step)))
    rng.shuffle(rows)
    want = least_of_groups(rows)
    assert 1 < len(want) < len(rows)
    assert sorted(r.doc_id for r in without_near_duplicates(docs(rows)).collect()) == want


def test_lone_pairs_at_the_bound_are_all_found(docs):
    rng = random.Random(12)
    rows = []
    for k in range(150):
        n = rng.choice([30, 54, 104, 254, 1004])
        w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((2 * k, " ".join(w)))
        cutoff = rng.choice([0, 1, 2])
        same = -(-4 * (n - 4) // 5) - (cutoff == 2)  # a text cut to 0.8 of its shingles, or just below
        rows.append((2 * k + 1, " ".join(w[: same + 4] if cutoff else w[-(same + 4) :])))
    want = least_of_groups(rows)
    assert 150 < len(want) < 250
    assert sorted(r.doc_id for r in without_near_duplicates(docs(rows)).collect()) == want


def test_fingerprints_within_the_radius_are_compared(docs, monkeypatch):
    """Without the pairs of prefix filtering, what fingerprints link is found and then compared exactly."""
    rng = random.Random(13)
    rows = []
    for k in range(40):
        w = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((2 * k, " ".join(w)))
        w[rng.randrange(400)] = "other"
        rows.append((2 * k + 1, " ".join(w)))
    fps = [fp(t, 4) for _, t in rows]
    near = groups(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    similar = jaccard_groups([t for _, t in rows])
    want = sorted(i for i in range(len(rows)) if not any(near[i] == near[j] and similar[i] == similar[j] for j in range(i)))
    monkeypatch.setattr(simhash, "meeting_pairs", lambda similarity, neighbours: lambda batches: (b.slice(0, 0).select([1, 1]).rename_columns(["a", "b"]) for b in batches))
    assert len(want) < 60
    assert sorted(r.doc_id for r in without_near_duplicates(docs(rows)).collect()) == want


def test_every_text_counts_for_the_rareness_of_shingles(docs):
    rng = random.Random(14)
    line = "a line that many have"
    texts = [" ".join([f"v{rng.randrange(10**9)}" for _ in range(8)] + line.split()) for _ in range(500)]
    own = docs(list(enumerate(texts))).selectExpr("xxhash64(doc_id, text) AS k1", "xxhash64(text, 1) AS k2", "CAST(text AS BINARY) AS t")
    often = simhash.frequent(own, 5)
    every = np.concatenate([simhash.shingle_set(t.encode(), 5) for t in texts])
    counts = np.bincount(simhash.counter(every, len(often)), minlength=len(often))
    assert (often == np.round(8 * np.log2(counts + 1))).all() and counts.max() >= 500
    first = simhash.prefix(simhash.shingle_set(texts[0].encode(), 5), often, 0.8)
    assert xxhash.xxh64_intdigest(line.encode(), 42) not in first.tolist()
