import hashlib
import random
import re

import pytest

from tallyloom.llm.common import WORD
from tallyloom.llm.decontaminate import contamination, without_contaminated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(WORD, (t or "").translate(LOW))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        listed = ",".join(sorted(ids))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "d3lta", "épsilon", "zeta"]) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for k in range(30)]
    items += [(30, items[7][1]), (31, None), (32, "one two three"), (2, items[2][1])]
    docs = [(k, text(rng.randrange(0, 80))) for k in range(40)]
    docs += [(100 + k, text(5) + " " + (u or "").upper() + " " + text(7)) for k, (_, u) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "!!! ..."), (203, "der " * 300), (204, "ONE  two, three")]
    return docs, items


@pytest.mark.parametrize("bound", [200_000, 0])
def test_same_as_brute_force(spark, docs, by_id, bound):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(contamination(docs(rows), table, broadcast_seeds=bound))
    want = brute(rows, items)
    assert {k: tuple(v[0][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for k, v in got.items()} == want


def test_empty_tables_repeats_and_nulls(spark, docs, by_id):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    assert contamination(docs([]), items).count() == 0
    got = by_id(contamination(docs([(1, "a b"), (1, "a b"), (1, "x"), (None, None)]), items))
    assert len(got[1]) == 2 and len(got[None]) == 1
    none = contamination(docs([(1, "a b")]), items.limit(0)).collect()
    assert [r.n_hit for r in none] == [0]
    kept = without_contaminated(docs([(1, "q A B c d e f g h i j"), (2, "clean"), (None, None), (2, "clean")]), items)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 2] and kept.columns == docs([]).columns
