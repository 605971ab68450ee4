import itertools
import random
import zlib

import numpy as np

from tallyloom.llm.toxicity import SIZE, Restorer, code, costs, gram_counts, toxicity, without_toxic


def corpus(n=600):
    rng = random.Random(2)
    plain = "the house stands near river where people walk often after lunch with friends and talk about weather".split()
    rude = ["idiot", "scumbag"]
    forms = {"idiot": ["idiot", "1d10t", "i d i o t", "idiooot", "id*ot"], "scumbag": ["scumbag", "scumb4g", "$cumbag"]}
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        for _ in range(4 if toxic else 0):
            k = rng.choice(rude)
            w.insert(rng.randrange(len(w)), rng.choice(forms[k]) if rng.random() < 0.5 else k)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, docs):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(5, None), (None, 1), (10**6, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity(docs(rows + [(None, "idiot"), (9001, None), (9002, "")]), table).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None) and not got[None].held_out
    test = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert got[9001].score == got[9002].score
    kept = without_toxic(docs(rows), table)
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if not got[i].predicted}


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity(docs([]), none).count() == 0
    assert [r.predicted for r in toxicity(docs([(1, "a b"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity(docs([(1, "a b")]), spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")).count() == 1


def test_decoder_restores_spellings(spark, docs):
    rows, _ = corpus(300)
    counts = np.zeros(SIZE**3, np.int64)
    found = gram_counts(docs(rows + [(9, None)]), "text").collect()
    for gram, n in found:
        counts[gram] = n
    assert counts.sum() == sum(len(t) + 1 for _, t in rows)
    r = Restorer(costs(counts))
    assert r.words("1d10t") == ["idiot"] and r.words("idiooot,") == ["idiot"] and r.words("scumb4g") == ["scumbag"] and r.words("house%%%") == ["house"]
    assert "idiot" in r.text_words("you i d i o t there") and code("a") == 1 and code("é") != code("e") and r.words("12345") == []


def test_stretched_and_short_spaced_words_are_restored(spark, docs):
    rows, _ = corpus(300)
    counts = np.zeros(SIZE**3, np.int64)
    for gram, n in gram_counts(docs(rows + [(k, "fat idiot") for k in range(900, 960)]), "text").collect():
        counts[gram] = n
    r = Restorer(costs(counts))
    assert r.words("idi" + "o" * 60 + "t") == ["idiot"] and r.words("1d" + "1" * 45 + "0t") == ["idiot"]
    assert r.decode("idiot" * 5_000).startswith("idiot")
    assert "fat" in r.text_words("so f a t there") and "idiot" in r.text_words("you i    d . . i - - - o t there")


def test_decoder_takes_the_cheapest_of_all_readings():
    rng = np.random.default_rng(8)
    restorer = Restorer(rng.uniform(0.1, 6.0, (SIZE, SIZE, SIZE)))

    def cost(text, extra):
        a = b = 0
        for ch in text:
            c = code(ch)
            extra += restorer.cost[a][b][c]
            a, b = b, c
        return extra + restorer.cost[a][b][0]

    for token in ["1d10t", "h3ll0", "i d i o t", "st*pid", "aaa", "b00k", "$h!t", "a1|1b", "x", "éé1", "(00l", "no", "7+7"]:
        readings = []
        for path in itertools.product(*restorer.lattice(token)):
            readings.append((cost("".join(piece for piece, _ in path), sum(extra for _, extra in path)), "".join(piece for piece, _ in path)))
        assert restorer.decode(token) == min(readings)[1]
