import random
from collections import Counter

import numpy as np

from sightline.llm import decontam as D


def brute(index, stats, units, texts, threshold):
    out = {}
    for d, t in enumerate(texts):
        w = D.words_of(t)
        for s in range(0, max(1, len(w) - D.WINDOW + D.STEP), D.STEP):
            terms = set(w[s : s + D.WINDOW])
            for u, unit in enumerate(units):
                score = sum(x for v, x in D.weights(unit, stats).items() if v in terms)
                if score >= threshold - 1e-9:
                    out.setdefault((d, u), []).append(score)
    return {k: sorted(v) for k, v in out.items()}


def material(seed=2, items=60):
    draw = random.Random(seed)
    words = ["the", "of", "and", "to"] * 8 + [f"w{i}" for i in range(150)]
    bench = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 4, 20, 40, 90]))) for _ in range(items)]
    docs = []
    for i in range(80):
        text = [draw.choice(words) for _ in range(draw.choice([0, 10, 63, 65, 300]))]
        if i % 3 == 0:
            leak = draw.choice(bench).split()
            for _ in range(draw.choice([0, 0, len(leak) // 10])):
                leak[draw.randrange(len(leak))] = "edited"
            at = draw.randrange(len(text) + 1)
            text[at:at] = leak
        docs.append(" ".join(text).upper() if i % 5 == 0 else ", ".join(text))
    return bench, docs


def test_retrieval_equals_scoring_every_window(spark):
    bench, docs = material()
    frame = D.split_items(spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"))
    (index,) = D.shards(frame)
    units = [u for _, q, a in index.items for u in D.units_of(q + a)]
    assert max(map(len, units)) <= D.UNIT
    stats = D.Statistics(len(units), sum(map(len, units)) / len(units), Counter(w for u in units for w in set(u)))
    words = [D.words_of(t) for t in docs]
    codes = np.array([index.codes.get(w, -1) for ws in words for w in ws], np.int64)
    for threshold in (0.3, 0.6, 0.95):
        got = {}
        for d, u, s in zip(*index.retrieve(codes, np.array([len(w) for w in words]), threshold)):
            got.setdefault((int(d), int(u)), []).append(s)
        want = brute(index, stats, units, docs, threshold)
        assert got.keys() == want.keys() and all(np.allclose(sorted(got[k]), want[k]) for k in want)


def test_pairs_and_clean(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_POSTINGS", 300)
    bench, docs = material(3)
    items = D.split_items(spark.createDataFrame([*enumerate(bench), (777, None), (778, " ")], "item_id long, text string"))
    rows = [(i, t, "x", i) for i, t in enumerate(docs)] + [(900, None, "x", 0), (901, "", "x", 0), (3, docs[3], "x", 0), (902, "stone " * 40000 + bench[3] + " river" * 500, "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score int")
    assert len(list(D.shards(items))) > 2
    got = {(r.doc_id, r.item_id) for r in D.leaks(frame, items).collect()}
    texts = dict((r[0], " ".join(D.words_of(r[1]))) for r in rows)
    whole = {(d, n) for d, t in texts.items() for n, b in enumerate(bench) if f" {b} " in f" {t} "}
    assert whole <= got and (902, 3) in got and not {d for d, _ in got} & {900, 901}
    kept = D.clean(frame, items)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    none = items.limit(0)
    assert D.leaks(frame, none).count() == 0 and D.clean(frame, none).count() == len(rows) and D.leaks(frame.limit(0), items).count() == 0
