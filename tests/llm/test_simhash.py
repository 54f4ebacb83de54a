import numpy as np
import pytest
import xxhash

from sightline.llm import simhash
from sightline.llm.components import components


def brute(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n\t", "One", "one Two", "a b c", "É ÀB c d\x0be f\x1cg a b c " * 30, "x " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(text) == [brute(text)]
    assert len(simhash.simhash(text, 5, extra=1)) == 3


def closure(words, ids, radius):
    up = {i: i for i in ids}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in zip(ids, words):
        for j, b in zip(ids, words):
            if bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_tiles_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "STRIP", 5)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    words = base + [base[i % 20] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for i in range(120)] + [0, 2**64 - 1]
    frame = spark.createDataFrame([(int(np.array([w], np.uint64).view(np.int64)[0]),) for w in words], "fp long").distinct().selectExpr("fp", "binary('') AS more", "fp AS node")
    links = simhash.tiled_links(frame, 3)
    roots = {r.node: r.root for r in components(links).collect()}
    words = sorted({int(np.array([w], np.uint64).view(np.int64)[0]) for w in words})
    want = closure([w & (2**64 - 1) for w in words], words, 3)
    assert {w: roots.get(w, w) for w in words} == want and len(set(want.values())) < len(words)


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text.upper(), 1), (9, text + " w400", 1), (4, None, 1), (8, "", 1), (2, "alone in the world", 1), (2, "alone in the world", 1), (7, "x " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs, shingle=3, radius=3, extra=0).collect())
    ids = [r[0] for r in rows]
    prints = {i: brute(t or "") for i, t, _ in rows}
    want = closure([prints[i] for i in ids], ids, 3)
    assert got == sorted((i, f"{prints[i]:016x}", want[i]) for i in ids) and want[9] == 3 and want[8] == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.first_of_groups(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (129, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 100}


def test_first_of_groups_keeps_one_of_each(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(300)]
        for c in range(6):
            words = base.copy()
            for at in rng.choice(300, 2 * (c > 0), replace=False):  # ten of 300 shingles
                words[at] = f"x{c}"
            rows.append((100 * g + c, " ".join(words), "s", f"{g}"))
    rows += [(5000 + i, " ".join(f"o{i}v{k}" for k in range(60)), "s", "o") for i in range(60)] + [(5000, rows[0][1], "s", "copy"), (None, "x", "s", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string, node string")
    got = simhash.first_of_groups(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in got.collect() if r.doc_id is not None))
    assert kept[:12] == [100 * g for g in range(12)] and len(kept) >= 12 + 59


def test_groups_form_from_verified_links_only(spark):
    rng, rows = np.random.default_rng(9), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(200)]
        for c in range(5):
            words = base.copy()
            for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
                words[at] = f"x{c}y{at}"
            rows.append((10 * g + c, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two " * 50), (905, "two one " * 50)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = [jaccard(sets[i], sets[j]) for i in range(200) for j in range(i) if i // 5 == j // 5]
    assert sum(0.8 <= x < 0.9 for x in near) > 30 and sum(0.6 <= x < 0.8 for x in near) > 60
    up = {i: i for i, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()} == {i: find(i) for i, _ in rows}
