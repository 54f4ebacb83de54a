"""The pipeline against a plain version, stage by stage, on a small corpus."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline as P
from sightline.llm import decontam, quality, simhash
from sightline.llm.common import shared_dir
from tests_llm_plain import closure_of, keep_lines


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(8)
    words = [f"{a}{b}" for a in ("ri", "sto", "mor", "win", "gar", "let", "qui") for b in ("ver", "ne", "ning", "dow", "den", "ter", "et", "la", "mi")]
    sentence = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(6, 25))).capitalize() + "."
    bench = [(i, " ".join(draw.choice(words) for _ in range(30))) for i in range(5)]
    docs = []
    for i in range(160):
        lines = [sentence() for _ in range(draw.randint(2, 7))]
        if i % 9 == 0:
            lines.insert(1, bench[i % 5][1])
        text = "\n".join(lines)
        if i % 7 == 3:
            text = text.replace(" ", "$$$ ")
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
    docs += [(200 + i, docs[i][1], "en", "src0", 0) for i in range(5)]
    docs += [(300 + i, docs[i + 20][1].replace("river", "lake", 1), "en", "src1", 0) for i in range(5)]
    docs += [(400, None, None, None, None), (401, "", "en", "src0", 0)]
    labels = [(i, int(i % 7 != 3), 0) for i in range(160)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, bench


def test_pipeline_equals_plain_version(spark, corpus):
    at, docs, bench = corpus
    frames = {}
    rows = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in P.STAGES:
        rows = P.stored(stage(spark, rows, at), "test-stage")
        frames[name] = rows.toPandas()
        if name != "packing":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # 1: the same network, document by document
    net = quality.fit_on_labels(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    good = [(i, t) for i, t, *_ in docs if net.score([t or ""])[0] >= 0.5]
    assert sorted(frames["quality classifier"].doc_id) == sorted(i for i, _ in good)
    assert not {i for i, _ in good} & {i for i in range(160) if i % 7 == 3}
    # 2: all pairs of lines
    kept = keep_lines(good)
    assert {r.doc_id: r.text for r in frames["line dedup"].itertuples()} == kept
    assert not set(kept) & {200, 201, 202, 203, 204}
    # 3: all pairs of fingerprints
    prints = {i: simhash.simhash(t or "", 5, extra=1) for i, t in kept.items()}
    close = lambda a, b: bin(prints[a][0] ^ prints[b][0]).count("1") <= 16 and sum(bin(x ^ y).count("1") for x, y in zip(prints[a], prints[b])) <= 36
    groups = closure_of(list(kept), close)
    left = sorted(i for i in kept if groups[i] == i)
    assert sorted(frames["SimHash near-dedup"].doc_id) == left
    # 4: verbatim items
    leaked = {i for i in left if any(b in (kept[i] or "").lower() for _, b in bench)}
    clean = set(frames["benchmark decontamination"].doc_id)
    assert clean == set(left) - leaked and leaked
    # 5: every token once
    last = frames["packing"]
    assert set(last.doc_id) == clean and (last.groupby("doc_id")["length"].sum() == last.groupby("doc_id").doc_tokens.first()).all()
    assert last.groupby("sequence_id")["length"].sum().iloc[:-1].eq(4096).all() and np.isfinite(last["offset"]).all()


def test_line_dedup_keeps_what_matched_nothing(spark):
    unique = "only this line stands nowhere else in the corpus"
    docs = [(1, "\n".join([unique] * 6)), (2, "a long line of boilerplate that comes again and again " * 9), (3, docs_text := "a long line of boilerplate that comes again and again " * 9 + "\nshort rest"), (4, docs_text)]
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").coalesce(1)
    got = {r.doc_id: (r.text, r.n_chars) for r in P.without_repeated_lines(spark, frame, "").collect()}
    assert got == {1: (unique, len(unique)), 2: (docs[1][1], len(docs[1][1])), 3: ("short rest", 10)}


def test_line_dedup_gives_its_tables_up(spark):
    frame = spark.createDataFrame([(i, f"one line of many common words that goes on to w{i}", 0) for i in range(6)], "doc_id long, text string, n_chars long").coalesce(1)
    at = shared_dir(spark).removeprefix("file://")
    before = {*os.listdir(at)}
    assert [r.doc_id for r in P.without_repeated_lines(spark, frame, "").collect()] == [0]
    new = {name.rsplit("-", 1)[0] for name in {*os.listdir(at)} - before}
    assert "line-words" in new and not new & {"line-classes", "line-candidates", "line-involved", "line-sets", "line-pairs"}
