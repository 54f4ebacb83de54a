import heapq
import os
import re
import sys
import time
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import packing
from sightline.llm.common import map_arrow
from sightline.llm.queries import vocabulary


def served(totals, weights, quantum):
    """Token by token: the queue whose next quantum has the smallest turn."""
    turn = lambda i, k: (Fraction(k * quantum + min(totals[i], (k + 1) * quantum), 2 * weights[i]), i, k)
    heap = [turn(i, 0) for i, t in enumerate(totals) if t]
    heapq.heapify(heap)
    while heap:
        _, i, k = heapq.heappop(heap)
        yield from [i] * min(quantum, totals[i] - k * quantum)
        if (k + 1) * quantum < totals[i]:
            heapq.heappush(heap, turn(i, k + 1))


@pytest.mark.parametrize("quantum", [1, 5, 16, 40])
@pytest.mark.parametrize("totals,weights", [([50, 7, 0, 130], [50, 7, 1, 130]), ([40, 40, 3], [1, 2, 9]), ([1], [1]), ([5, 5, 5], [1, 1, 1]), ([1000, 1, 1], [1000, 1, 1]), ([640, 320, 90, 61], [640, 320, 90, 61])])
def test_rounds_equal_token_by_token_round_robin(totals, weights, quantum):
    window = 16
    rounds, order = packing.Rounds(totals, weights, window, quantum), list(served(totals, weights, quantum))
    places = [[at for at, i in enumerate(order) if i == s] for s in range(len(totals))]
    for s, want in enumerate(places):
        assert len(want) == totals[s]
        for begin, n in [(0, len(want)), (len(want) // 3, len(want) // 2), (len(want) - 1, 1)]:
            if not want or n < 1:
                continue
            got = rounds.pieces(s, begin, n)
            assert [w * window + o + x for _, size, w, o in got for x in range(size)] == want[begin : begin + n]
            assert all(o + size <= window for _, size, _, o in got) and [p[0] for p in got] == [sum(p[1] for p in got[:j]) for j in range(len(got))]
    if totals == weights:  # in these mixtures no queue is off by more than two quanta at a border
        for at in range(0, len(order), window):
            assert all(abs(sum(x < at for x in places[s]) - at * t / sum(totals)) <= 2 * quantum for s, t in enumerate(totals))


def test_documents_are_cut_no_more_often_than_quanta_and_windows_ask():
    totals = [(s + 1) * 4000 for s in range(12)]
    rounds = packing.Rounds(totals, totals, 4096, 512)
    for n in (1, 200, 512, 3000):
        for begin in range(0, totals[3] - n, 777):
            assert len(rounds.pieces(3, begin, n)) <= 2 + n // 512 + 1 + n // 4096
    cut = sum(len(rounds.pieces(3, begin, 200)) for begin in range(0, totals[3], 200))
    assert cut / (totals[3] / 200) < 1.6


def test_pack_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    rows = [(i, "word " * (i * 37 % 300) + "tail.", f"s{i % 3}" if i % 7 else None, "x") for i in range(120)] + [(500, None, "s0", "x"), (501, "", "s1", "x"), (7, "again", "s1", "x"), (7, "again", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long".replace("n long", "length string")).repartition(4)
    got = packing.pack(docs, vocabulary(), window=256, quantum=32).toPandas()
    library = Tokenizer.from_file(vocabulary())
    left = sorted((i, t or "") for i, t, _, _ in rows)
    ids = {(i, t): [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in left}
    assert got["length"].sum() == sum(len(ids[x]) for x in left)
    sizes = got.groupby("sequence_id")["length"].sum().sort_index()
    assert (sizes[:-1] == 256).all() and sizes.index.tolist() == list(range(len(sizes)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    for (i, t), want in ids.items():
        if i == 7:
            continue
        p = got[got.doc_id == i].sort_values("start")
        assert p["start"].tolist() == [0, *np.cumsum(p["length"])[:-1]] and set(p.doc_tokens) == {len(want)}
        assert [zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) for s, n in zip(p["start"], p["length"])] == p.ids_crc32.tolist()


def test_pack_shares_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(empty, vocabulary()).count() == 0
    docs = spark.createDataFrame([(i, "a b c d e f g", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    got = packing.pack(docs, vocabulary(), window=64, quantum=1, shares={"s0": 3, "s1": 1}).toPandas()
    first = got[got.sequence_id < 5].groupby(["sequence_id", "source"])["length"].sum().unstack()
    assert (first["s0"].between(47, 49)).all()


def test_more_sources_than_queues_keep_the_large_ones_apart(spark):
    sizes = {"big": 600, "wide": 300, **{f"t{i}": 10 + i for i in range(9)}}
    rows = [(n * 1000 + i, "a b c d e f g", s) for n, (s, k) in enumerate(sizes.items()) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(docs, vocabulary(), window=128, quantum=1, own_queues=2).toPandas()
    one = packing.pack(docs, vocabulary(), window=128).toPandas()
    assert set(got.source) == set(sizes) and got.groupby("doc_id")["length"].sum().to_dict() == one.groupby("doc_id")["length"].sum().to_dict()
    whole = got[got.sequence_id < got.sequence_id.max()].groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    for s in ("big", "wide"):
        want = 128 * sizes[s] / sum(sizes.values())
        assert (whole[s] - want).abs().max() <= 2
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary(), shares={"big": 0})


def test_workers_give_memory_back_and_there_is_one_set_of_them(spark):
    def filled(batches):
        for _ in batches:
            small = [bytes(60_000) for _ in range(4000)]  # below the size that is mapped on its own
            sys.pinned = bytes(60_000)  # above all of them
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64())], ["pid"])
            del small

    pid = map_arrow(spark.range(0, 1, 1, 1), filled, "pid long").collect()[0].pid
    time.sleep(1)
    assert int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) < 200_000
    sums = spark.range(3).selectExpr("concat('s', id) AS source", "id AS total")
    plan = packing.queues_of(sums, None, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "RDD" not in plan, plan
