"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. The source that is furthest behind its target share is served
next and gives a quantum of ``QUANTUM`` tokens, or what is left of its queue. The turn of a quantum
is the middle of its tokens over the weight of its source, so where it stands among all quanta has
a closed form in integers. That is the deficit carried over windows: it depends on the turn alone,
so every partition knows the deficits at any window without hearing from the others, and no token
is shuffled. The quanta in the order of their turns are cut into windows, and a document of n
tokens is cut about n / QUANTUM + n / window times. At any turn a source is within half a quantum
of its share. Sources of equal weight have equal turns and are served one after the other, so at a
window's border a source can be off by a quantum and a half and its share of half a quantum for
each other source. A source that runs dry leaves its share to the rest. Only the very last window
can be short.

Passes: (1) tokenise, write ids and each document's place in its (task, source) run to the shared
folder; (2) add up the runs, a few numbers per task and source; (3) cut each document at the
window borders where it stands.

The ``OWN_QUEUES`` sources of most tokens, and all that have a share, are queues of their own. Further
sources stand one after the other in queues by a hash of their name; such a queue has the sum of
their weights, so every window still holds them in their proportion together.

Defined results: a null text is empty and has its end token only; a null source is the queue "";
equal rows are packed as often as they occur; a very long text goes through many windows; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import map_arrow, stored, text_of
from sightline.llm.rankmerge import merger

#: Tokens that a source gives in its turn: an eighth of a window. Smaller ones mix closer and cut documents more.
QUANTUM = 512
#: Sources that have a queue of their own at least, those of most tokens first; so many more queues serve the rest.
OWN_QUEUES = 1024
#: Rows (task, queue) of run offsets that may be broadcast, about 60 bytes each.
BROADCAST_ROWS = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Rounds:
    """The order of all quanta of all queues, and the windows that it is cut into."""

    def __init__(self, totals: list[int], weights: list[int], window: int, quantum: int):
        self.totals, self.weights, self.window, self.quantum = totals, weights, window, quantum
        #: (queue, weight, full quanta, tokens of the last one if it is short) of the queues that have tokens.
        self.queues = [(i, w, *divmod(t, quantum)) for i, (t, w) in enumerate(zip(totals, weights, strict=True)) if t]
        self._known: dict[tuple[int, int], int] = {}

    def given(self, queue: int, k: int) -> int:
        """Tokens of all queues that are served before quantum k of a queue."""
        if (queue, k) not in self._known:
            if len(self._known) > 4096:
                self._known.clear()
            self._known[queue, k] = self._given(queue, k)
        return self._known[queue, k]

    def _given(self, queue: int, k: int) -> int:
        own, q = self.weights[queue], self.quantum
        twice_middle = k * q + min(self.totals[queue], (k + 1) * q)
        tokens = 0
        for i, weight, full, rest in self.queues:
            # of equal turns the queue of the smaller number comes first
            turn = twice_middle * weight - (i >= queue)
            tokens += q * min(full, (turn // (q * own) + 1) // 2)
            if rest and (2 * full * q + rest) * own <= turn:
                tokens += rest
        return tokens

    def pieces(self, queue: int, begin: int, n: int) -> list[list[int]]:
        """[start in the document, length, window, offset there] of tokens begin .. begin + n of a queue."""
        at, end, out = begin, begin + n, []
        while at < end:
            k = at // self.quantum
            place, stop = self.given(queue, k) + at - k * self.quantum, min(end, (k + 1) * self.quantum)
            while at < stop:
                w, offset = divmod(place, self.window)
                size = min(stop - at, self.window - offset)
                if out and out[-1][2] == w and out[-1][3] + out[-1][1] == offset:  # the same source again
                    out[-1][1] += size
                else:
                    out.append([at - begin, size, w, offset])
                at, place = at + size, place + size
        return out


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, source, unit, unit_start, n, ids): ids with the end token, and where they stand in the run of the task's tokens of that source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merger(vocabulary)
        unit, runs, end = TaskContext.get().partitionId(), {}, np.array([end_id], encoder.id_type).tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode(text_of(batch.column(2)))]
            n = [len(x) // encoder.id_type.itemsize for x in ids]
            starts = []
            for source, size in zip(batch.column(1).to_pylist(), n, strict=True):
                starts.append(runs.get(source, 0))
                runs[source] = starts[-1] + size
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([unit] * rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "unit", "unit_start", "n", "ids"],
            )

    return map_arrow(docs, run, "doc_id long, source string, unit long, unit_start long, n long, ids binary")


def queues_of(sums: DataFrame, shares: Mapping[str, int] | None, own: int) -> DataFrame:
    """(source, queue, weight, total) of rows (source, total)."""
    named = {r["source"] for r in sums.orderBy(F.desc("total"), "source").limit(own).collect()} | set(shares or ())
    rows = [(s, i, None if shares is None else int(shares.get(s, 1))) for i, s in enumerate(sorted(named))]
    columns = [pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 3, [pa.string(), pa.int32(), pa.int64()], strict=True)]
    # from Arrow: a list would start a second set of Python workers on the executors; as many rows as ``own`` and the shares at most
    known = F.broadcast(sums.sparkSession.createDataFrame(pa.table(columns, ["source", "own", "share"]), "source string, own int, share long"))
    shared = F.lit(len(rows)) + F.pmod(F.xxhash64("source"), F.lit(own)).cast("int")
    weight = F.greatest("total", F.lit(1)) if shares is None else F.coalesce("share", F.lit(1))
    return sums.join(known, "source", "left").select("source", F.coalesce("own", shared).alias("queue"), weight.cast("long").alias("weight"), "total")


def pack(docs: DataFrame, vocabulary: str, *, window: int = 4096, end_id: int = 2, shares: Mapping[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", own_queues: int = OWN_QUEUES, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source).

    ``shares``: target weight of a source, a whole number from 1; by default each source's own tokens, so
    that every window has the mixture of the corpus. A source without one gets 1. ``quantum``: tokens that a
    source gives in its turn.
    """
    if any(int(x) < 1 or int(x) != x for x in (shares or {}).values()):
        raise ValueError("shares are whole numbers from 1")
    spark = docs.sparkSession
    source = F.coalesce(docs[source_col].cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), source.alias("source"), docs[text_col].cast("string").alias("text"))
    tokens = stored(tokenized(rows, vocabulary, end_id), "pack-tokens")
    runs = stored(tokens.groupBy("source", "unit").agg(F.sum("n").alias("run")), "pack-runs")
    queued = stored(queues_of(runs.groupBy("source").agg(F.sum("run").alias("total")), shares, own_queues), "pack-queues")
    totals = {r["queue"]: r for r in queued.groupBy("queue").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect()}
    if not totals:
        return spark.createDataFrame([], PIECES)
    order = sorted(totals)
    rounds = Rounds([totals[q]["total"] for q in order], [totals[q]["weight"] for q in order], window, quantum)
    at, width = {q: i for i, q in enumerate(order)}, merger(vocabulary).id_type
    before = Window.partitionBy("queue").orderBy("source", "unit").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.join(queued.select("source", "queue"), "source").select("source", "unit", "queue", F.coalesce(F.sum("run").over(before), F.lit(0)).alias("base"))
    if runs.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["source", "unit"]).select("doc_id", "source", "queue", (F.col("base") + F.col("unit_start")).alias("begin"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, source, queue, begin, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(np.frombuffer(ids, width).astype("<u4").tobytes())
                for start, length, w, offset in rounds.pieces(at[queue], begin, n):
                    for column, x in zip(out, (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, w, offset, source), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 7 + [pa.string()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return map_arrow(placed, run, PIECES)
