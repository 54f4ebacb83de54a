"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Items are indexed in units of at most ``UNIT`` words. A posting's BM25 weight is divided by the
score of its own unit, so 1 is the score of the unit itself and one threshold serves all. Every
document is cut into windows of ``WINDOW`` words at every ``STEP`` words, so any run of words as
long as a unit lies whole in some window; each window is a query, and all units that reach the
threshold come back (no top k).

The bounds of block-max WAND are applied to all windows of a batch at once in numpy: a window whose
terms' maxima reach the threshold in no wide block of units is dropped (with a joint bound for the
commonest terms, which alone reach half of it in no unit), then one whose list maxima cannot, then every (window, block of units) whose
block maxima cannot; only postings of the blocks that are left are scored. Both are upper bounds,
so nothing that reaches the threshold is lost. What is retrieved is verified: the shares of the
question's and of the answer's word triples that stand in the document.

The index goes to the executors in shards of at most ``SHARD_POSTINGS`` postings; the benchmark
table itself is never held whole. Statistics (document frequencies, mean length) cover all items.

Defined results: null or wordless texts and items give no pair; a benchmark without rows gives
none; repeated rows give their pairs again; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import map_arrow

UNIT, WINDOW, STEP = 32, 64, 32
K1, B = 1.2, 0.75
THRESHOLD, LEAST = 0.6, 0.6
#: Units of a block; postings of a shard (about 40 bytes each).
BLOCK, WIDE_BLOCKS, SHARD_POSTINGS = 16, 64, 500_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units_of(words: list[str]) -> list[list[str]]:
    """Cut evenly into as few units of at most UNIT words as possible."""
    n = -(-len(words) // UNIT)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP)


@dataclass
class Statistics:
    """Of all units of the benchmark."""

    units: int
    mean: float
    frequency: dict[str, int]

    def idf(self, word: str) -> float:
        df = self.frequency.get(word, 1)
        return float(np.log1p((self.units - df + 0.5) / (df + 0.5)))


def weights(unit: list[str], stats: Statistics) -> dict[str, float]:
    """BM25 weights of a unit's words, as shares of its own score."""
    raw = {w: stats.idf(w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(unit) / stats.mean)) for w, tf in Counter(unit).items()}
    own = sum(raw.values())
    return {w: x / own for w, x in raw.items()}


class Index:
    """One shard: postings by term, and by term and block, with their maxima."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], stats: Statistics):
        self.items = items
        units = [(n, u) for n, (_, question, answer) in enumerate(items) for u in units_of(question + answer)]
        self.item_of = np.array([n for n, _ in units], np.int64)
        scored = [weights(u, stats) for _, u in units]
        self.codes: dict[str, int] = {}
        for s in scored:
            for w in s:
                self.codes.setdefault(w, len(self.codes))
        rows = sorted((self.codes[w], u, x) for u, s in enumerate(scored) for w, x in s.items())
        self.unit = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.float64)
        term = np.array([r[0] for r in rows], np.int64)
        self.blocks = len(units) // BLOCK + 1
        key = term * self.blocks + self.unit // BLOCK
        self.begin = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.empty(0, np.int64)
        self.end = np.r_[self.begin[1:], len(key)]
        self.block = key[self.begin] % self.blocks
        self.block_max = np.maximum.reduceat(self.weight, self.begin) if len(key) else np.empty(0)
        owner = key[self.begin] // self.blocks
        self.first = np.searchsorted(owner, np.arange(len(self.codes) + 1))  # of each term's blocks
        self.most = np.maximum.reduceat(self.block_max, self.first[:-1]) if len(key) else np.empty(0)
        self.frequency = np.bincount(term, minlength=len(self.codes))
        self._rare: dict[float, tuple[np.ndarray, float]] = {}
        self.questions = [triples(q) for _, q, _ in items]
        self.answers = [triples(a) for _, _, a in items]

    def rare(self, threshold: float) -> tuple[np.ndarray, float]:
        """Maxima of each term over wide blocks of units, those of the commonest terms set to 0; and the most that these can give to any one unit: at most half the threshold."""
        if threshold not in self._rare:
            wide = max(BLOCK, -(-len(self.item_of) // WIDE_BLOCKS))
            most = np.zeros((len(self.codes), len(self.item_of) // wide + 1), np.float32)
            np.maximum.at(most, (np.repeat(np.arange(len(self.codes)), self.frequency), self.unit // wide), self.weight.astype(np.float32))
            common, given = np.zeros(len(self.item_of)), 0.0
            for t in np.argsort(-self.frequency, kind="stable").tolist():
                lists = slice(self.begin[self.first[t]], self.end[self.first[t + 1] - 1])
                common[self.unit[lists]] += self.weight[lists]
                if common.max() > threshold / 2:
                    break
                most[t], given = 0, float(common.max())
            self._rare[threshold] = most, given
        return self._rare[threshold]

    def retrieve(self, codes: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, unit, score) of every unit that a window of a document reaches; codes of all words, -1 for words of no unit."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not len(self.codes) or not len(codes):
            return none
        base = np.cumsum(sizes) - sizes
        per = [windows_of(n) for n in sizes.tolist()]
        doc = np.repeat(np.arange(len(sizes)), [len(p) for p in per])
        start = np.concatenate(per) + base[doc]
        stop = np.minimum(start + WINDOW, (base + sizes)[doc])
        # maxima added up over cells of STEP words, of which a window has two
        rare, given = self.rare(threshold)
        cells = -(-sizes // STEP)
        first_cell = np.cumsum(cells) - cells
        at = np.flatnonzero(codes >= 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)[at]
        cell = first_cell[owner] + (at - base[owner]) // STEP
        sums = np.zeros((int(cells.sum()) + 2, rare.shape[1]), np.float32)
        if len(at):
            begins = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
            sums[cell[begins]] = np.add.reduceat(rare[codes[at]], begins, axis=0)
        here = first_cell[doc] + (start - base[doc]) // STEP
        both = sums[here] + np.where((stop - start > STEP)[:, None], sums[here + 1], 0)
        slack = threshold - 1e-9
        left = np.flatnonzero(both.max(axis=1) >= slack - given - 1e-4)
        if not len(left):
            return none
        doc, start, length = doc[left], start[left], (stop - start)[left]
        window = np.repeat(np.arange(len(left)), length)
        at = np.arange(len(window)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
        known = codes[at] >= 0
        pair = np.unique(window[known] * np.int64(len(self.codes)) + codes[at[known]])  # each term once
        window, term = np.divmod(pair, len(self.codes))
        enough = np.bincount(window, self.most[term], len(left))[window] >= slack
        window, term = window[enough], term[enough]
        # blocks of the windows' terms
        many = self.first[term + 1] - self.first[term]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[term], many)
        window = np.repeat(window, many)
        spots, which = np.unique(window * self.blocks + self.block[entry], return_inverse=True)
        stays = (np.bincount(which, self.block_max[entry], len(spots)) >= slack)[which]
        window, entry = window[stays], entry[stays]
        # postings of the blocks that are left
        many = self.end[entry] - self.begin[entry]
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[entry], many)
        units = len(self.item_of)
        spots, which = np.unique(np.repeat(window, many) * np.int64(units) + self.unit[posting], return_inverse=True)
        score = np.bincount(which, self.weight[posting], len(spots))
        good = score >= slack
        return doc[spots[good] // units], spots[good] % units, score[good]

    def pairs(self, texts: list[str | None], threshold: float, least: float) -> list[tuple[int, int, float, float, float]]:
        """(document, item, best score, question overlap, answer overlap) of the verified pairs."""
        words = [words_of(t) for t in texts]
        code = self.codes.get
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.fromiter((code(w, -1) for ws in words for w in ws), np.int64, int(sizes.sum()))
        best: dict[tuple[int, int], float] = {}
        for d, u, s in zip(*(x.tolist() for x in self.retrieve(codes, sizes, threshold)), strict=True):
            key = (d, int(self.item_of[u]))
            best[key] = max(s, best.get(key, 0.0))
        out, held_of, held = [], -1, set()
        for (d, n), s in sorted(best.items()):
            if d != held_of:
                held_of, held = d, {tuple(words[d][i : i + k]) for k in (1, 2, 3) for i in range(len(words[d]) - k + 1)}
            question, answer = (len(t & held) / len(t) if t else 1.0 for t in (self.questions[n], self.answers[n]))
            if question >= least and answer >= least:
                out.append((d, self.items[n][0], s, question, answer))
        return out


def split_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, question, answer) of items in one text: the last third of the words is the answer."""
    words = F.split(F.trim(F.coalesce(benchmark[text_col].cast("string"), F.lit(""))), r"\s+")
    cut = F.ceil(F.size(words) * 2 / F.lit(3)).cast("int")
    return benchmark.select(benchmark[id_col].cast("long").alias("item_id"), F.array_join(F.slice(words, F.lit(1), cut), " ").alias("question"), F.array_join(F.slice(words, cut + 1, F.size(words)), " ").alias("answer"))


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each within the size bound; items come to the driver one partition at a time."""
    frequency: Counter[str] = Counter()
    units = total = 0
    for row in items.toLocalIterator():
        for u in units_of(words_of(row.question) + words_of(row.answer)):
            frequency.update(set(u))
            units, total = units + 1, total + len(u)
    stats = Statistics(units, total / max(1, units), frequency)
    part: list[tuple[int, list[str], list[str]]] = []
    size = 0
    for row in items.toLocalIterator():
        question, answer = words_of(row.question), words_of(row.answer)
        if question or answer:
            part.append((row.item_id, question, answer))
            size += len(question) + len(answer)
        if size >= SHARD_POSTINGS:
            yield Index(part, stats)
            part, size = [], 0
    if part:
        yield Index(part, stats)


def leaks(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item; ``items`` has item_id, question, answer."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in shards(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), held.value.pairs(batch.column(1).to_pylist(), threshold, least)
                columns = list(zip(*[(ids[d], i, round(s, 6), round(q, 6), round(a, 6)) for d, i, s, q, a in found], strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.float64()] * 3], strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.union(map_arrow(rows, run, schema, rows=1000, size=4 << 20))
    return out


def clean(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a test item; all columns are kept, nothing is shuffled."""
    at = docs.columns.index(text_col)
    for index in shards(items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {d for d, *_ in held.value.pairs(batch.column(at).to_pylist(), threshold, least)}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)]))

        docs = map_arrow(docs, run, docs.schema, rows=1000, size=4 << 20)
    return docs
