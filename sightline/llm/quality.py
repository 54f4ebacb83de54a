"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Filters of
``WIDTH`` bytes slide over each chunk; as the input is one-hot, a filter is a table of weights by
place and byte, and its response is a sum of looked-up rows. A second input channel, the echo,
marks bytes whose next four bytes stood up to ``LAGS`` bytes before; each filter also weighs its mean
over ``BOX`` bytes, as one-hot bytes alone cannot show repetition. Responses are max-pooled over each
chunk; the mean and the maximum over the chunks go through a small hidden layer to one
probability.

Trained here by Adam on a bounded sample of labelled rows (``MAX_ROWS`` documents in an order
given by a hash of their ids), with all chunks of each, as in scoring; rows held out are never read
for that. Labels, language, source and id are no input.

Defined results: a null or empty text is one chunk of padding and gets a score as well; equal
texts get equal scores; where no row is labelled every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import map_arrow

CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS, HIDDEN = 512, 64, 6, 2, 12, 8
LAGS, BOX = 32, 64
#: Bound of the training sample, in documents.
MAX_ROWS = 1200
EPOCHS, BATCH, RATE = 8, 32, 0.02


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks (n, CHUNK) of all bytes; the rest of the last one is zero."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def echo_of(chunks: np.ndarray) -> np.ndarray:
    """Mean of the echo channel over the BOX bytes from each position of a filter: (chunks, positions)."""
    wide = chunks.astype(np.uint32)
    code = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    echo = np.zeros(code.shape, bool)
    for lag in range(1, LAGS + 1):
        echo[:, lag:] |= code[:, lag:] == code[:, :-lag]
    echo &= code != 0  # not the padding
    total = np.zeros((len(chunks), CHUNK + BOX), np.int32)
    np.cumsum(echo, axis=1, out=total[:, 1 : CHUNK - 2])
    total[:, CHUNK - 2 :] = total[:, CHUNK - 3, None]
    places = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
    return ((total[:, places + BOX] - total[:, places]) / np.float32(BOX)).astype(np.float32)


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    echo: np.ndarray  # (FILTERS,)
    bias: np.ndarray
    hidden: np.ndarray  # (2 FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.3, WIDTH, 256, FILTERS), draw(1.0, FILTERS), np.zeros(FILTERS, np.float32), draw(0.4, 2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(0.4, HIDDEN), np.zeros(1, np.float32))

    def pooled(self, chunks: np.ndarray, echo: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled responses (chunks, FILTERS), and at which positions if asked."""
        last = CHUNK - WIDTH + 1
        response = self.table[0][chunks[:, 0:last:STRIDE]]
        for k in range(1, WIDTH):
            response += self.table[k][chunks[:, k : last + k : STRIDE]]
        response += echo[:, :, None] * self.echo
        best = response.max(axis=1)
        return np.tanh(best + self.bias), response.argmax(axis=1) if where else None

    def head(self, chunk_values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document features, hidden values and probabilities; document d has the chunks from starts[d]."""
        sizes = np.diff(np.r_[starts, len(chunk_values)])
        features = np.hstack([np.add.reduceat(chunk_values, starts) / sizes[:, None], np.maximum.reduceat(chunk_values, starts)]).astype(np.float32)
        hidden = np.tanh(features @ self.hidden + self.hidden_bias)
        return features, hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias[0], -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not texts:
            return np.empty(0)
        values, starts, pending, n = [], [], [], 0
        for t in texts:
            starts.append(n)
            pending.append(chunks_of(t.encode("utf-8", "replace")))
            n += len(pending[-1])
        every = np.concatenate(pending)
        for at in range(0, n, 64):
            values.append(self.pooled(every[at : at + 64], echo_of(every[at : at + 64]))[0])
        return self.head(np.concatenate(values), np.array(starts))[2].astype(np.float64)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit on the bytes of documents, with classes of equal total weight."""
    net = Network.fresh(seed)
    names = list(net.__dataclass_fields__)
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    rng, step = np.random.default_rng(seed), 0
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())).clip(0, 4)
    data = [chunks_of(raw) for raw in texts]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            chunks = np.concatenate([data[i] for i in take])
            echo = echo_of(chunks)
            sizes = np.array([len(data[i]) for i in take])
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(take)), sizes)
            values, where = net.pooled(chunks, echo, True)
            features, hidden, p = net.head(values, starts)
            error = ((p - labels[take]) * weight[take] / len(take)).astype(np.float32)
            d_hidden = error[:, None] * net.out * (1 - hidden**2)
            d_features = d_hidden @ net.hidden.T
            top = (values == features[owner, FILTERS:]).astype(np.float32)
            top /= np.add.reduceat(top, starts)[owner]
            d_values = (d_features[owner, :FILTERS] / sizes[owner, None] + d_features[owner, FILTERS:] * top) * (1 - values**2)
            d_table = np.zeros_like(net.table)
            rows, filters = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(d_table[k], (chunks[rows, where * STRIDE + k], filters), d_values)
            grads = {"table": d_table, "echo": (echo[rows, where] * d_values).sum(axis=0), "bias": d_values.sum(axis=0), "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0), "out": hidden.T @ error, "out_bias": error.sum(keepdims=True)}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(net, k)[...] -= rate * m / (np.sqrt(v) + 1e-8)
    return net


def fit(labelled: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Network | None:
    """Train on the whole texts of a bounded sample; None where nothing is labelled."""
    text = F.coalesce(labelled[text_col].cast("string"), F.lit(""))
    sample = labelled.where(labelled[label_col].isNotNull()).select(labelled[id_col].alias("id"), labelled[label_col].cast("int").alias("label"), text.alias("text")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = sorted((r for r in sample.collect()), key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
    if not rows:
        return None
    return train([r["text"].encode("utf-8", "replace") for r in rows], np.array([r["label"] for r in rows], np.float32))


def held_out(id_column) -> F.Column:
    """crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, **options) -> Network | None:
    """Train on the labelled rows that are not held out.

    The sample is drawn from the labels alone and is broadcast, at most ``max_rows`` ids; documents
    are scanned for them and not shuffled.
    """
    known = labels.where(~held_out(labels["doc_id"]) & F.col("quality").isNotNull()).select(F.col("doc_id").alias("of_"), "quality").distinct()
    drawn = known.orderBy(F.xxhash64("of_"), "of_", "quality").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("of_"))
    return fit(rows, max_rows=max_rows, **options)


def score(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score) and the columns in ``keep``; one row per input row, no shuffle."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores = np.full(len(texts), 0.5) if net is None else net.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "score", *(f"kept_{k}" for k in keep)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[k].alias(f"kept_{k}") for k in keep])
    schema = ", ".join(["doc_id long", "score double", *(f"`kept_{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)])
    return map_arrow(rows, run, schema, rows=256, size=1 << 20).select("doc_id", "score", *[F.col(f"kept_{k}").alias(k) for k in keep if k not in ("doc_id", "score")])


def keep_good(docs: DataFrame, net: Network | None, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns are kept, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is not None:
                batch = batch.filter(pa.array(net.score([t or "" for t in batch.column(at).to_pylist()]) >= least))
            yield batch

    return map_arrow(docs, run, docs.schema, rows=256, size=1 << 20)
