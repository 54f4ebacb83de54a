"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens, the distinct pre-tokens of a batch are laid out as one ragged numpy array of
symbol ids, and in each round every pre-token applies its own lowest-rank pair, at all places at
once. The symbols that survive when no pair has a rank are the tokens.

Defined results: a null text counts as empty (0 bytes, 0 tokens); white space alone has 0 tokens;
lone surrogates are read as the replacement character. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import map_arrow, text_of

#: Pre-tokens that one worker keeps; beyond it the table is emptied, so memory stays bounded.
CACHE_ENTRIES = 400_000
#: Symbols merged at a time.
BATCH_SYMBOLS = 2_000_000

_NO_RANK = np.int32(2**31 - 1)
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Below U+0180 no text changes under NFC, letters and numbers are the same in all Unicode versions, and
#: lower case stays below, but for the capital I with a dot (U+0130).
_ODD = re.compile("[\u0130\u0180-\U0010ffff]")
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_NUMBER}]|[^\t-\r \x85\xa0{_NUMBER}{_LATIN}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code points from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Applies a word-end BPE vocabulary (a ``tokenizers`` JSON file) to many pre-tokens at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + ("|".join(map(re.escape, self.special)) or r"(?!)") + ")")
        alphabet = byte_alphabet()
        self.byte_of = {c: i for i, c in enumerate(alphabet)}
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.id_type = np.dtype("<u2" if max([*vocab.values(), *self.special.values()]) < 1 << 16 else "<u4")
        self._index(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), max(vocab.values()) + 1)
        self.counts: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}

    def _index(self, left: np.ndarray, right: np.ndarray, width: int) -> None:
        """Row displacement: pair (a, b) stands in slot shift[a] + b of one table that records its owner a."""
        size = 1 << int(np.ceil(np.log2(max(4 * len(left), 2 * width))))
        self.mask = np.int32(size - 1)
        self.shift, self.owner, self.slot_rank = np.zeros(width, np.int32), np.full(size, -1, np.int32), np.full(size, _NO_RANK, np.int32)
        order = np.argsort(left, kind="stable")
        firsts = np.flatnonzero(np.r_[True, np.diff(left[order]) != 0])
        groups = np.split(order, firsts[1:])
        draw = np.random.default_rng(0)
        for group in sorted(groups, key=len, reverse=True):
            a, b = left[group[0]], right[group]
            while True:
                shift = int(draw.integers(size))
                slots = (b + shift) & (size - 1)
                if (self.owner[slots] < 0).all():
                    break
            self.shift[a], self.owner[slots], self.slot_rank[slots] = shift, a, group

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = (right + self.shift[left]) & self.mask
        return np.where(self.owner[slot] == left, self.slot_rank[slot], _NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols that survive in each pre-token (none is empty), and all of them in order."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        final = np.zeros(len(sym), bool)  # last symbol of its pre-token
        final[ends] = True
        rank = np.full(len(sym), _NO_RANK, np.int32)  # of the pair that begins at a symbol
        at = np.flatnonzero(~final)
        rank[at] = self.rank(sym[at], sym[at + 1])
        seq, size = np.arange(len(pieces)), sizes
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            lowest = np.minimum.reduceat(rank, np.cumsum(size) - size)
            alive = lowest != _NO_RANK
            if not alive.all():
                stays = np.repeat(alive, size)
                done.append((seq[~alive], size[~alive], sym[~stays]))
                sym, final, rank = sym[stays], final[stays], rank[stays]
                seq, size, lowest = seq[alive], size[alive], lowest[alive]
                if not len(sym):
                    break
            owner = np.repeat(np.arange(len(seq)), size)
            at = np.flatnonzero(rank == lowest[owner])
            # of adjacent hits (a a a) every second one overlaps the one before it
            index = np.arange(len(at))
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
            at = at[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            size = size - np.bincount(owner[at], minlength=len(size))
            sym[at] = self.merged[rank[at]]
            final[at] = final[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, final, rank = sym[keep], final[keep], rank[keep]
            at = at - np.arange(len(at))  # where the merged symbols stand now
            before = at[at > 0] - 1
            changed = np.concatenate([at, before[~final[before]]])
            ended = final[at]
            rank[at[ended]] = _NO_RANK
            changed = changed[~final[changed]]
            rank[changed] = self.rank(sym[changed], sym[changed + 1])
        counts = np.zeros(len(pieces), np.int64)
        if not done:
            return counts, np.empty(0, np.int32)
        which, many, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        counts[which] = many
        to = np.cumsum(counts) - counts
        out = np.empty(len(symbols), np.int32)
        out[np.repeat(to[which] - (np.cumsum(many) - many), many) + np.arange(len(symbols))] = symbols
        return counts, out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings stay whole, and odd chunks are cut by the library."""
        if "<|" in text and self._special.search(text):
            return [q for part in self._special.split(text) if part for q in ([part] if part in self.special else self.pieces(part))]
        if not _ODD.search(text):
            return _PLAIN_PIECES.findall(text.lower())
        out: list[str] = []
        plain: list[str] = []
        for chunk in _WHITE.split(text):
            if not _ODD.search(chunk):
                plain.append(chunk)
                continue
            out += _PLAIN_PIECES.findall(" ".join(plain).lower())
            plain = []
            normal = self.library.normalizer.normalize_str(chunk)
            out += [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out + _PLAIN_PIECES.findall(" ".join(plain).lower())

    def _learn(self, unknown: list[str], ids: bool) -> None:
        at = 0
        while at < len(unknown):
            size, begin = 0, at
            while at < len(unknown) and size < BATCH_SYMBOLS:
                size += len(unknown[at])
                at += 1
            some = unknown[begin:at]
            counts, symbols = self.merge([p.encode() for p in some])
            if ids:
                raw, ends = symbols.astype(self.id_type).tobytes(), (np.cumsum(counts) * self.id_type.itemsize).tolist()
                self.ids.update((p, raw[i:j]) for p, i, j in zip(some, [0, *ends], ends, strict=False))
            else:
                self.counts.update(zip(some, counts.tolist(), strict=True))

    def _cut(self, texts: list[str], ids: bool) -> list[list[str]]:
        cache = self.ids if ids else self.counts
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        cut = [self.pieces(t.encode("utf-8", "replace").decode() if _SURROGATE.search(t) else t) for t in texts]
        cache.update({s: np.array([i], self.id_type).tobytes() if ids else 1 for s, i in self.special.items()})
        unknown: set[str] = set()
        for pieces in cut:
            unknown.update(pieces)
        self._learn([x for x in unknown if x not in cache], ids)
        return cut

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = self._cut(texts, False)
        return [sum(map(self.counts.__getitem__, pieces)) for pieces in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, little-endian in ``id_type``."""
        cut = self._cut(texts, True)
        return [b"".join(map(self.ids.__getitem__, pieces)) for pieces in cut]


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One per worker and vocabulary, kept between tasks."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` -> (doc_id, n_bytes, n_tokens, over_limit), one row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(vocabulary)
        for batch in batches:
            texts = text_of(batch.column(1))
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
