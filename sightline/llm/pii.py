"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions.

The base kinds are found by linear-time patterns over the whole text. The network, trained here in
numpy from labelled spans of generated lines, adds spans that the patterns miss: telephone numbers
without a plus, grouped or ungrouped account numbers, IPv6 addresses, keys and tokens.

Every text is covered by windows of ``WINDOW`` characters, each overlapping the next by ``OVERLAP``; all of
them are decoded. The gates of the network are clipped lines instead of sigmoids, so whole texts are
affordable in numpy. Where windows overlap their emissions are averaged, and one Viterbi pass over the
whole text, across all window borders, gives its tags. Characters at which no best path can leave
the outside tag are found from bounds and left out of that pass; the result is the same. Memory is
about 100 bytes for each character of a slice of texts, or of one longer text.

Defined results: a null text is empty and has no spans; equal texts have equal spans; base spans
always stay, and an added span that overlaps one is dropped; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import map_arrow, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn")
WINDOW, OVERLAP = 256, 32
#: Windows that go through the network, and stretches that go through the Viterbi pass, at a time.
AT_ONCE, LANES = 2048, 512
HIDDEN = 8
LENGTH, STEPS, BATCH, RATE = 96, 260, 48, 0.03

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and a run is never given back
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_BASE = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern: from each at sign back over its local part, then on over its domain."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            yield begin, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind as listed, then start."""
    if not _BASE.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the network

_TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_SYMBOLS = {chr(c): c - 30 for c in range(32, 127)}
_LETTER, _OTHER, _VOCABULARY = 97, 98, 99
_ILLEGAL = np.array([[t % 2 == 0 and t > 0 and s not in (t - 1, t) for t in range(len(_TAGS))] for s in range(len(_TAGS))])


def symbols_of(text: str) -> np.ndarray:
    """Small ids of characters: printable ASCII each by itself, other letters, the rest; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where((code >= 32) & (code < 127), code - 30, _OTHER)
    high = np.flatnonzero(code >= 0xAA)
    out[high] = [_LETTER if text[i].isalpha() else _OTHER for i in high.tolist()]
    return out.astype(np.int64)


@dataclass
class Tagger:
    """Input table and recurrent weights of both directions, output layer, and CRF transitions."""

    table: np.ndarray  # (2, symbols, 4 H)
    inner: np.ndarray  # (2, H, 4 H)
    out: np.ndarray  # (2 H, tags)
    bias: np.ndarray
    moves: np.ndarray  # (tags, tags)

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng, h, k = np.random.default_rng(seed), HIDDEN, len(_TAGS)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        table = draw(0.3, 2, _VOCABULARY, 4 * h)
        table[:, :, : 3 * h] += 0.5
        table[:, :, h : 2 * h] += 0.3  # forget gates begin open
        return cls(table, draw(0.25, 2, h, 4 * h), draw(0.3, 2 * h, k), np.zeros(k, np.float32), draw(0.1, k, k))

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (windows, characters, 2 H)."""
        n, length, h = *x.shape, HIDDEN
        sides = np.stack([self.table[0][x], self.table[1][x[:, ::-1]]])
        hidden, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((2, n, length, h), np.float32)
        for t in range(length):
            z = sides[:, :, t] + hidden @ self.inner
            gates, g = z[..., : 3 * h].clip(0, 1), z[..., 3 * h :].clip(-1, 1)
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            before, cell = cell, f * cell + i * g
            wide = cell.clip(-1, 1)
            if keep is not None:
                keep.append((hidden, before, i, f, o, g, wide))
            hidden = o * wide
            out[:, :, t] = hidden
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags (characters, tags, windows): ``states`` with features first and without copies."""
        (n, length), h, steps = x.shape, HIDDEN, np.ascontiguousarray(x.T)
        rows, z, wide = np.empty((n, 4 * h), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        gates, g = z[: 3 * h], z[3 * h :]
        emit = np.empty((length, len(_TAGS), n), np.float32)
        for side, order in enumerate((range(length), range(length - 1, -1, -1))):
            inner, out = np.ascontiguousarray(self.inner[side].T), np.ascontiguousarray(self.out[side * h : side * h + h].T)
            hidden, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in order:
                np.take(self.table[side], steps[t], axis=0, out=rows, mode="clip")
                np.dot(inner, hidden, out=z)
                z += rows.T
                np.clip(gates, 0, 1, out=gates)
                np.clip(g, -1, 1, out=g)
                cell *= gates[h : 2 * h]
                cell += np.multiply(g, gates[:h], out=g)
                np.clip(cell, -1, 1, out=wide)
                np.multiply(wide, gates[2 * h :], out=hidden)
                if side:
                    emit[t] += out @ hidden
                else:
                    np.dot(out, hidden, out=emit[t])
        emit += self.bias[:, None]
        return emit

    def open_to_spans(self, gain: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Characters of texts one behind the other at which the best path may leave the outside tag; ``gain`` is the lead of the best other emission.

        All other tags are taken as one, with the best emission and the best transitions that any of them has.
        The most that a span through a character can gain over staying outside is then a sum of what it
        gains up to there and from there on, both maxima over where it begins and ends. Where that is below 0, no
        best path has a span, as a span can always be replaced by outside tags.
        """
        moves = self.moves.astype(np.float64) - float(self.moves[0, 0])
        enter, on, leave = moves[0, 1::2].max(), moves[1:, 1:][~_ILLEGAL[1:, 1:]].max(), moves[1:, 0].max()
        into, out_of = np.full(len(gain), enter), np.full(len(gain), leave)
        into[begins], out_of[np.r_[begins[1:], len(gain)] - 1] = max(enter, 0), max(leave, 0)
        total = np.r_[0, np.cumsum(gain + on)]
        ahead = total[1:] - on - np.minimum.accumulate(total[:-1] - into)
        back = np.r_[np.cumsum((gain + on)[::-1])[::-1], 0]
        behind = back[:-1] - on - np.minimum.accumulate((back[1:] - out_of)[::-1])[::-1]
        return ahead + behind - gain >= -1e-3

    def best_paths(self, emit: np.ndarray, sizes: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Tags (characters, lanes) by Viterbi for lanes of these sizes; a lane comes after the outside tag where ``opened``, and before it where ``closed``."""
        moves = np.where(_ILLEGAL, np.float32(-1e4), self.moves)
        length, _, lanes = emit.shape
        best = emit[0] + np.where(_ILLEGAL[0], np.float32(-1e4), 0)[:, None] + np.where(opened, self.moves[0][:, None], 0)
        came, ends = np.empty(emit.shape, np.int8), np.zeros(lanes, np.int8)
        close = lambda b: (b + np.where(closed, moves[:, 0][:, None], 0)).argmax(axis=0)
        for t in range(length):
            if t:
                paths = best[:, None, :] + moves[:, :, None]
                came[t] = paths.argmax(axis=0)
                best = paths.max(axis=0) + emit[t]
            if (done := sizes == t + 1).any():
                ends[done] = close(best)[done]
        tags, at, rows = np.zeros((length, lanes), np.int8), np.zeros(lanes, np.int8), np.arange(lanes)
        for t in range(length - 1, -1, -1):
            at = np.where(sizes == t + 1, ends, at)
            tags[t] = np.where(sizes > t, at, 0)
            if t:
                at = np.where(sizes > t, came[t, at, rows], at)
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradients."""
        n, length, h = *x.shape, HIDDEN
        kept: list = []
        states = self.states(x, kept)
        emit = (states @ self.out + self.bias).astype(np.float64)
        ahead, behind = np.empty(emit.shape), np.zeros(emit.shape)
        total = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, length):
            ahead[:, t] = total(ahead[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
        for t in range(length - 2, -1, -1):
            behind[:, t] = total(self.moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        norm = total(ahead[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = emit[rows, places, y].sum() + self.moves[y[:, :-1], y[:, 1:]].sum()
        d_emit = np.exp(ahead + behind - norm[:, None, None])
        d_moves = np.zeros_like(self.moves)
        for t in range(1, length):
            d_moves += np.exp(ahead[:, t - 1, :, None] + self.moves + (emit[:, t] + behind[:, t] - norm[:, None])[:, None, :]).sum(axis=0)
        np.add.at(d_moves, (y[:, :-1], y[:, 1:]), -1)
        d_emit[rows, places, y] -= 1
        d_emit = (d_emit / n).astype(np.float32)
        flat = d_emit.reshape(-1, len(_TAGS))
        grads = {"out": states.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(axis=0), "moves": d_moves / n}
        d_states = d_emit @ self.out.T
        d_side = np.stack([d_states[..., :h], d_states[:, ::-1, h:]])
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_hidden, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        sides = [x, x[:, ::-1]]
        for t in range(length - 1, -1, -1):
            hidden, before, i, f, o, g, wide = kept[t]
            d = d_hidden + d_side[:, :, t]
            d_cell = d_cell + d * o * (abs(wide) < 1)
            inside = lambda gate: (gate > 0) & (gate < 1)
            z = np.concatenate([d_cell * g * inside(i), d_cell * before * inside(f), d * wide * inside(o), d_cell * i * (abs(g) < 1)], axis=2)
            d_cell = d_cell * f
            d_inner += hidden.transpose(0, 2, 1) @ z
            d_hidden = z @ self.inner.transpose(0, 2, 1)
            for side in (0, 1):
                np.add.at(d_table[side], sides[side][:, t], z[side])
        return float(norm.sum() - gold) / n, grads | {"table": d_table, "inner": d_inner}


#: Letters of words in about the proportions of four languages, and all alike.
_LETTERS = ("etaoinshrdlu" * 4 + "cmfwypvbgkjqxz", "easitnrulod" * 4 + "cmpévqfbghjàxèyêzçôùâîïœ", "enisratdhul" * 4 + "cgmobwfkzpvjyxqäöüß", "eaosrnidlct" * 4 + "umpbgvyqhfzjñxóáéíú", "abcdefghijklmnopqrstuvwxyz")


def labelled_line(draw: random.Random, length: int) -> tuple[str, list[Span]]:
    """A generated line of about that length with labelled spans."""
    letters = draw.choice(_LETTERS)
    word = lambda low=1, high=14: "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    tail, upper = draw.choice(["", "", "", "", draw.choice(["%%%", "$$$", "###", "***", "&&&", "!!", " |"])]), draw.random() < 0.15

    def entity() -> tuple[str, str]:
        kind = draw.choice(["email", "ip", "card", "phone", "phone", "secret", "secret", "secret", "ssn", "none", "none"])
        if kind == "email":
            text = f"{word(2, 9)}.{digits(2)}@{word(3, 8)}{draw.choice(['', digits(1)])}.{draw.choice(['example.com', 'com', 'org', 'co.uk', 'de'])}"
        elif kind == "ip":
            text = ".".join(str(draw.randint(0, 255)) for _ in range(4)) if draw.random() < 0.7 else ":".join(f"{draw.randint(0, 65535):x}" for _ in range(8))
        elif kind == "card":
            text = draw.choice([digits(16), draw.choice(" -").join(digits(4) for _ in range(4))])
        elif kind == "phone":
            text = draw.choice(["+{c} ({a}) {b}-{d}", "({a}) {b}-{d}", "+{c}{a}{b}{d}", "+{c} {a} {b} {d}", "{a}-{b}-{d}", "+{c}.{a}.{b}.{d}"]).format(c=draw.randint(1, 99), a=digits(3), b=digits(3), d=digits(4))
        elif kind == "ssn":
            text = f"{digits(3)}-{digits(2)}-{digits(4)}"
        elif kind == "secret":
            mixed = lambda low, high, signs: "".join(draw.choice(signs) for _ in range(draw.randint(low, high)))
            letters_, signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
            text = draw.choice([mixed(32, 48, "0123456789abcdef"), draw.choice(["sk_", "sk-", "AKIA", "ghp_", "key-"]) + mixed(16, 40, signs), mixed(24, 44, letters_ + "+/_-"), mixed(24, 44, signs)])
        else:
            text = draw.choice([digits(draw.randint(1, 7)), f"{digits(1)}.{digits(1)}.", f"{draw.randint(1900, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", f"{draw.randint(0, 23)}:{draw.randint(0, 59):02}", f"version {digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}", f"{digits(2)}%", f"{word()}{digits(2)}", f"@{word()}"])
        return kind, text

    text, spans = "", []
    while len(text) < length:
        if draw.random() < 0.12:
            kind, found = entity()
            around = draw.choice([("", ""), ("", ""), ("", ""), ("", "."), ("", ","), ("(", ")"), ('"', '"')])
            lead = draw.choice(['token = "', 'key="', "token: ", 'password="', "secret: "]) if kind == "secret" and draw.random() < 0.6 else around[0]
            text += lead
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(found)))
            text += found + ('"' if lead.endswith('"') else around[1] if not lead or lead == around[0] else "") + tail
        else:
            w = word()
            text += (w.upper() if upper else w.capitalize() if draw.random() < 0.1 else w) + draw.choice(["", "", "", "", "", ",", "."]) + tail
        text += draw.choice([" "] * 12 + ["\n"])
    return (text.upper() if upper and draw.random() < 0.3 else text), spans


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * KINDS.index(kind)
        tags[a : a + 1] -= 1
    return tags


def train(seed: int = 11, steps: int = STEPS) -> Tagger:
    """Fit on windows of generated lines with labelled spans, by Adam."""
    draw, net, length = random.Random(seed), Tagger.fresh(seed), LENGTH
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in net.__dataclass_fields__}
    for step in range(1, steps + 1):
        x, y = np.zeros((BATCH, length), np.int64), np.zeros((BATCH, length), np.int64)
        for b in range(BATCH):
            text, spans = labelled_line(draw, 2 * length)
            at = draw.randrange(0, len(text) - length + 1)
            tags = tags_of(spans, len(text))[at : at + length]
            if tags[0] and tags[0] % 2 == 0:
                tags[0] -= 1  # a span that the window cuts begins at its edge
            x[b], y[b] = symbols_of(text[at : at + length]), tags
        _, grads = net.gradients(x, y)
        size = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values()))) / 5)
        rate = RATE * (1 - (step - 1) / steps) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        for k, (m, v) in moments.items():
            g = grads[k] / size
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(net, k)[...] -= rate * m / (np.sqrt(v) + 1e-8)
    return net


class Emissions:
    """Emissions of texts one behind the other (none is empty), averaged where windows overlap.

    A window has its characters up to where the next one of its text begins. Windows go through the network in
    groups; a group also has the window before its first one, for the part that both cover.
    """

    def __init__(self, net: Tagger, codes: np.ndarray, begins: np.ndarray):
        sizes, step = np.diff(np.r_[begins, len(codes)]), WINDOW - OVERLAP
        many = np.maximum(1, -(-(sizes - OVERLAP) // step))
        of = np.repeat(np.arange(len(begins)), many)
        self.start = begins[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
        size = np.minimum(self.start + WINDOW, (begins + sizes)[of]) - self.start
        own = np.diff(np.r_[self.start, len(codes)])
        self.groups: list[tuple[int, np.ndarray]] = []  # first window of its own, emissions (characters, tags, windows)
        self.gain = np.empty(len(codes), np.float64)
        padded = np.concatenate([codes, np.zeros(WINDOW, codes.dtype)])
        for at in range(0, len(self.start), AT_ONCE):
            low = max(0, at - 1)
            a, n = self.start[low : at + AT_ONCE], size[low : at + AT_ONCE]
            spot = np.arange(int(n.max()))
            emit = net.emissions(padded[a[:, None] + spot] * (spot < n[:, None]))
            follows = np.flatnonzero(np.diff(of[low : at + AT_ONCE]) == 0)
            if len(follows):
                emit[:OVERLAP, :, follows + 1] = (emit[:OVERLAP, :, follows + 1] + emit[step:WINDOW, :, follows]) / 2
            lead = (emit[:, 1:].max(axis=1) - emit[:, 0]).T[at - low :]
            mine = own[at : at + AT_ONCE]
            self.gain[self.start[at] : self.start[at] + mine.sum()] = lead[spot < mine[:, None]]
            self.groups.append((at, emit[:, :, at - low :]))

    def at(self, place: np.ndarray) -> np.ndarray:
        """Emissions (characters, tags) of these characters, in rising order."""
        window = np.searchsorted(self.start, place, "right") - 1
        cut = np.searchsorted(window, [at for at, _ in self.groups] + [len(self.start)])
        parts = [emit[place[i:j] - self.start[window[i:j]], :, window[i:j] - at] for (at, emit), i, j in zip(self.groups, cut[:-1], cut[1:], strict=True)]
        return np.concatenate(parts)


def network_tags(net: Tagger, codes: np.ndarray, begins: np.ndarray, *, prune: bool = True) -> np.ndarray:
    """Best tags of texts one behind the other (none is empty): one Viterbi pass over each whole text."""
    tags, emissions = np.zeros(len(codes), np.int8), Emissions(net, codes, begins)
    place = np.flatnonzero(net.open_to_spans(emissions.gain, begins)) if prune else np.arange(len(codes))
    emit = emissions.at(place)
    is_begin = np.zeros(len(codes) + 1, bool)
    is_begin[begins] = is_begin[-1] = True
    begin = np.flatnonzero(np.r_[True, np.diff(place) > 1] | is_begin[place]) if len(place) else place
    size = np.diff(np.r_[begin, len(place)])
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        lanes = order[at : at + max(1, min(LANES, 1_000_000 // int(size[order[at]])))]
        n, spot = size[lanes], np.arange(int(size[lanes[0]]))[:, None]
        inside = spot < n
        index = np.where(inside, begin[lanes] + spot, 0)
        opened, closed = ~is_begin[place[begin[lanes]]], ~is_begin[place[begin[lanes] + n - 1] + 1]
        tags[place[index[inside]]] = net.best_paths(emit[index].transpose(0, 2, 1), n, opened, closed)[inside]
        at += len(lanes)
    return tags


def network_spans(net: Tagger, texts: list[str], *, prune: bool = True) -> list[list[Span]]:
    """Spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    some = [d for d, t in enumerate(texts) if t]
    if not some:
        return out
    sizes = np.array([len(texts[d]) for d in some])
    begins = np.cumsum(sizes) - sizes
    tags = network_tags(net, np.concatenate([symbols_of(texts[d]) for d in some]), begins, prune=prune)
    marked = np.flatnonzero(tags)
    # a span begins at a B tag; its I tags follow it without a gap
    starts = marked[tags[marked] % 2 == 1]
    ends = marked[np.r_[(np.diff(marked) > 1) | (tags[marked[1:]] % 2 == 1), True]] + 1 if len(marked) else marked
    of = np.searchsorted(begins, starts, "right") - 1
    for d, a, b in zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True):
        out[some[d]].append((KINDS[(int(tags[a]) - 1) // 2], a - int(begins[d]), b - int(begins[d])))
    return out


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans and those added ones that overlap none, by kind as listed, then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0, np.int64)
    free = [(kind, a, b) for kind, a, b in added if (i := int(np.searchsorted(starts, b))) == 0 or ends[i - 1] <= a]
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, net: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); one row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_of(batch.column(1))
            base = [base_spans(t) for t in texts]
            spans = [all_spans(b, s) for b, s in zip(base, network_spans(net, texts), strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(s) for s in spans]), pa.array([len(s) - len(b) for s, b in zip(spans, base, strict=True)], pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", size=1 << 20)
