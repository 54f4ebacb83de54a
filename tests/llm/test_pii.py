import hashlib
import random
import re

import numpy as np
import pytest

from sightline.llm import pii


@pytest.fixture(scope="module")
def net():
    return pii.train()


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_patterns_equal_the_plain_ones():
    draw = random.Random(0)
    texts = ["", "a@b.c", "a@@b.c.", "a@b.c@d.e", "x..y@-.-", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.0255", "+1 (017) 555-7713", "++12345678", "4111 1111-1111 1111", "4111111111111111"]
    texts += ["".join(draw.choice("ab.@-+19 ().é\n") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(draw.choice("0123456789 -.") for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        pii.base_spans(t)


def test_gradients():
    net = pii.Tagger.fresh(1)
    for k in net.__dataclass_fields__:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 20, (2, 5)), rng.integers(0, 3, (2, 5))
    _, grads = net.gradients(x, y)
    for k in net.__dataclass_fields__:
        flat = getattr(net, k).reshape(-1)
        i = int(np.abs(grads[k]).argmax())
        old, e = flat[i], 1e-3
        flat[i] = old + e
        up = net.gradients(x, y)[0]
        flat[i] = old - e
        down = net.gradients(x, y)[0]
        flat[i] = old
        assert abs((up - down) / (2 * e) - grads[k].reshape(-1)[i]) < 1e-2, k


def test_viterbi_equals_all_paths():
    net = pii.Tagger.fresh(2)
    x = np.random.default_rng(1).integers(1, 90, (1, 3))
    emit = (net.states(x) @ net.out + net.bias)[0]
    k = len(pii._TAGS)
    legal = lambda s, t: not pii._ILLEGAL[s, t]
    best = max(((a, b, c) for a in range(k) for b in range(k) for c in range(k) if legal(0, a) and legal(a, b) and legal(b, c)), key=lambda p: emit[0, p[0]] + emit[1, p[1]] + emit[2, p[2]] + net.moves[p[0], p[1]] + net.moves[p[1], p[2]])
    no = np.array([False])
    assert net.best_paths(net.emissions(x), np.array([3]), no, no)[:, 0].tolist() == list(best)
    assert np.allclose(net.emissions(x)[:, :, 0], emit, atol=1e-5)


def test_windows_and_bounds_equal_one_pass_over_the_whole_text(net, monkeypatch):
    draw = random.Random(9)
    texts = ["".join(draw.choice([pii.labelled_line(draw, draw.randint(5, 900))[0], "plain words of prose, no more. " * draw.randint(1, 40)]) for _ in range(draw.randint(1, 4))) for _ in range(40)] + ["", "x", "7" * 5000]
    for name, value in (("AT_ONCE", 3), ("LANES", 2)):
        whole = pii.network_spans(net, texts)
        assert whole == pii.network_spans(net, texts, prune=False) and sum(map(len, whole)) > 100
        monkeypatch.setattr(pii, name, value)
        assert pii.network_spans(net, texts) == whole
    for t in texts:  # averaged emissions, then one plain Viterbi pass over the text
        if not t:
            continue
        step, codes = pii.WINDOW - pii.OVERLAP, pii.symbols_of(t)
        total, count = np.zeros((len(t), len(pii._TAGS))), np.zeros((len(t), 1))
        for at in range(0, max(1, len(t) - pii.OVERLAP), step):
            part = codes[at : at + pii.WINDOW]
            x = np.zeros((1, min(pii.WINDOW, len(t))), np.int64)
            x[0, : len(part)] = part
            total[at : at + len(part)] += (net.states(x) @ net.out + net.bias)[0, : len(part)]
            count[at : at + len(part)] += 1
        emit, moves = total / count, np.where(pii._ILLEGAL, -1e4, net.moves)
        best, came = emit[0] + np.where(pii._ILLEGAL[0], -1e4, 0), []
        for e in emit[1:]:
            came.append((best[:, None] + moves).argmax(axis=0))
            best = (best[:, None] + moves).max(axis=0) + e
        path = [int(best.argmax())]
        for c in reversed(came):
            path.append(int(c[path[-1]]))
        got = pii.network_tags(net, codes, np.array([0]))
        assert (got == path[::-1]).mean() > 0.999  # the last window of a batch is padded, a text alone is not


def test_prose_of_four_languages_is_left_alone(net):
    text = "The quiet river runs under the old bridge and the children walk home. Les élèves lisent au jardin près de la fenêtre où l'oiseau chante. Die Straße führt über grüne Hügel zum großen Haus. El niño pequeño corre por la montaña y la señora canta. " * 20
    assert pii.network_spans(net, [text]) == [[]]


def test_held_out_lines(net):
    draw, hits, found, wanted = random.Random(5), 0, 0, 0
    for _ in range(150):
        text, spans = pii.labelled_line(draw, 500)
        got = set(pii.network_spans(net, [text])[0])
        hits, found, wanted = hits + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert hits / found > 0.9 and hits / wanted > 0.9


def test_query_rows_and_edges(spark, net):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    long = "river stone " * 9000 + f'token = "{secret}" then a.b@c.de ' + "under the window " * 3000
    rows = [(1, None, "z"), (2, "", "z"), (3, long, "z"), (4, "call +1 (017) 555-7713 or 10.0.0.1", "z"), (4, "call +1 (017) 555-7713 or 10.0.0.1", "z"), (5, "no data here", "z")]
    got = sorted((tuple(r) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string"), net).collect()), key=lambda r: r[0])
    for (i, t, _), r in zip(rows, got):
        base = brute(t or "")
        assert r[0] == i and r[1:5] == tuple(sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        assert r[5] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert all(pii.written([s]) in r[6].split(",") for s in base)
    at = long.index(secret)
    assert f"secret:{at}:{at + 40}" in got[2][6] and got[0][6] == got[1][6] == got[5][6] == ""
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_secrets_without_digits_and_other_kinds_are_found(net):
    keys = ["sk_QwErTyUiOpAsDfGhJkLzXcVbNm", "hKzTqWbXcVnMaSdFgHjKlPoIuYtReWqZxCvBnMaKsJd", "ghp_abcdefghijkmnpqrstuvwxyz"]
    for key in keys:
        text = "plain words of the old prose " * 20 + f'key="{key}" and more words ' + "of the prose " * 20
        at = text.index(key)
        assert pii.network_spans(net, [text]) == [[("secret", at, at + len(key))]]
    text = "call the office, id 123-45-6789 as given, or see the paper of the house"
    assert pii.network_spans(net, [text]) == [[("ssn", 20, 31)]]
