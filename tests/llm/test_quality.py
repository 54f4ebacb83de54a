import zlib

import numpy as np

from sightline.llm import quality as Q


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["river", "stone", "quiet", "morning", "walks", "under", "bright", "window", "letter", "garden"]
    out = []
    for i in range(n):
        text, good = " ".join(rng.choice(words, rng.integers(20, 200))), int(rng.random() < 0.7)
        if not good:
            text = [text.replace(" ", "$$$ "), text.upper() + "!!", " ".join(w + " " + w + " " + w for w in text.split())][i % 3]
        out.append((i, text, good))
    return out


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 448, 449, 512, 513, 5000):
        raw = bytes(np.random.default_rng(n).integers(1, 256, n, np.uint8))
        chunks = Q.chunks_of(raw)
        step = Q.CHUNK - Q.OVERLAP
        assert b"".join(c[:step].tobytes() for c in chunks[:-1]) + chunks[-1].tobytes() == raw + bytes((len(chunks) - 1) * step + Q.CHUNK - n)


def test_echo_marks_repeats_only():
    calm = Q.chunks_of(b"abcdefghijklmnopqrstuvwxyz0123456789" * 1)
    assert Q.echo_of(calm).max() == 0
    assert Q.echo_of(Q.chunks_of(b"word " * 100))[0, 3:150].min() == 1  # the first word is new


def test_responses_equal_a_plain_loop():
    net, chunk = Q.Network.fresh(1), Q.chunks_of(b"The quick brown fox! " * 9)
    echo = Q.echo_of(chunk)
    want = [max(sum(net.table[k, chunk[0, p * Q.STRIDE + k], f] for k in range(Q.WIDTH)) + echo[0, p] * net.echo[f] for p in range((Q.CHUNK - Q.WIDTH) // Q.STRIDE + 1)) for f in range(Q.FILTERS)]
    assert np.allclose(net.pooled(chunk, echo)[0][0], np.tanh(np.array(want) + net.bias), atol=1e-5)


def test_document_score_equals_a_plain_loop():
    net, text = Q.Network.fresh(3), "The quick brown fox jumps over the lazy dog, again and again and again! " * 31
    raw, step, values = text.encode(), Q.CHUNK - Q.OVERLAP, []
    for at in range(0, len(raw) - Q.OVERLAP, step):
        chunk = raw[at : at + Q.CHUNK].ljust(Q.CHUNK, b"\0")
        echo = [int(any(i >= lag and chunk[i : i + 4] == chunk[i - lag : i - lag + 4] for lag in range(1, Q.LAGS + 1)) and chunk[i : i + 4] != bytes(4)) for i in range(Q.CHUNK - 3)]
        places = range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE)
        values.append([max(sum(net.table[k, chunk[p + k], f] for k in range(Q.WIDTH)) + sum(echo[p : p + Q.BOX]) / Q.BOX * net.echo[f] for p in places) + net.bias[f] for f in range(Q.FILTERS)])
    pooled = np.tanh(values)
    hidden = np.tanh(np.r_[pooled.mean(axis=0), pooled.max(axis=0)] @ net.hidden + net.hidden_bias)
    assert len(values) > 3 and abs(net.score(["short", text])[1] - 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias[0])))) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    rows = sample(900)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(5000, None, "x", 1), (5001, "", "x", 1), (5002, rows[0][1] * 90, "x", 1), (5003, rows[3][1], "y", 0), (5003, rows[3][1], "y", 0)], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    net = Q.fit_on_labels(docs, labels)
    got = Q.score(docs, net).withColumn("held_out", Q.held_out(Q.F.col("doc_id"))).toPandas()
    assert len(got) == 905
    truth, p = {i: q for i, _, q in rows}, got.drop_duplicates("doc_id").set_index("doc_id").score
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert set(got[got.held_out].doc_id) - {5000, 5001, 5002, 5003} == set(out)
    assert np.mean([(p[i] >= 0.5) == truth[i] for i in out]) > 0.97
    assert p[5003] == p[3] and p[5000] == p[5001] and 0 <= p.min() <= p.max() <= 1


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = Q.fit_on_labels(docs, labels)
    assert net is None and Q.score(docs, net).first().score == 0.5
    assert Q.score(docs.limit(0), net).count() == 0
