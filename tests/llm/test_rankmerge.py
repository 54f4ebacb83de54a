import random

import numpy as np
import pytest

from sightline.llm import rankmerge as R
from sightline.llm.queries import vocabulary

RANGES = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x370), (0x370, 0x530), (0x530, 0x800), (0x900, 0xE00), (0xE00, 0x1100), (0x1E00, 0x2100), (0x2100, 0x2C00), (0x3000, 0x3200), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0xFB00, 0x10000), (0x1D400, 0x1D500), (0x1F300, 0x1F700)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(texts):
    merger = R.merger(vocabulary())
    return [np.frombuffer(x, merger.id_type).tolist() for x in merger.encode(texts)]


def test_ids_equal_the_library_over_all_scripts():
    draw, lib = random.Random(5), library()
    texts = []
    for _ in range(20_000):
        spans = draw.sample(RANGES, draw.randint(1, 3))
        parts = []
        for _ in range(draw.randint(1, 5)):
            low, high = draw.choice(spans)
            parts.append("".join(chr(draw.randrange(low, high)) for _ in range(draw.randint(1, 7))))
        texts.append(draw.choice([" ", "", "\n", "\t ", "'s "]).join(parts))
    texts += ["AZ\u018fRBAYCAN \u018flif", "\u0186k\u0186 \u0190 \u0181ata", "\u0130stanbul I\u0130", "\u01c5ungla \u023a\u2c65", "e\u0301 E\u0301\u0323", "\u017f\u212a"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = ids_of(texts)
    wrong = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not wrong, wrong[:3]
    assert R.merger(vocabulary()).count(texts) == [len(w) for w in want]


def test_specials_repeats_and_long_texts_equal_the_library():
    lib = library()
    special = list(R.merger(vocabulary()).special)
    texts = ["", " ", "\n \t", *special, *(f"word{s}word {s}{s} <|x" for s in special), "a" * 30_000, "ab " * 40_000, "1234567" * 3000, "don't we'll I'M", "x" * 7 + "\x85y\xa0z"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want


@pytest.mark.parametrize("rows", [1, 3])
def test_table_with_nulls_repeats_and_clashing_columns(spark, rows):
    texts = [None, "", "  ", "A plain text.", "A plain text.", "lone \ud800 surrogate".encode("utf-8", "replace").decode(), "w " * 3000]
    docs = spark.createDataFrame([(i, t, 0, 9) for i, t in enumerate(texts)] * rows + [(None, "no id", 1, 1)], "doc_id long, text string, n_tokens int, n_bytes long")
    got = sorted((tuple(r) for r in R.count_tokens(docs, vocabulary()).collect()), key=str)
    lib = library()
    one = lambda i, t: (i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048)
    assert got == sorted([one(i, t) for i, t in enumerate(texts)] * rows + [one(None, "no id")], key=str)
    assert R.count_tokens(docs.limit(0), vocabulary()).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and R.count_tokens(docs.limit(0), vocabulary()).count() == 0
