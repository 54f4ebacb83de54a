import re
from pathlib import Path

import duckdb

from sightline.llm import license as L


def brute(text):
    """Base places by plain comparison at every word."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for label, phrase in L.BASE for k in [phrase.split()] for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


ROWS = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "Released under the MIT License. MIT license, mit-license!", "x"),
    (4, "GNU General Public License, version 3. gnu general PUBLIC x license", "x"),
    (5, "cc by cc by nc CC BY-SA éCC BY", "x"),
    (6, "You may not use this file except in compliance with the very License; you may obtain a copy of the License at", "x"),
    (7, "mit " * 30000 + "license", "x"),
    (8, "Apache\n License\tApache license version 2.0 K", "x"),
    (8, "Apache\n License\tApache license version 2.0 K", "x"),
    (9, "license mit", "x"),
]


def test_base_places_and_labels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, row string")
    got = sorted((tuple(r) for r in L.scan(docs).collect()), key=lambda r: r[0])
    assert len(got) == len(ROWS)
    for (i, t, _), r in zip(ROWS, got):
        assert r[0] == i and r[1:6] == brute(t), i
        assert 0 <= r[7] <= 1 and set(filter(None, r[5].split(","))) <= set(r[6].split(","))
    by = {r[0]: r for r in got}
    assert by[6][6] == "apache-2" and by[6][5] == "" and by[4][6] == "gpl,gpl-3" and by[5][6] == "cc-by,cc-by-nc,cc-by-sa"
    assert by[1][6] == "" and by[1][7] == 0 and by[9][1:] == (2, 0, None, None, "", "", 0.0)


def test_sql_twin_and_empty_table(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, row string")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ROWS])
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, L.scan(docs).collect()), key=key) == sorted(con.sql(L.oracle()).fetchall(), key=key)
    assert L.scan(docs.limit(0)).count() == 0


def test_nothing_is_written_and_no_python_runs(spark):
    """Each file that an executor writes starts a command, which counts the executor's memory twice for a moment."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.rglob("*")}
    out = L.scan(spark.createDataFrame(ROWS, "doc_id long, text string, row string"))
    assert out.count() == len(ROWS) and {*shared.rglob("*")} == before
    plan = L.template_positions(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation"), plan
