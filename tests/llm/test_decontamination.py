import re
from pathlib import Path

import duckdb
import pytest

from dealloom.llm import queries
from dealloom.llm.decontamination import contamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, span=10):
    known = {}
    for item, text in items:
        if item is not None and (w := split(text)):
            n = min(span, len(w))
            for i in range(len(w) - n + 1):
                known.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in known:
                    hit.update(range(i, i + n))
                    found |= known[key]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(spark, docs, items, **other):
    d = spark.createDataFrame([(i, "x", t, 1, "y") for i, t in docs], "doc_id long, row string, text string, h int, items string")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, print string")
    return sorted([(r.row.doc_id, r.n_words, r.n_hit, list(r.items)) for r in contamination(d, b, ["doc_id", "row", "items"], **other).collect()], key=str)


LINE = [f"w{i}" for i in range(60)]
ITEMS = [
    (1, " ".join(LINE[:25])), (2, "W0, w1; w2 w3 w4 w5 w6 w7 w8 W9!"), (30, "the the the the the the the the the the the"), (4, "short item"), (5, "Ärger ÄRGER"), (6, "one"), (6, " ".join(LINE[40:55])), (None, " ".join(LINE[25:40])),
    (7, None), (8, " \x00.,"), (9, " ".join(LINE[:25])), (10, " ".join(LINE[15:25]) + " " + " ".join(LINE[:10])),
]
DOCS = [
    (1, " ".join(LINE)), (2, "x " + " ".join(LINE[:9]) + " y"), (3, "x " + " ".join(LINE[:10]).upper() + " y"), (4, "the " * 500), (5, "a SHORT  item, one short ITEM item"), (6, None), (7, ""), (8, "Ärger ÄRGER ärger Ärger"), (None, " ".join(LINE[3:14])),
    (3, "x " + " ".join(LINE[:10]) + " y"), (9, " ".join(LINE[25:40])), (10, " ".join(LINE[5:15] + LINE[0:12] + LINE[13:26])), (11, "w0" * 50_000 + " " + " ".join(LINE[:12])), (12, " ".join(f"v{i % 997} " * 3 for i in range(60_000)) + " ".join(LINE[:30])),
    (13, "\n".join(LINE[:11])), (14, ".".join(LINE[14:26])), (15, "one"), (16, " . "),
]


@pytest.mark.parametrize("other", [{}, {"prints": 3}, {"windows": 2}, {"kgram": 10}, {"kgram": 1}, {"span": 4, "kgram": 3}])
def test_against_brute_force(spark, other):
    assert got(spark, DOCS, ITEMS, **other) == brute(DOCS, ITEMS, other.get("span", 10))


def test_matches_are_the_windows(spark):
    docs = spark.createDataFrame([(1, "x y " + " ".join(LINE[:11]))], "doc_id long, text string")
    out = contamination(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"), ["doc_id"]).first()
    assert [(m.start, m.length) for m in out.matches] == [(2, 10), (3, 10)] and out.n_hit == 11


def test_empty_tables(spark):
    assert got(spark, [], ITEMS) == [] and got(spark, DOCS[:3], []) == brute(DOCS[:3], [])


def test_plan_is_native_and_shuffles_no_text(spark):
    plan = queries.queries()["op11_winnowed_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("ArrowEval", "Python", "MapInPandas", "MapInArrow", "FlatMapGroups", "CartesianProduct", "NestedLoop"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for p in Path(f"/root/testdata/sf{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(queries.oracle_sql()["op11_winnowed_decontamination"])
    out = queries.queries()["op11_winnowed_decontamination"](spark, f"/root/testdata/sf{sf}")
    assert [c[0] for c in cursor.description] == out.columns
    rows = cursor.fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in out.collect()) and any(r[5] for r in rows) and not all(r[5] for r in rows)
