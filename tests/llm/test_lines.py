import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L

SCHEMA = "doc_id bigint, text string, n_chars bigint, lines string, dropped string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t) if t is not None else None, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def key(line):
    return re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least, min_chars=1):
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [found[key(x)] >= least for x in lines]
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def got(marked):
    rows = marked.select("doc.doc_id", F.size("lines").alias("n"), F.size("dropped").alias("d"), F.sha2(L.kept_text(), 256).alias("s")).collect()
    return sorted((tuple(r) for r in rows), key=str)


LINES = ["Share this ", " share THIS  ", "", "  ", "É fin", "é fin", "one\r", "one", "\x0bONE\x0c", "two three", "a" * 5000, "z\u0085 ", "only here"]
ROWS = [(i, "\n".join(LINES[(i * 7 + j * j) % len(LINES)] for j in range(i % 9))) for i in range(60)]
ROWS += [(1000, None), (1001, ""), (1002, "\n"), (1003, "one\n" * 20_000 + "x"), (1004, "one\none"), (1004, "one\none"), (None, "one\nten"), (None, None), (1005, "one"), (1006, "x\n\none\n")]


@pytest.mark.parametrize("batches, fanout, broadcast", [(1, 4, "10m"), (7, 2, "-1"), (5, 3, "10m")])
@pytest.mark.parametrize("least, support", [(3, 1e-3), (10, 0.2)])
def test_against_brute_force(spark, batches, fanout, broadcast, least, support):
    runs = L.LineRuns(spark, min_docs=least, fanout=fanout, support=support)
    for b in range(batches):
        runs.add(docs(spark, ROWS[b::batches]))
    assert len(runs.runs()) <= (fanout - 1) * len(runs.levels)
    assert all(spark.table(r).count() == spark.table(r).select("h1", "h2").distinct().count() for r in runs.runs())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert got(L.mark_lines(docs(spark, ROWS), runs)) == brute(ROWS, least)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        runs.close()
    assert not runs.runs()


def test_runs_are_joined_without_a_shuffle_of_the_runs(spark):
    runs = L.LineRuns(spark, min_docs=2)
    runs.add(docs(spark, ROWS[:30]))
    batch = runs.document_counts(docs(spark, ROWS[30:])).join(spark.table(runs.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    runs.close()


def test_texts_come_back(spark):
    rows = [(i, f"Head\nbody {i}\nhead ") for i in range(12)] + [(99, None), (100, "head"), (101, "kept\n")]
    runs = L.LineRuns(spark)
    runs.add(docs(spark, rows))
    out = {r.doc_id: r for r in L.drop_repeated_lines(docs(spark, rows), runs).collect()}
    assert out[3].text == "body 3" and out[3].n_chars == 6 and out[3].lines == "clash" and out[99].text is None and out[99].n_chars is None
    assert out[100].text == "" and out[101].text == "kept\n" and len(out) == len(rows)
    runs.close()


def test_min_chars_and_nothing(spark):
    rows = [(i, "ab\nabc") for i in range(12)]
    runs = L.LineRuns(spark, min_chars=3)
    runs.add(docs(spark, rows))
    assert got(L.mark_lines(docs(spark, rows), runs)) == brute(rows, 10, 3)
    runs.close()
    empty = L.LineRuns(spark)
    empty.add(docs(spark, []))
    assert L.mark_lines(docs(spark, []), empty).count() == 0 and empty.repeated().count() == 0
    assert L.drop_repeated_lines(docs(spark, rows), L.LineRuns(spark)).filter("text = 'ab\\nabc'").count() == 12
    empty.close()


def test_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(L.ORACLE_SQL["op12_line_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    result = L.op12_line_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (result == want[result.columns]).all().all()
