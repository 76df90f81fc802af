"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from parchmint.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that are left out here.
LONG = set()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LONG))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted([str([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect()])
    if name not in catalog.ORACLES:
        assert rows or name in ("document_phones",)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


def test_entry_imports_without_the_training_data_part(tmp_path):
    """In a copy without those folders, entry and tests are still there; with them, the queries are."""
    import json
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__", ".pytest_cache"))
    told = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    names, sql = json.loads(told.stdout.strip().splitlines()[-1])
    assert set(names) == set(catalog.QUERIES) and set(sql) == set(catalog.ORACLES) and not (copy / "parchmint" / "llm").exists()


def test_clean_all_lines_against_unicodedata(spark, tmp_path):
    import re
    import unicodedata

    from parchmint.functions.text import FOLDED

    texts = ["caf\u00e9  \ufb01n\nplain ---- x", "\u201cquoted\u201d \uff11\uff12\n\u0995\u09bf", None, "e\u0301....... \u2460"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def clean(line):
        folded = unicodedata.normalize("NFKC", line).translate(str.maketrans(*FOLDED))
        return re.sub("[ \t\u200b-\u200d]+", " ", re.sub(r"([.\-=_*~])\1{3,}", r"\1\1\1", folded)).strip()

    want = {(i, len(x), sum(map(len, map(clean, x)))) for i, x in enumerate((t or "").split("\n") for t in texts)}
    assert set(map(tuple, catalog.QUERIES["clean_all_lines"](spark, str(tmp_path)).collect())) == want


def test_line_sections(spark, tmp_path):
    texts = ["Corner Store\n1 Oak Street\nDate: 2026-08-01\nSoap 3.00\nBread 4.00\nTOTAL 7.00\nVISA", "alpha\nbeta"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(0, "merchant", 2), (0, "metadata", 1), (0, "items", 2), (0, "totals", 1), (0, "payment", 1), (1, "merchant", 2)}
    assert set(map(tuple, catalog.QUERIES["line_sections"](spark, str(tmp_path)).collect())) == want


def test_merchant_address_is_read_and_not_added(spark, tmp_path, monkeypatch):
    """What the query returns is what the lines say: without the line of the city, the address has no city."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(7,), (10,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    read = lambda: {r["doc_id"]: r["address"] for r in catalog.merchant_block(spark, str(tmp_path)).collect()}
    assert read() == {7: "8 Oak Lane, Springfield, 00007", 10: "11 Oak Street, Springfield, 00010"}
    printed = catalog.single_lines
    monkeypatch.setattr(catalog, "single_lines", lambda rows, key, *texts: printed(rows, key, *texts).withColumn("lines", F.filter("lines", lambda x: ~x["text"].contains("Springfield"))))
    assert read() == {7: "8 Oak Lane", 10: "11 Oak Street"}


def test_envelopes_hold_whole_receipts(spark, tmp_path):
    """The body that is hashed is that of the contract: the receipt with all its fields, and who asked."""
    import hashlib
    import json

    from parchmint.operators.assemble import extract_receipts

    spark.sql("SELECT id AS o_orderkey, DATE '2026-08-01' AS o_orderdate FROM range(1, 4)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT id % 3 + 1 AS l_orderkey, id AS l_partkey, 1L AS l_suppkey, id AS l_linenumber, id + 0.25D AS l_extendedprice FROM range(9)").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT id AS p_partkey, concat('green soap', id) AS p_name FROM range(9)").write.parquet(str(tmp_path / "part.parquet"))
    docs = catalog._receipts(spark, str(tmp_path)).select("doc_id", "lines")
    whole = {r[0]: r[1] for r in extract_receipts(docs, catalog.TODAY).selectExpr("doc_id", "to_json(receipt, map('ignoreNullFields', 'false'))").collect()}

    def body(k):
        told = json.loads(whole[k])["validation"]
        warnings = json.dumps([{c: x[c] for c in ("code", "message", "field")} for x in told["errors"] + told["warnings"]], separators=(",", ":"))
        made = f'{{"request_id":"{k}","api_version":"v1","pipeline_version":"1.0.0","schema_version":"1.0","processing_time_ms":0.0}}'
        return f'{{"success":true,"data":{whole[k]},"warnings":{warnings},"errors":[],"processing":{made}}}'

    got = {r["doc_id"]: r["body_sha256"] for r in catalog.envelopes(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and got == {k: hashlib.sha256(body(k).encode()).hexdigest() for k in whole}
