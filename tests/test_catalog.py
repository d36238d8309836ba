"""Every named query against its SQL on the smallest tables, and the entry point without the optional subpackage."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sievewright.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(repr([round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_as_sql(spark, tables, name):
    want = tables.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("caps", [[(20, 50, None, 0.25), (20, 50, 2000, 0.45), (20, 100, 1000, 0.75), (20, 50, 1500, 1.0)], [(3, 50, None, 0.1), (2, 50, 200, 0.2), (9, 100, 100, 0.9)]])
def test_small_caps_as_sql(spark, tables, caps):
    want = tables.sql(catalog.caps_sql(caps, 80_000)).project("doc_id, source_rank, n_chars, chars_before").fetchall()
    got = catalog.capped(spark, SF, caps, 80_000).selectExpr("doc_id", "source_rank", "length(piece) AS n_chars", "chars_before").collect()
    assert plain(tuple(r) for r in got) == plain(want)


@pytest.mark.parametrize("most", [1, 20, 60])
def test_few_stored_rows_as_sql(spark, tables, most):
    from sievewright.operators import dedup

    want = tables.sql(catalog.capped_sql(most)).project("doc_id, near_duplicate").fetchall()
    assert plain(tuple(r) for r in dedup.near_duplicates(catalog.documents(spark, SF), "text", most=most).collect()) == plain(want)


def test_windows_query(spark):
    rows = catalog.QUERIES["windows"](spark, SF).collect()
    assert len(rows) == 256 and all(r.y[:-1] == r.x[1:] for r in rows)


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cascade' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_only_the_optional_subpackage_may_be_missing(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git"))
    broken = tmp_path / "r" / "corpus_pipeline.py"
    if not broken.exists():
        pytest.skip("it is absent")
    broken.write_text("import a_module_that_is_nowhere\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True).returncode != 0


def test_cascade_as_a_plain_process_has_it(spark):
    import plain
    from sievewright.functions.constants import Thresholds
    from sievewright.operators import dedup, gates

    docs = catalog.documents(spark, SF)
    got = {r.doc_id: r for r in gates.with_reason(gates.arrived(docs), "text", Thresholds(min_words=50)).collect()}
    given = {r.doc_id: r.text.strip() for r in docs.collect()}
    for k, text in given.items():
        assert (got[k].reason, got[k].clean_text) == plain.verdict(text, 50)
    for r in gates.with_reason(gates.arrived(catalog.pages(spark, SF), "html"), "html", Thresholds(min_words=50)).collect():
        page = spark.read.parquet(f"{SF}/pages.parquet").filter(f"page_id = {r.page_id}").first().html.strip() if r.page_id < 5 else None
        assert page is None or (r.reason, r.clean_text) == plain.verdict(page, 50)
    passed = sorted(k for k in given if got[k].reason is None)[:60]
    marks = {r.doc_id: r.dup_reason for r in dedup.deduplicate(docs.filter(docs.doc_id.isin(passed)).select("doc_id", "text"), "text").collect()}
    assert [marks[k] for k in passed] == plain.duplicates([given[k] for k in passed])
