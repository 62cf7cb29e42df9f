import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@needs_data
def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["chunk_mad_trim", "medmad_normalise", "emit_bases_phred", "run_emission", "flip_flop_path", "run_length_partition", "fastq_records", "affine", "rle_compress", "long_read_path", "run_samples", "asof_changes", "sketch_quantiles", "exact_sums", "session_windows", "streamed_partitions", "written_runs", "parsed_files", "expanded_runs"])
def test_queries_equal_their_sql(spark, name):
    from strandspark.plans import driver_queries as q

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = q.queries()[name](spark, DATA)
    sql = db.sql(q.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=key)


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "strandspark"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "strandspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
