import subprocess
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The subpackage, its tests and the pipeline may be missing."""
    code = (
        "import sys, shutil; shutil.copytree('genonet', sys.argv[1] + '/genonet', ignore=shutil.ignore_patterns('llm')); shutil.copy('__spark_entry__.py', sys.argv[1])\n"
        "sys.path[:] = [sys.argv[1]] + [p for p in sys.path if p]; import os; os.chdir(sys.argv[1])\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'candidate_genes' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    )
    assert subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True).stderr == ""
