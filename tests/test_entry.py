import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree_on_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_training_data_package():
    code = "import sys; sys.modules['webloom.llm'] = None\nimport webloom.plans.queries, webloom.plans.oracles, webloom.job, webloom.streaming.frontier\nassert not [m for m in sys.modules if m.startswith('webloom.llm.')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
