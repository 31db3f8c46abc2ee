"""Every query of the engine gives the rows of its SQL on the small tables; and what is left without the llm parts."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from attestry.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    own = con.sql(ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(df.columns)
    order = [own.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in order) for r in own.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_without_the_llm_parts(tmp_path):
    """The registry imports, and keeps the other queries, where the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "attestry"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (ROOT / "attestry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "attestry" / p.name)
    (tmp_path / "run.py").write_text(f"import sys\nsys.path[:0] = [{str(tmp_path)!r}]\nimport importlib.util\ns = importlib.util.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r})\nm = importlib.util.module_from_spec(s)\ns.loader.exec_module(m)\nprint(len(m.queries()), any(k.startswith('op') for k in m.queries()))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr
