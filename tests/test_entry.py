import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["full_backtest", "factor_model", "directional_regime", "adaptive_agents", "hurst_consensus", "stress_suite", "parsed_klines", "kill_switch", "historical_var", "component_var", "rolling_normal_backtest", "coverage_tests", "hurst_quick", "base_agents", "macro_regime", "overfitting_probability", "asof_prices"]


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    shown = lambda df: sorted(tuple("null" if v != v or v is None else f"{v:.4f}" if isinstance(v, float) else str(v)[:10] for v in row) for row in df[columns].itertuples(index=False))
    assert shown(got) == shown(want)


def test_rest_imports_without_the_text_operators(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "ebbline"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    package = tmp_path / "ebbline"
    package.mkdir()
    for p in (root / "ebbline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "entry_copy.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import sys; sys.path.insert(0, '.'); import entry_copy as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
