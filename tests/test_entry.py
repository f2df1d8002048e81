import importlib
import os

import pytest


def test_own_code_does_not_need_the_llm_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in (root / "roadweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "roadweave.llm" not in path.read_text(), path


@pytest.mark.parametrize("gone", [("roadweave/llm",), ("roadweave/llm", "corpus_pipeline.py"), ()])
def test_entry_without_the_llm_folders(tmp_path, gone):
    """A copy of the repository without them still gives its own queries; with them it gives all of theirs too."""
    import json
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    if not (root / "roadweave" / "llm").exists() and not gone:
        pytest.skip("the folders are gone already")
    for name in ("roadweave", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            left_out = [p for p in gone if p.startswith(name + "/")]
            shutil.copytree(root / name, tmp_path / name, ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{pathlib.Path(d).relative_to(root)}/{n}" in left_out])
        elif (root / name).exists() and name not in gone:
            shutil.copy(root / name, tmp_path / name)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    names, sql = json.loads(done.stdout.splitlines()[-1])
    extra = [n for n in names if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit())]
    assert len(extra) == (0 if gone else 14) and set(sql) <= set(names) and "candidate_events" in names


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


NAMES = ["candidate_events", "asof_nearest", "interval_merge", "score_tiou", "kappa", "cider_d", "tfidf_retrieval", "dbscan", "graph_stats", "rider_metrics"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob

    entry = importlib.import_module("__spark_entry__")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted([tuple(dict(zip(names, r))[c] for c in columns) for r in cur.fetchall()], key=repr)
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    assert len(got) == len(want) and all(near(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
