import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_all_queries_are_registered():
    import __spark_entry__
    import corpus_pipeline

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tariffloom"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "tariffloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'duty_by_order' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_other_tests_are_found_without_both_folders(tmp_path):
    for name in ("__spark_entry__.py", "tariffloom", "tests"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "tariffloom" / "llm"), str(tmp_path / "tests" / "llm")], check=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    assert "test_oracle.py" in found and "error" not in found.lower()
    quick = ["tests/test_oracle.py", "-k", "test_import or every_query or fx_asof"]
    subprocess.run([sys.executable, "-m", "pytest", *quick, "-q"], cwd=tmp_path, check=True, capture_output=True)
