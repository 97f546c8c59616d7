import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})


def copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "spark-warehouse"))
    return tmp_path / "r"


def test_entry_without_the_corpus_operators(tmp_path):
    folder = copy(tmp_path)
    shutil.rmtree(folder / "rookery/llm", ignore_errors=True)
    shutil.rmtree(folder / "tests/llm", ignore_errors=True)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    got = run(folder, "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'to_uci' in q and set(o) <= set(q); assert not [x for x in q if x.startswith('op') or x == 'pipeline']; print('fine')")
    assert got.stdout.strip() == "fine", got.stderr


def test_entry_does_not_hide_faults(tmp_path):
    folder = copy(tmp_path)
    (folder / "rookery/llm").mkdir(exist_ok=True)
    (folder / "rookery/llm/__init__.py").write_text("")
    (folder / "rookery/llm/queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(folder, "import __spark_entry__").stderr


def test_nothing_else_imports_them():
    for path in ROOT.glob("rookery/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", path.read_text()), path
