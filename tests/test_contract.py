"""The library without its optional parts, and its hygiene."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_entry_without_the_optional_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})


def test_a_broken_dependency_is_an_error(tmp_path):
    """Only the optional part's absence is forgiven."""
    import shutil

    shutil.copytree(ROOT / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    assert done.returncode and "no_such_module" in done.stderr
