"""The driver's entry with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()))"


def run(folder: str) -> tuple[int, str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True)
    return done.returncode, done.stdout.strip()


def test_entry_without_the_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "pixelloom"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        if os.path.exists(f"{ROOT}/{name}"):
            copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "pixelloom" / "llm", ignore_errors=True)
    for gone in (None, "corpus_pipeline.py"):
        if gone and (tmp_path / gone).exists():
            (tmp_path / gone).unlink()
        code, out = run(str(tmp_path))
        assert code == 0 and out.split()[2] == "0" and int(out.split()[0]) == int(out.split()[1]) > 60


def test_a_broken_text_operator_is_an_error(tmp_path):
    """Only absence is let pass; what fails to import is told."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/pixelloom", tmp_path / "pixelloom")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run(str(tmp_path))[0] != 0
