"""The repository without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as d; q = d.queries(); print(len(q), 'pipeline' in q, sum(n.startswith('op') for n in q))"


def counted(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


def copied(folder: Path, *left_out: str) -> Path:
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *left_out))
    return folder


def test_entry_without_the_optional_folders(tmp_path):
    from workload import registry

    core = len(registry.QUERIES)
    assert counted(copied(tmp_path / "without_llm", "llm")) == [str(core), "False", "0"]
    assert counted(copied(tmp_path / "without_both", "llm", "corpus_pipeline.py")) == [str(core), "False", "0"]
    assert counted(copied(tmp_path / "without_pipeline", "corpus_pipeline.py"))[1] == ("False")
