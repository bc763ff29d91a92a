import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_points_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_works_without_the_text_operators(tmp_path):
    """As after the removal of corpus_pipeline.py and the llm folders."""
    for name in ("__spark_entry__.py", "tidewise"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tidewise.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'so05_tiered' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_works_without_a_package_of_the_text_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'so05_tiered' in q and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
