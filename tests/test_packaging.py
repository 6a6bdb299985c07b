"""The package in workers of a job that starts elsewhere, and the entry without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
JOB = """
import sys
sys.path.insert(0, {root!r})
from newsgraph.session import build
spark = build("elsewhere", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
from newsgraph.plans.crawl import pick_pages
from newsgraph.operators.contacts import newest_picks
pages = spark.createDataFrame([("u", '<a rel="author" href="http://x">Jane</a>')], "url string, html string")
assert newest_picks(pick_pages(pages)).count() == 1
spark.stop()
"""


def run(code, folder, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300,
                          env={"PATH": "/usr/bin:/bin", "HOME": str(folder), **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, **env})


def test_job_in_another_folder(tmp_path):
    done = run(JOB.format(root=str(ROOT)), tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_without_the_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) == set(q), set(q) ^ set(e.oracle_sql())"
    done = run(code, copy)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_reports_other_missing_modules(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    if not (copy / "newsgraph" / "llm").exists():
        return
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = run("import __spark_entry__", copy)
    assert done.returncode != 0 and "no_such_module" in done.stderr
