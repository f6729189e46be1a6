import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tesserae.session import checkpoint, load, shared_root
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
assert shared_root(s) == {shared!r}
import __spark_entry__ as e
print("ROWS", e.queries()["p5_found"](s, "/root/testdata/sf0.001").count(), checkpoint(s.range(3)).count())
"""


def test_named_folder_and_workers_elsewhere(tmp_path):
    """Run from another folder, without the package on the workers' path: it is shipped through the named folder."""
    shared = f"file://{tmp_path}/shared"
    out = subprocess.run([sys.executable, "-c", RUN.format(root=str(ROOT), shared=shared)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert list((tmp_path / "shared").glob("tesserae-*.zip")) and list((tmp_path / "shared").rglob("part-*"))
