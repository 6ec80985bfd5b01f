"""What a driver leaves behind."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).parent.parent)
RUN = """
import sys
from leafmill.session import local_session, shared_dir, stored
spark = local_session(1, 1, "1g")
table = stored(spark.range(5))
assert table.count() == 5 and shared_dir(spark) == sys.argv[1]
spark.range(3).write.parquet(sys.argv[1] + "/other")
if len(sys.argv) > 2:
    spark.stop()
"""


def test_tables_go_with_the_driver(tmp_path):
    """Its own tables go, with a stopped session or without; what others wrote stays."""
    for n, more in enumerate(([], ["stop"])):
        shared = tmp_path / str(n)
        env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={shared} pyspark-shell"}
        done = subprocess.run([sys.executable, "-c", RUN, str(shared), *more], capture_output=True, text=True, timeout=200, env=env)
        assert done.returncode == 0, done.stderr[-1500:]
        assert not [p for p in (shared / "tables").rglob("*.parquet")] and (shared / "other" / "_SUCCESS").exists()
