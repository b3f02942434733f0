"""A session started outside the repository reaches the package on its workers."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from folioscope.session import local_session
from folioscope.packaging import ship
from folioscope.operators.chunks import rag_chunks
spark = local_session(2)
ship(spark)
docs = spark.createDataFrame([("a.json", '{{"n": [1, 2]}}')], "source_file string, raw string")
print("CHUNKS", rag_chunks(docs).first().text.replace(chr(10), "|"))
"""


def test_ship(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "CHUNKS n[1]: 1|n[2]: 2" in done.stdout, done.stderr[-2000:]
