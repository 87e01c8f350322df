"""Workers that can't import the repository run every operator with Python in it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("tessera") is not None))

assert spark.range(1).mapInPandas(importable, "id long").first()[0] == 0, "the workers see the repository"
from tessera.llm import queries
for name, query in queries.queries().items():
    assert query(spark, {sf!r}).count() >= 0
    print(name, flush=True)
"""


def test_workers_without_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 13
