"""Workers find the package wherever they start; a cluster must name a shared folder."""

import os
import subprocess
import sys

import pytest

from garderobe import session

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from garderobe.session import build_session
spark = build_session("elsewhere", 2, 2, driver_memory="2g")
print("rows", entry.queries()["page_outcomes"](spark, {sf!r}).count())
"""


def test_workers_in_another_folder(sf, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=repo, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 200" in done.stdout, done.stderr[-1500:]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Empty:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Empty})()})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(type("Spark", (), {"conf": Conf, "sparkContext": Context})())


def test_spread_after_a_join_on_its_key(spark):
    """Rows joined on a key and spread by it reach as many tasks as were asked for, though few bytes would fill one."""
    from garderobe.session import spread
    a = spark.range(2000).withColumnRenamed("id", "k")
    rows = spread(a.join(a.selectExpr("k", "k * 2 as v"), "k"), "k")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and rows.count() == 2000
