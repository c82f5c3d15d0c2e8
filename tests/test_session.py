"""Intermediate tables: where they go, and that they go away."""

import os
import subprocess
import sys
import time

from pyspark.sql import DataFrameWriter

from briefwerk.plans import letters
from briefwerk.session import shared_dir

RUN = """
from briefwerk.session import local_session, settle
spark = local_session("1")
table = settle(spark.range(10))
print("ROWS", table.count(), table.inputFiles()[0])
spark.stop()
"""


def test_a_run_leaves_nothing_behind(tmp_path):
    for given in ([str(tmp_path / "shared")], []):
        conf = "".join(f"--conf spark.checkpoint.dir={folder} " for folder in given)
        env = {**os.environ, "PYTHONPATH": os.getcwd(), "PYSPARK_SUBMIT_ARGS": f"{conf}pyspark-shell"}
        done = subprocess.run([sys.executable, "-c", RUN], capture_output=True, text=True, cwd=tmp_path, env=env)
        line = next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))
        _, rows, where = line.split()
        assert rows == "10" and (not given or where.startswith(f"file://{given[0]}"))
        for _ in range(100):  # the JVM ends a little after Python
            if not os.path.exists(where.removeprefix("file://")):
                break
            time.sleep(0.2)
        assert not os.path.exists(where.removeprefix("file://")), where


def test_the_folder_is_the_session_s_own(spark):
    assert spark.sparkContext.applicationId in shared_dir(spark)


def test_letters_are_written_by_methods_that_the_jvm_compiles(spark, tmp_path, monkeypatch):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.sql("select 1L o_custkey, 1L o_orderkey, 'F' o_orderstatus, 1.5D o_totalprice, timestamp_ntz'1998-01-02' o_orderdate, '2-HIGH' o_orderpriority").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.sql("select 1L c_custkey, 3L c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a: (seen.append(spark.conf.get(limit)), write(*a)))
    before = spark.conf.get(limit)
    assert letters.letter_table(spark, str(tmp_path)).count() == 1
    assert seen == ["8000"] and spark.conf.get(limit) == before
