import pytest

from briefwerk.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "briefwerk-tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function over a list of values: ``values(f, ["a", "b"])``."""

    def run(column_function, rows, schema="v string"):
        from pyspark.sql import functions as F

        rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, f"_i int, {schema}")
        names = [f for f in df.columns if f != "_i"]
        out = df.select("_i", column_function(*[F.col(n) for n in names]).alias("x"))
        return [r.x for r in out.orderBy("_i").collect()]

    return run
