import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# stand-in models of the tests are pickled by reference, so the workers must find this folder
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])

from dossier.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ev(spark):
    """Evaluate a column function on one value."""
    from pyspark.sql import functions as F

    def run(value, fn, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("o")).first()[0]

    return run
