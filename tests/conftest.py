import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessitura.session import local_session  # noqa: E402


# Started on import: test modules build column expressions at their top level.
SESSION = local_session(4, memory="8g", name="tests")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture()
def values(spark):
    """Evaluate a column expression over rows of one string column `t`; NULL included."""

    def run(expression, texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["v"] for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
