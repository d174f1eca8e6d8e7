import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
        "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression over one row of named values."""
    def run(expression, **values):
        names = list(values) or ["_"]
        row = tuple(values.values()) if values else (0,)
        df = spark.createDataFrame([row], ", ".join(f"{n} {kind(v)}" for n, v in zip(names, row)))
        out = df.select(expression.alias("r")).first()["r"]
        return out.asDict() if hasattr(out, "asDict") else out

    def kind(v):
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, int):
            return "bigint"
        if isinstance(v, float):
            return "double"
        if isinstance(v, list):
            return f"array<{kind(v[0]) if v else 'string'}>"
        return "string"

    return run
