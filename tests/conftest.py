import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopmeter.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "shopmeter-tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def frame(spark):
    """Rows to a DataFrame; a column name ending in ``date`` turns its text into a date."""

    def build(schema, rows):
        names = [part.split()[0] for part in schema.split(",")]
        df = spark.createDataFrame(rows, schema)
        for name in names:
            if name.endswith("date") and dict(df.dtypes)[name] == "string":
                df = df.withColumn(name, df[name].cast("date"))
        return df

    return build


def records(df, *order):
    rows = [row.asDict() for row in df.collect()]
    for row in rows:
        for key, value in row.items():
            if hasattr(value, "isoformat"):
                row[key] = value.isoformat()
    return sorted(rows, key=lambda row: [str(row[name]) for name in order])
