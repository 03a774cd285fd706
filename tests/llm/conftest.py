import duckdb
import pytest

from shopmeter.llm.queries import ORACLES, QUERIES


@pytest.fixture
def agrees(spark):
    """Compare a registered query with its SQL on a folder of tables."""

    def check(key, sf_dir, tables):
        engine = duckdb.connect()
        for name in tables:
            engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        df = QUERIES[key](spark, sf_dir)
        names = sorted(df.columns)
        mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
        cursor = engine.execute(ORACLES[key])
        order = [[d[0] for d in cursor.description].index(n) for n in names]
        theirs = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
        assert len(cursor.description) == len(names)
        assert mine == theirs
        return mine

    return check
