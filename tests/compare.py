"""A query's rows against those of its SQL in another engine."""

import math
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4)
    return value


def differences(spark, sf_dir, query, sql):
    """(rows only in Spark, rows only in SQL, number of rows)."""
    import duckdb

    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        there = Counter(tuple(_plain(r[names.index(n)]) for n in sorted(names)) for r in cursor.fetchall())
    rows = query(spark, sf_dir)
    assert sorted(rows.columns) == sorted(names), (sorted(rows.columns), sorted(names))
    here = Counter(tuple(_plain(r[n]) for n in sorted(names)) for r in rows.collect())
    return here - there, there - here, sum(here.values())
