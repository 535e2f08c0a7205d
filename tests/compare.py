"""Runs every query and its SQL side by side and reports differences.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples with columns by name; nulls as None, floats as repr."""
    frame = frame[sorted(frame.columns)]

    def value(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "null"
        if isinstance(x, float):
            return repr(float(x))
        if hasattr(x, "item"):
            return value(x.item())
        return repr(x) if not isinstance(x, pd.Timestamp) else x.isoformat()

    return sorted(tuple(value(x) for x in row) for row in frame.itertuples(index=False, name=None))


def arrow_types(frame_schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_string", "string").replace("[us, tz=UTC]", "[us]") for f in frame_schema}


def difference(spark_df, con, sql: str) -> str | None:
    """None when names, types and values agree."""
    left = spark_df.toArrow()
    right = con.execute(sql).to_arrow_table() if hasattr(duckdb.DuckDBPyConnection, "to_arrow_table") else con.execute(sql).fetch_arrow_table()
    lt, rt = arrow_types(left.schema), arrow_types(right.schema)
    notes = []
    if lt != rt:
        notes.append(f"schema {sorted(set(lt.items()) ^ set(rt.items()))}")
        if set(lt) != set(rt):
            return "; ".join(notes)
    a, b = canonical_arrow(left), canonical_arrow(right)
    if len(a) != len(b):
        notes.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        extra = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        notes.append(f"values of {sorted(lt)}: spark {extra[0]} sql {extra[1]}")
    return "; ".join(notes) or None


def canonical_arrow(table) -> list[tuple]:
    names = sorted(table.schema.names)
    columns = [table.column(n).to_pylist() for n in names]

    def value(x):
        if hasattr(x, "isoformat"):
            return x.replace(tzinfo=None).isoformat() if hasattr(x, "tzinfo") else x.isoformat()
        return repr(x)

    return sorted(tuple(value(x) for x in row) for row in zip(*columns))


def main() -> int:
    import __spark_entry__ as entry
    from touchline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf_dir), con, sql[name]) if name in sql else "no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
