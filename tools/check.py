"""Run registered queries beside their SQL in DuckDB: ``python tools/check.py SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidemark.plans import load  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def cells(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple("NULL" if v is None or v is pd.NA or v != v else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row))
    return sorted(out)


def main(sf: str, names: list[str]) -> int:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    spark = local_session(8)
    failed = []
    todo = load()
    for name, q in todo.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            start = time.time()
            df = q.build(spark, sf)
            kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            mine = df.toPandas()
            took = time.time() - start
            if q.oracle is None:
                print(f"ROWS {name} {len(mine)} {took:.2f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(q.oracle).fetchdf()
            sql_took = time.time() - start
            doubles = {c for c, k in kinds.items() if k == "double"}
            note = "" if doubles == set(q.doubles) else f" DOUBLES {sorted(doubles ^ set(q.doubles))}"
            odd = {c: k for c, k in kinds.items() if k not in ("double", "bigint", "string", "boolean")}
            if odd:
                note += f" TYPES {odd}"
            if sorted(mine.columns) != sorted(theirs.columns):
                print(f"FAIL {name} columns {sorted(mine.columns)} / {sorted(theirs.columns)}")
                failed.append(name)
                continue
            loose = [c for c, k in kinds.items() if k in ("bigint", "boolean") and (mine[c].isna().any() or theirs[c].isna().any())]
            if loose:
                note += f" NULLABLE {loose}"
            a, b = cells(mine), cells(theirs)
            if a == b:
                print(f"ok   {name} rows={len(a)} {took:.2f}s sql={sql_took:.2f}s{note}", flush=True)
                if note:
                    failed.append(name)
            else:
                failed.append(name)
                print(f"FAIL {name} rows {len(a)}/{len(b)}{note}")
                sa, sb = set(a), set(b)
                print("   ", sorted(mine.columns))
                for row in sorted(sa - sb)[:3]:
                    print("    spark", row)
                for row in sorted(sb - sa)[:3]:
                    print("    sql  ", row, flush=True)
        except Exception as error:
            failed.append(name)
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
