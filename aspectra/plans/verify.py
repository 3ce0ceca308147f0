"""Hold queries against their SQL twins, row by row: python -m aspectra.plans.verify SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list[tuple]:  # noqa: ANN001
    """Rows with columns by name, sorted, and floats as they are."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else v.item() if hasattr(v, "item") else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, duck, name: str, fn, sql: str | None, sf_dir: str) -> str:  # noqa: ANN001
    began = time.time()
    df = fn(spark, sf_dir)
    mine = df.toPandas()
    took = time.time() - began
    if sql is None:
        return f"rows {len(mine)} ({took:.1f}s)" if len(mine) else "EMPTY"
    theirs = duck.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(mine.columns)} {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    kinds = {c: (str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns if str(mine[c].dtype) != str(theirs[c].dtype)}
    odd = {c: k for c, k in kinds.items() if {k[0][:3], k[1][:3]} not in ({"obj", "str"}, {"obj"}, {"str"})}
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"DIFF {len(a)} {len(b)} {wrong[:2]}"
    return f"ok {len(a)}{' EMPTY' if not a else ''}{f' TYPES {odd}' if odd else ''} ({took:.1f}s)"


def main(sf_dir: str, names: list[str]) -> int:
    import duckdb

    from aspectra.plans import catalogue
    from aspectra.session import session

    spark, duck, bad = session(), duckdb.connect(), 0
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, oracles = catalogue.queries(), catalogue.oracle_sql()
    for name in names or queries:
        try:
            said = compare(spark, duck, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001  every query is to be reported
            said = f"ERROR {str(error)[:600]}"
        bad += not said.startswith(("ok", "rows"))
        print(f"{name}: {said}", flush=True)
    print(f"{len(names or queries)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
