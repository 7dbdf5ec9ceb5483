"""Run named queries on Spark and their SQL on DuckDB and compare the full results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(s: pd.Series) -> str:
    if s.dtype == object:
        vals = s.dropna()
        return type(vals.iloc[0]).__name__ if len(vals) else "none"
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(s.dtype.kind, s.dtype.kind)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), None).map(
        lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    )
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def check(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from epochlens import catalog

    t0 = time.time()
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - t0
    sql = catalog.SQL.get(name)
    if sql is None:
        return True, f"rows={len(got)} spark={took:.2f}s (no SQL)"
    t1 = time.time()
    want = (con or connect(sf_dir)).execute(sql).df()
    msg = f"rows={len(got)}/{len(want)} spark={took:.2f}s duckdb={time.time() - t1:.2f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return False, msg
    a, b = normal(got), normal(want)
    same = a.eq(b).all(axis=1)
    if not same.all():
        i = int(np.flatnonzero(~same.to_numpy())[0])
        return False, f"{msg} first difference {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    kinds = {c: (_kind(got[c]), _kind(want[c])) for c in got.columns if _kind(got[c]) != _kind(want[c])}
    return True, msg + (f" kinds {kinds}" if kinds else "")


if __name__ == "__main__":
    from epochlens import catalog
    from epochlens.session import build_session

    sf = sys.argv[1]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(catalog.QUERIES)
    con = connect(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = check(spark, n, sf, con)
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += not ok
        print("OK  " if ok else "FAIL", n, msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
