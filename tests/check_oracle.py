"""Run catalogue queries against their SQL in DuckDB: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda x: None if pd.isna(x) else repr(round(float(x), 9)))
        elif str(df[c].dtype).startswith("Int") and df[c].isna().any():
            df[c] = df[c].map(lambda x: None if pd.isna(x) else repr(float(x)))
        elif pd.api.types.is_bool_dtype(df[c]) or pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) else str(list(x)) if hasattr(x, "__iter__") and not isinstance(x, str) else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def _kinds(df: pd.DataFrame) -> dict:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    got = spark_df.toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kg, kw = _kinds(got), _kinds(want)
    odd = {c: (kg[c], kw[c]) for c in kg if kg[c] != kw[c]}
    g, w = _norm(got), _norm(want)
    bad = [c for c in g.columns if not g[c].equals(w[c])]
    if bad:
        i = next(i for i in range(len(g)) if any(g[c][i] != w[c][i] for c in bad))
        return f"values differ in {bad}; first: {dict(g.iloc[i])} != {dict(w.iloc[i])}"
    if odd and len(got):
        return f"(equal values) kinds differ: {odd}"
    return None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as entry
    from estatelens.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    skip = [n[1:] for n in names if n.startswith("-")]
    names = [n for n in names if not n.startswith("-")]
    if skip:
        from estatelens.plans import graph

        queries = {k: v for k, v in queries.items() if k not in graph.catalogue.queries} if "graph" in skip else queries
    for name, fn in queries.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                rows = ""
            else:
                diff, rows = None, f" rows={df.count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            diff, rows = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += diff is not None and not diff.startswith("(equal")
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}{rows} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
