"""Compares a query with its DuckDB oracle: columns, types, and rows in any order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    types = dict(zip(names, [str(d[1]) for d in found.description], strict=True))
    theirs = found.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    out += [f"type of {c}: {t} and {types[c]}" for c, t in df.dtypes if _TYPES.get(t, t) != types[c]]
    order = sorted(names)
    key = lambda rows: sorted(map(repr, rows))
    mine = key(tuple(r[c] for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = key(tuple(r[i] for i in at) for r in theirs)
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        out.append(f"{len(mine)} and {len(theirs)} rows; only here {sorted(a)[:3]}, only there {sorted(b)[:3]}")
    return out
