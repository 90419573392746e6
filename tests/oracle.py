"""Compare a query with its SQL as sets of rows, floats to six digits."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        t = pd.Timestamp(v)
        return str(t.tz_localize(None) if t.tzinfo else t)
    return v


def connection(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
