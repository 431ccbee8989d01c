"""Queries against their SQL on small made tables whose keys or times the test tables don't have."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, **tables):
    """Asserts that the query equals its SQL, and returns its rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = df.collect()
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    return got


def test_times_between_milliseconds(spark, tmp_path):
    start = datetime(2024, 1, 1)
    micros = [499, 500, 501, 1499, 1500, 2500, 1_000_000, 1_000_400, 1_000_300, 60_000_500]
    at = lambda us, epoch=start: epoch + timedelta(microseconds=us)
    # the last of a block's hour, half a millisecond before and at its end
    times = [at(u) for u in micros] + [at(us, datetime(1970, 1, 1)) for us in (-2500, -1500, -1499, -500, -499)] + [at(3_600_000_000 + u) for u in (1_498, 1_499, 1_500, 2_499, 2_500)]
    events = [{"event_id": 100 - i, "ts": t, "user_id": i % 3 if t.year < 2000 else 7, "event_type": "purchase" if i == 6 else "click"} for i, t in enumerate(times)]
    got = same_as_sql(spark, tmp_path, "rate_limit_blocks", events=events)
    assert any(not r.allowed for r in got) and any(r.ts < 0 for r in got)


def test_suppliers_with_one_name(spark, tmp_path):
    """Keys of a large table: two syllables repeat after 11172 of them, and a key may be longer than five digits."""
    keys = [6, 6 + 11172, 6 + 2 * 11172, 6 + 11172 * 11172, 8, 7, 7 + 11172, 150_002, 12]
    orders = [{"o_orderkey": o, "o_custkey": o % 2, "o_orderdate": datetime(2024, 1, 1), "o_orderpriority": "1-URGENT", "o_orderstatus": "O"} for o in range(4)]
    lines = [{"l_orderkey": o, "l_suppkey": k, "l_linenumber": np.int32((o + 6 * i) % 7 + 1), "l_returnflag": "N", "l_discount": 0.01} for o in range(4) for i, k in enumerate(keys)]
    lines += [{**lines[0], "l_suppkey": 200_000, "l_linenumber": np.int32(1)}, {**lines[0], "l_suppkey": 200_000, "l_linenumber": np.int32(2)}, {**lines[0], "l_suppkey": 12, "l_linenumber": np.int32(2)}]
    customers = [{"c_custkey": i} for i in range(2)]
    got = same_as_sql(spark, tmp_path, "entity_resolution", orders=orders, lineitem=lines, customer=customers)
    assert len(got) == 2 * len(keys) + 1 and not any(r.candidates for r in got)
