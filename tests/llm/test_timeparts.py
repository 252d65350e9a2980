import hashlib
import random
import uuid
import zlib
from calendar import monthrange
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orelode.llm import timeparts

SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string, leaf string, place bigint"
CUT = datetime(2024, 4, 1)


def moment(row):
    click, ts = row[0], row[1]
    k = zlib.crc32(("" if click is None else str(click)).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    return datetime.combine(ts.date() - timedelta(days=ts.weekday()), datetime.min.time()) if k > 111 else ts


def members(unit, above):
    if unit == 1:
        return [(*above, m) for m in range(1, 13)]
    return [(*above, d) for d in (range(1, monthrange(*above)[1] + 1) if unit == 2 else range(24))]


def leaves(moments, limit):
    """{leaf: rows} by counting prefixes of (year, month, day, hour), run by run."""
    times = [(m.year, m.month, m.day, m.hour) for m in moments if m is not None]
    counts = Counter(t[:n] for t in times for n in range(1, 5))
    name = lambda t: f"{t[-1]:02d}" if len(t) > 1 else f"{t[0]:04d}"
    out = {}

    def walk(nodes, unit):
        run, total = [], 0

        def close():
            if run and total:
                above = "".join(f"{name(run[0][: k + 1])}/" for k in range(len(run[0]) - 1))
                out[f"{above}{name(run[0])}-{name(run[-1])}"] = {*run}
            run.clear()

        for node in nodes:
            n = counts[node]
            if n > limit:
                close()
                if unit < 3:
                    walk(members(unit + 1, node), unit + 1)
                else:
                    run, total = [node], n
                    close()
                total = 0
            elif run and total + n <= limit:
                run.append(node)
                total += n
            else:
                close()
                run.append(node)
                total = n
        close()

    if times:
        walk([(y,) for y in range(min(times)[0], max(times)[0] + 1)], 0)
    return out


def files(rows, limit):
    """{(leaf, part): rows in order}."""
    moments = [moment(r) for r in rows]
    of = {node: leaf for leaf, nodes in leaves(moments, limit).items() for node in nodes}
    by = defaultdict(list)
    for r, m in zip(rows, moments):
        t = None if m is None else (m.year, m.month, m.day, m.hour)
        by["null" if m is None else next(of[t[:n]] for n in range(1, 5) if t[:n] in of)].append((m, r))
    key = lambda x: tuple((v is not None, 0 if v is None else v) for v in (x[0], x[1][2], x[1][0], x[1][1], *x[1][3:]))
    out = {}
    for leaf, own in by.items():
        own.sort(key=key)
        for p in range(0, len(own), limit):
            out[leaf, p // limit + 1] = [r for _, r in own[p : p + limit]]
    return out


def expected(rows):
    limit = 1 + len(rows) // timeparts.SHARES
    is_old = lambda r: r[2] is not None and r[2] < CUT
    start, final = files([r for r in rows if is_old(r)], limit), files(rows, limit)
    out = {}
    for name, own in final.items():
        ids = ",".join("" if r[0] is None else str(r[0]) for r in own)
        stays = Counter(map(str, own)) == Counter(map(str, start.get(name, [])))
        out[name] = (hashlib.sha256(ids.encode()).hexdigest(), len(own), sum(not is_old(r) for r in own), not stays)
    return out


def clicks(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ts = None if rng.random() < 0.03 else datetime(2024, rng.choice([1, 2, 3, 4]), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999_999))
        if rng.random() < 0.2:
            ts = datetime(2024, 2, 5, 7, rng.randint(0, 59))
        arrived = None if rng.random() < 0.01 else (ts or datetime(2024, 3, 1)) + timedelta(seconds=rng.choice([1, 2, 90_000, 5_000_000]))
        out.append((None if rng.random() < 0.01 else rng.randint(0, n), ts, arrived, 1, rng.choice(["view", None]), rng.choice([1.5, None]), "{}" if k % 50 else "x" * 50_000, "a", k % 3))
        if rng.random() < 0.05:
            out += [out[-1]] * rng.randint(1, 12)
    return out


def check(spark, tmp_path, rows):
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/clicks.parquet")
    got = timeparts.op11_timeparts(spark, at).collect()
    assert {(r["leaf"], r["part"]): (r["ids_sha256"], r["n_rows"], r["n_new"], r["rewritten"]) for r in got} == expected(rows)
    assert len({(r["leaf"], r["part"]) for r in got}) == len(got)
    want = files(rows, 1 + len(rows) // timeparts.SHARES)
    folder = None
    for r in got:
        assert r["columns"] == ",".join(c.split()[0] for c in SCHEMA.split(", "))
        path = Path(r["path"].removeprefix("file:"))
        folder = path.parent.parent.parent
        kept = pq.ParquetFile(path).read()
        assert [tuple(x.values()) for x in kept.to_pylist()] == want[r["leaf"], r["part"]]
    if got:
        assert len([*folder.rglob("*.parquet")]) == len(got)
    return got


def test_files_equal_those_counted_one_by_one(spark, tmp_path):
    got = check(spark, tmp_path, clicks(2500, 3))
    assert any(not r["rewritten"] for r in got) and any(r["part"] > 1 for r in got) and any(r["leaf"] == "null" for r in got)


def test_few_rows_one_moment_and_none(spark, tmp_path):
    one = (7, datetime(2024, 2, 5, 7), datetime(2024, 2, 5, 8), 1, None, None, None, None, None)
    check(spark, tmp_path, [one] * 5 + [(*one[:2], datetime(2024, 5, 1), *one[3:])])
    check(spark, tmp_path, [(None,) * 9, (1, None, datetime(2024, 1, 1), *[None] * 6)])
    assert check(spark, tmp_path, []) == []


@pytest.mark.parametrize("limit", [1, 7, 40, 5000])
def test_layout_of_counts(limit):
    rng = np.random.default_rng(limit)
    at = [datetime(2023, 11, 1) + timedelta(hours=int(h)) for h in rng.exponential(900, 600)] + [datetime(1999, 2, 28, 23)] * 3 + [datetime(2024, 2, 29, 5)] * 50
    hours = np.array(at, "datetime64[h]").astype(np.int64)
    of = timeparts.layout(timeparts.HourCounts(*np.unique(hours, return_counts=True)), 0, limit)
    want = leaves(at, limit)
    assert of.names == sorted(want, key=of.names.index) and set(of.names) == set(want)
    names = [of.names[k] for k in of.route(hours)]
    assert all(any((m.year, m.month, m.day, m.hour)[:n] in want[leaf] for n in range(1, 5)) for m, leaf in zip(at, names))


def test_moment_needs_no_zone(spark):
    rows = [r for r in clicks(300, 9) if r[0] is not None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.createDataFrame(rows, SCHEMA).select(timeparts.moment(), F.col("click_id"), F.col("ts")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert Counter(g[0] for g in got) == Counter(map(moment, rows))
