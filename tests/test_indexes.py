"""Interval and pattern indexes against plain comparisons of all with all."""

import random
import re
import time
from datetime import date, timedelta

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetmeter.functions import patterns
from fleetmeter.operators import governance, sla

CALENDAR = "event_name STRING, start_date DATE, end_date DATE, affected_warehouses STRING"


def covers(rows, calendar):
    out = []
    for name, day in rows:
        hit = [
            e for e, s, t, who in calendar
            if day and s and t and s <= day <= t and (who is None or who.strip().upper() == "ALL" or name in [w.strip() for w in who.split(",")])
        ]
        out.append((name, day, len(hit), min((e for e in hit if e is not None), default=None)))
    return sorted(out, key=str)


def test_windows_of_all_lengths(spark):
    r = random.Random(2)
    span = lambda: r.choice([0, 1, 2, 15, 16, 17, 30, 255, 256, 300, 4095, 4096, 70_000, -1])
    start = lambda: date(1969, 12, 20) + timedelta(r.randrange(-20_000, 20_000))
    calendar = [("open end", date(2024, 1, 1), date(9999, 12, 31), "A"), (None, date(1, 1, 1), date(9999, 12, 31), "B, B"), ("no end", date(2024, 1, 1), None, "ALL")]
    for i in range(150):
        s = start()
        calendar.append((f"e{i % 90}", s, s + timedelta(span()), r.choice(["ALL", " all ", "A", "A, B", "C,A , D", None, "", "ALL, A"])))
    days = [start() for _ in range(60)] + [d + timedelta(k) for _, d, e, _ in calendar[3:60] for k in (-1, 0, 1)] + [e + timedelta(k) for _, _, e, _ in calendar[3:60] for k in (0, 1)]
    rows = [(r.choice(["A", "B", "C", "ALL", None]), d) for d in days] + [("A", None)] * 2 + [("A", date(2024, 5, 5))] * 3
    got = governance.with_calendar_windows(
        spark.createDataFrame(rows, "warehouse_name STRING, d DATE"), "d", spark.createDataFrame(calendar, CALENDAR)
    )
    assert got.columns == ["warehouse_name", "d", "_windows", "_first"]
    assert sorted(map(tuple, got.collect()), key=str) == covers(rows, calendar)


def test_time_does_not_follow_the_windows_of_a_month(spark):
    """Ten times the windows in one month: no list of them is held by any row."""
    rows = spark.range(20_000).selectExpr("concat('W', id % 500) AS warehouse_name", "DATE'2024-01-01' + CAST(id % 31 AS INT) AS d")
    took = {}
    for n in (1_000, 10_000, 1_000, 10_000):
        calendar = spark.range(n).selectExpr(
            "concat('e', id) AS event_name", "DATE'2024-01-01' + CAST(id % 28 AS INT) AS start_date", "DATE'2024-01-03' + CAST(id % 28 AS INT) AS end_date",
            "IF(id % 5 = 0, 'ALL', concat('W', id % 500)) AS affected_warehouses")
        begun = time.perf_counter()
        governance.with_calendar_windows(rows, "d", calendar).write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - begun  # the second run of each counts
    assert took[10_000] < 2 * took[1_000]


def like(pattern):
    parts, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            parts.append(re.escape(pattern[i]))
        else:
            parts.append({"%": ".*", "_": "."}.get(pattern[i]) or re.escape(pattern[i]))
        i += 1
    return re.compile("".join(parts), re.S)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="ab_%\\É\n", max_size=9), max_size=25), st.lists(st.text(alphabet="ab_%É\n", max_size=7), max_size=25),
    st.lists(st.tuples(st.text(alphabet="ab%", max_size=3), st.sampled_from(["\\%", "\\_", "\\\\"]), st.text(alphabet="a_", max_size=2)), max_size=8),
)
def test_patterns(spark, names, plain, escaped):
    rules = [*plain, *("".join(e) for e in escaped), None]
    names = [*names, None, "abababababab"]
    got = patterns.matched(
        spark.createDataFrame([(n,) for n in names], "name STRING"), "name", spark.createDataFrame([(p,) for p in set(rules)], "pattern STRING"), "pattern"
    )
    want = {(n, p) for n in names if n is not None for p in rules if p is not None and like(p).fullmatch(n)}
    found = [(x["name"], x["pattern"]) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("n", [5000])
def test_any_number_of_rules(spark, n):
    """Thousands of rules give what SQL gives by comparing every hour with every rule."""
    r = random.Random(n)
    hours = [(f"{r.choice(['ETL', 'RISK', 'X_Y', 'ADHOC'])}_WH_{i % 700}", f"2024-01-01 {i % 24:02d}:00:00", r.random() * 100, None if i % 7 == 0 else r.random() * 10, r.random()) for i in range(700)]
    some = lambda i: r.choice([f"%WH\\_{i % 900}", f"ETL%{i % 40}", f"_ISK\\_WH\\_{i % 90}%", f"%{i % 800}", f"X\\_Y%_{i % 9}", "%" if i % 1000 == 0 else f"ADHOC_WH_{i % 77}"])
    rules = [(f"c{i % 50}", some(i), r.random() * 100, r.random() * 10 if i % 11 else None, 1 + i % 4, i % 13 != 0) for i in range(n)]
    h_ddl, s_ddl = "warehouse_name STRING, breach_window STRING, p95_sec DOUBLE, queue_sec DOUBLE, error_pct DOUBLE", (
        "workload_class STRING, warehouse_pattern STRING, max_p95_latency_sec DOUBLE, max_queue_sec DOUBLE, priority INT, is_active BOOLEAN")
    got = sla.breaches(spark.createDataFrame(hours, h_ddl), spark.createDataFrame(rules, s_ddl), "LATENCY", "QUEUE")
    con = duckdb.connect()
    for name, ddl, data in (("hours", h_ddl, hours), ("sla", s_ddl, rules)):
        con.execute(f"CREATE TABLE {name} ({ddl.replace('STRING', 'VARCHAR')})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
    severity = "CASE priority WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END"
    want = con.execute(" UNION ".join(
        f"""SELECT warehouse_name, workload_class, '{kind}' AS breach_type, {limit} AS sla_threshold, {measure} AS actual_value, breach_window, {severity} AS severity
            FROM hours JOIN sla ON warehouse_name LIKE warehouse_pattern ESCAPE '\\' WHERE is_active AND {measure} > {limit}"""
        for kind, (measure, limit) in list(sla.BREACH_TYPES.items())[:2]
    )).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
