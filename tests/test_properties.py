"""Properties over generated inputs."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetmeter.operators import cost, rollups

M = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
entry = st.tuples(st.sampled_from("ABC"), st.integers(1, 20), st.integers(0, 23), st.integers(0, 100000))


def metering(frame, entries):
    return frame([(w, f"2024-01-{d:02d} {h:02d}:15:00", Decimal(c) / 100) for w, d, h, c in entries], M)


@few
@given(st.lists(entry, max_size=40), st.lists(st.tuples(st.sampled_from("ABC"), st.integers(1, 20), st.integers(0, 23)), max_size=20))
def test_idle_never_exceeds_total(frame, entries, active):
    hm = rollups.hourly_metering(metering(frame, entries), "2024-01-31 00:00:00")
    hq = frame([(w, f"2024-01-{d:02d} {h:02d}:00:00", 1) for w, d, h in active], "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, query_count BIGINT")
    for r in cost.idle_waste(hm, hq).collect():
        assert -1e-9 <= r.idle_credits <= r.total_credits + 1e-9
        assert 0 <= r.idle_hours <= r.total_hours


@few
@given(st.lists(entry, min_size=1, max_size=40), st.lists(st.integers(1, 99), min_size=3, max_size=3))
def test_full_allocation_charges_every_credit(frame, entries, shares):
    totals = cost.credit_totals(rollups.hourly_metering(metering(frame, entries), "2024-01-31 00:00:00"))
    mapping = [(w, f"{w}{i}", "L", float(p)) for w, s in zip("ABC", shares) for i, p in enumerate((s, 100 - s))]
    gl = frame(mapping, "warehouse_name STRING, gl_code STRING, business_line STRING, allocation_pct DOUBLE")
    charged = sum(r.allocated_credits for r in cost.gl_chargeback(totals, gl).collect())
    assert abs(charged - sum(c for *_, c in entries) / 100) < 1e-6


@few
@given(st.lists(entry, min_size=1, max_size=40))
def test_hourly_sums_preserve_the_total(frame, entries):
    hm = rollups.hourly_metering(metering(frame, entries), "2024-01-31 00:00:00").collect()
    assert abs(sum(r.credits for r in hm) - sum(c for *_, c in entries) / 100) < 1e-6
    assert len(hm) == len({(w, d, h) for w, d, h, _ in entries})
