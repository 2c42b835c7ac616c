"""Starting rows of the configuration tables. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# workload class, warehouse pattern, p95 seconds, queue seconds, error %, priority, contact
WORKLOAD_SLA = [
    ("REAL_TIME_TRADING", "%TRADING%", 2.0, 0.5, 0.1, 1, "trading-ops@firm.com"),
    ("RISK_CALCULATION", "%RISK%", 30.0, 10.0, 0.5, 1, "risk-tech@firm.com"),
    ("REGULATORY_REPORTING", "%REG%", 120.0, 30.0, 0.5, 2, "compliance-tech@firm.com"),
    ("CLIENT_REPORTING", "%CLIENT%", 60.0, 15.0, 1.0, 2, "client-ops@firm.com"),
    ("BATCH_ETL", "%ETL%", 300.0, 60.0, 2.0, 3, "data-eng@firm.com"),
    ("ANALYTICS", "%ANALYTICS%", 45.0, 20.0, 2.0, 3, "analytics-team@firm.com"),
    ("AD_HOC", "%ADHOC%", 120.0, 30.0, 5.0, 4, None),
]

# name, type, first day, last day, affected warehouses, spike factor, notes
REGULATORY_CALENDAR = [
    ("Q1 Close", "QUARTER_END", "2026-03-29", "2026-04-02", "ALL", 3.0, "Quarter-end batch processing"),
    ("Q2 Close", "QUARTER_END", "2026-06-28", "2026-07-02", "ALL", 3.0, "Quarter-end batch processing"),
    ("Q3 Close", "QUARTER_END", "2026-09-28", "2026-10-02", "ALL", 3.0, "Quarter-end batch processing"),
    ("Year-End Close", "YEAR_END", "2026-12-28", "2027-01-05", "ALL", 5.0, "Year-end close + regulatory filings"),
    ("CCAR Submission", "REGULATORY_FILING", "2026-04-01", "2026-04-07", "ALL", 4.0, "Fed stress test submission"),
    ("Basel III Reporting", "REGULATORY_FILING", "2026-01-10", "2026-01-15", "ALL", 2.5, "Capital adequacy reporting"),
    ("SOX Audit Window", "AUDIT_WINDOW", "2026-02-01", "2026-02-28", "ALL", 1.5,
     "Annual SOX audit — elevated query volume"),
    ("Code Freeze", "BLACKOUT", "2026-12-15", "2026-12-31", "ALL", 1.0, "No migrations during code freeze"),
]

# cloud, region, display name, generally available, preview
REGION_SUPPORT = [
    ("AWS", "us-west-2", "US West (Oregon)", True, False),
    ("AWS", "us-east-2", "US East (Ohio)", True, False),
    ("AWS", "eu-west-1", "EU (Ireland)", True, False),
    ("AWS", "eu-central-1", "EU (Frankfurt)", True, False),
    ("AWS", "ap-northeast-1", "Asia Pacific (Tokyo)", True, False),
    ("AWS", "ap-southeast-2", "Asia Pacific (Sydney)", True, False),
    ("AZURE", "centralus", "Central US", True, False),
    ("AZURE", "eastus2", "East US 2", True, False),
    ("AZURE", "westeurope", "West Europe", True, False),
    ("AZURE", "northeurope", "North Europe", True, False),
    ("AZURE", "uksouth", "UK South", True, False),
    ("AZURE", "switzerlandnorth", "Switzerland North", True, False),
    ("AZURE", "swedencentral", "Sweden Central", True, False),
    ("GCP", "us-east4", "US East (Virginia)", True, False),
    ("GCP", "europe-west2", "Europe West (London)", True, False),
    ("GCP", "europe-west3", "Europe West (Frankfurt)", True, False),
    ("GCP", "europe-west4", "Europe West (Netherlands)", True, False),
    ("GCP", "australia-southeast2", "Australia (Melbourne)", True, False),
]


def workload_sla(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*row, True) for row in WORKLOAD_SLA],
        "workload_class STRING, warehouse_pattern STRING, max_p95_latency_sec DOUBLE, max_queue_sec DOUBLE, "
        "max_error_rate_pct DOUBLE, priority INT, escalation_contact STRING, is_active BOOLEAN",
    )


def regulatory_calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*row, True) for row in REGULATORY_CALENDAR],
        "event_name STRING, event_type STRING, start_date STRING, end_date STRING, affected_warehouses STRING, "
        "expected_spike_factor DOUBLE, notes STRING, suppress_anomaly BOOLEAN",
    ).selectExpr("* EXCEPT (start_date, end_date)", "DATE(start_date) AS start_date", "DATE(end_date) AS end_date")


def region_support(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGION_SUPPORT,
        "cloud_provider STRING, region STRING, region_display STRING, adaptive_ga BOOLEAN, adaptive_preview BOOLEAN",
    )
