"""Telemetry inputs (schemas, readers, source choice) and the stored hourly tables."""
