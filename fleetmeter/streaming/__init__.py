"""The hourly schedules as Structured Streaming jobs."""
