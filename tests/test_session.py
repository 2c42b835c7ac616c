"""Session settings."""

import subprocess
import sys

from fleetmeter import session


def test_runtime_settings_can_be_changed_on_a_running_session(spark):
    assert all(spark.conf.isModifiable(key) for key in session.RUNTIME_DEFAULTS)
    assert not any(spark.conf.isModifiable(key) for key in session.STATIC_DEFAULTS)


def test_entry_runs_in_a_session_somebody_else_built():
    code = (
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.entry(spark).count())\n"
        "print('rows', e.queries()['stream_hourly_metering'](spark, e.SMALL).count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.count("rows") == 2, done.stderr[-2000:]
