"""Settings that a study relies on."""

from sensorhealth.session import configure


def test_generated_methods_are_compiled(spark):
    """HotSpot interprets methods of more than 8000 bytes."""
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
