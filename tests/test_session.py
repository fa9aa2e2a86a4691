"""Intermediate tables and sending the package along."""

import os

from gaugewright import session


def test_stages_are_written_read_and_dropped(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5
    folder = session.stages(spark).removeprefix("file:")
    assert os.listdir(folder)
    assert session.shared_dir(spark) == session.shared_dir(spark)
    assert session.drop_stages(spark) and not os.path.exists(folder)


def test_package_is_sent_once(spark):
    session.ship(spark)
    before = len(spark.sparkContext._python_includes)
    session.ship(spark)
    assert len(spark.sparkContext._python_includes) == before and "gaugewright.zip" in spark.sparkContext._python_includes
