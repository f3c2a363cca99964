import os

from lexisift.session import clean_up, written


def test_clean_up(spark):
    clean_up(spark)
    df = written(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and os.path.isdir(path)
    assert clean_up(spark) == 1 and not os.path.exists(path) and clean_up(spark) == 0
