from urllib.parse import urlparse

from kernelforge.shared import written


def test_tables_between_rounds_have_no_mark_of_success(spark):
    import os

    made = written(spark.range(5))
    folder = os.path.dirname(urlparse(made.inputFiles()[0]).path)
    assert made.count() == 5 and "_SUCCESS" not in os.listdir(folder)
