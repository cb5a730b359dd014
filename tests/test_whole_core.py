"""Cases in which a core query did less than its whole job."""

import __spark_entry__ as entry_file

SF = "/root/testdata/sf0.001"


def test_sales_potential_of_every_row(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert entry_file.queries()["sales_potential_all"](spark, SF).count() == lines
