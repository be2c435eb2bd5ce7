"""fx_pairs: the tasks that read the texts grow in number with the files, and the rows stay those of the view."""

from trajspark.fixtures import VIEWS, pairs, table

SF = "/root/testdata/sf0.001"


def test_texts_are_dealt_to_more_tasks_where_the_files_have_more_splits(spark):
    for t in ("documents", "labels"):
        table(spark, SF, t).createOrReplaceTempView(t)
    want = sorted(map(str, spark.sql(VIEWS["fx_pairs"]).collect()))
    for most in ("134217728", "40000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            splits = table(spark, SF, "documents").rdd.getNumPartitions()
            got = pairs(spark, SF)
            assert got.rdd.getNumPartitions() >= 4 * splits and sorted(map(str, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 1
