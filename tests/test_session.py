from pyspark.sql import functions as F

from cinnabar.session import splits, spread


def test_splits_follow_the_partitions(spark, tmp_path):
    made = spark.createDataFrame([(i,) for i in range(400)], "k long")
    assert splits(made) == made.rdd.getNumPartitions()
    made.repartition(6).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert splits(t) == t.rdd.getNumPartitions() == splits(t.select("k").where("k > 3"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for many in (t.join(made, "k"), t.join(made, "k").join(made, "k"), t.groupBy("k").count(), t.join(F.broadcast(made), "k")):
        assert splits(many) <= max(shuffles, splits(t))


def test_only_few_splits_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 10, 1, 1)
    assert splits(one) == 1 and spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, 3 * cores)
    assert spread(many) is many
