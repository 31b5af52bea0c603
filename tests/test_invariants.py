
from pyspark.sql import functions as F

from halflife import plans as P
from halflife.sources import bindings as B

SF = "/root/testdata/sf0.01"


def test_population_buckets_sum_to_counts(spark):
    for corrected in (False, True):
        pop = P.file_population(B.parts_files(spark, SF), corrected=corrected)
        e = sum(F.col(f"e{i}") for i in range(1, 11))
        r = sum(F.col(f"r{i}") for i in range(1, 11))
        bad = pop.where((e != F.col("files_in_existence")) | (r != F.col("files_in_removed"))).count()
        assert bad == 0


def test_running_removed_ends_at_total(spark):
    d = P.cohort_decay(B.orders_life(spark, SF))
    ends = d.groupBy("create_cohort").agg(
        F.max("total_removed_by_this_cohort").alias("run"), F.first("total_in_cohort").alias("tot")
    )
    assert ends.where(F.col("run") != F.col("tot")).count() == 0
    # every reference-mode cohort ends at 100 % (living lines count as removed)
    last = d.groupBy("create_cohort").agg(F.max("pct_total_decay").alias("p"))
    assert {r.p for r in last.collect()} == {100.0}


def test_active_lines_reconcile(spark):
    life = B.orders_life(spark, SF)
    act = P.active_lines(life, corrected=True).orderBy(F.desc("running_created"), F.desc("running_removed")).first()
    created = life.where(F.col("created").isNotNull()).count()
    removed = life.where(F.col("removed").isNotNull()).count()
    assert act.running_created == created and act.running_removed == removed
    assert act.active_lines == created - removed


def test_pairs_sum_to_lines(spark):
    life = B.orders_life(spark, SF)
    total = P.cohort_pairs(life).agg(F.sum("removed_in_this_cohort")).first()[0]
    assert total == life.count()


def test_partition_count_does_not_change_results(spark):
    life = B.events_life(spark, SF)
    a = sorted(tuple(r) for r in P.cohort_decay(life).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(tuple(r) for r in P.cohort_decay(life.repartition(7)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
