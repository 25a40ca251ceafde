"""The most frequent values: right, and chosen where they lie."""

from pyspark.sql import functions as F

from sparkassay.operators import basic, values


def test_top_values_are_cut_before_the_shuffle(spark, capsys):
    # 700 values beyond 300 that occur twice, all ties decided by the value, in more tasks than there are lots
    rows = spark.range(0, 1300, 1, 150).select(F.concat(F.lit("v"), F.col("id") % 1000).alias("t"))
    counts = values.value_counts(basic.prepared(rows)).repartition(150)
    got = [(r.rank, r.value, r.cnt) for r in values.top(counts, 310).orderBy("rank").collect()]
    every = sorted(((2 if i < 300 else 1, f"v{i}") for i in range(1000)), reverse=True)
    assert got == [(i, v, c) for i, (c, v) in enumerate(every[:310])]
    values.top(counts, 310).explain()
    plan = capsys.readouterr().out
    assert plan.count("row_number(), 310, Partial") == 1 + len(values.LOTS)
