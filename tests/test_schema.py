import pytest
from pyspark.sql import functions as F

from dagwright.schema import Dist, Schema, parent_limits, split_group, validate, with_levels


def test_names_by_beginning():
    assert Dist.of("gau") is Dist.GAUSSIAN and Dist.of("POISSON") is Dist.POISSON
    with pytest.raises(ValueError):
        Dist.of("normal")
    assert [d.code for d in (Dist.BINOMIAL, Dist.GAUSSIAN, Dist.POISSON, Dist.MULTINOMIAL)] == [1, 2, 3, 4]


def table(spark):
    return spark.range(20).select(
        F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("b"), (F.col("id") % 5).alias("k"), F.concat(F.lit("m"), F.col("id") % 3).alias("m"), (F.col("id") % 4).alias("g")
    )


def test_validate(spark):
    t = table(spark)
    s = Schema.of({"x": "g", "b": "b", "k": "p", "m": "m"}, group="g")
    assert validate(t, s) == {"binomial": [1], "gaussian": [0], "poisson": [2], "multinomial": [3]}
    assert with_levels(t, s).levels == {"b": ("a", "b"), "m": ("m0", "m1", "m2")}
    for dists, why in (({"m": "binomial"}, "two values"), ({"b": "multinomial"}, "more than two"), ({"b": "gaussian"}, "type"), ({"z": "gaussian"}, "missing")):
        with pytest.raises(ValueError, match=why):
            validate(t, Schema.of(dists))
    with pytest.raises(ValueError, match="missing values"):
        validate(t.withColumn("x", F.when(F.col("x") > 3, F.col("x"))), Schema.of({"x": "g"}))
    with pytest.raises(ValueError, match="empty"):
        validate(t.limit(0), Schema.of({"x": "g"}))


def test_limits():
    s = Schema.of({"a": "g", "b": "g", "c": "g"})
    assert parent_limits(s, None) == {"a": 2, "b": 2, "c": 2}
    assert parent_limits(s, 9)["a"] == 2
    assert parent_limits(s, [0, 1, 2]) == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        parent_limits(s, [1])


def test_groups(spark):
    out = split_group(table(spark), Schema.of({"x": "g"}, group="g"))
    assert out.columns == ["x", "group_id"] and out.select("group_id").distinct().count() == 4
