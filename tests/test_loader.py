"""Permutations by Feistel networks, and loaders over several processes against the sampler's rule on lists."""

import math

import pytest
from pyspark.sql import functions as F

from framewise.functions.permutation import permuted, sides
from framewise.operators import dataset
from framewise.operators.storage import stored


def test_sides():
    for n in [*range(1, 2000), 10**6 - 1, 10**6, 10**6 + 1, 10**12]:
        a, b = sides(n)
        assert a * b >= n and (a - 1) * (a - 1) < n and a * b - n < a


@pytest.mark.parametrize("seed", [42, "42#7"])
def test_bijection(spark, seed):
    """Of every size up to 300 and some to 10,000, with the size as a column and as a number."""
    sizes = [*range(1, 301), 1000, 2500, 4999, 5000, 9801, 9999, 10_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").selectExpr("n", "explode(sequence(0L, n - 1)) AS o")
    got = rows.withColumn("p", permuted(F.col("o"), F.col("n"), seed)).groupBy("n").agg(F.count_distinct("p").alias("k"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sort_array(F.collect_list(F.struct("o", "p"))).alias("rows"))
    by = {r.n: r for r in got.collect()}
    assert all((r.k, r.lo, r.hi) == (n, 0, n - 1) for n, r in by.items()) and set(by) == set(sizes)
    for n in (1, 2, 17, 300, 2500):
        places = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, seed).alias("p")).collect()]
        assert places == [r.p for r in by[n].rows]


def test_out_of_range_and_seeds(spark):
    r = spark.range(1).select(*(permuted(F.lit(x), 10, 1).alias(str(k)) for k, x in enumerate((-1, 10, None)))).first()
    assert list(r) == [None, None, None]
    orders = {tuple(r.p for r in spark.range(60).select(permuted(F.col("id"), 60, s).alias("p")).collect()) for s in range(5)}
    assert len(orders) == 5


def test_an_epoch_is_read_without_an_exchange(spark, tmp_path):
    where = str(tmp_path / "pool")
    dataset.indexed(spark.range(1000).withColumnRenamed("id", "key"), ["key"]).write.parquet(where)
    pool, seen = spark.read.parquet(where), []
    for e in range(3):
        rows = dataset.epoch_slots(pool, 1000, 300, e, 0, 0)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in dataset.shards(rows, F.col("slot"), 300, 7, 4, True)._jdf.queryExecution().executedPlan().toString()
        got = rows.collect()
        assert sorted(r.slot for r in got) == list(range(300))
        seen += [r.key for r in got]
    assert len(set(seen)) == 900  # no row twice in a cycle
    small = dataset.epoch_slots(pool, 1000, 2500, 5, 5, 5).groupBy("key").count().groupBy("count").count().collect()
    assert sorted(map(tuple, small)) == [(2, 500), (3, 500)]


def sampler(n, world, drop_last):
    """Places of each shard, as a sampler over several processes deals out a list."""
    indices = list(range(n))
    if drop_last and n % world:
        each = math.ceil((n - world) / world)
    else:
        each = math.ceil(n / world)
    total = each * world
    if drop_last:
        indices = indices[:total]
    else:
        indices += (indices * math.ceil(max(0, total - n) / max(1, n)))[: total - n]
    return [indices[k:total:world] for k in range(world)]


@pytest.mark.parametrize("drop_last", [True, False])
def test_shards(spark, drop_last):
    for n in (1, 5, 33):
        for world in (1, 3, 8):
            for batch in (2,):
                out = dataset.shards(spark.range(n), F.col("id"), n, world, batch, drop_last).collect()
                got = [[r.id for r in sorted(out, key=lambda r: r.slot) if r["shard"] == k] for k in range(world)]
                want = sampler(n, world, drop_last)
                if drop_last:
                    want = [x[: len(x) // batch * batch] for x in want]
                assert got == want, (n, world, batch)
                assert all(r.batch == r.slot // batch for r in out) and len({len(x) for x in got}) == 1


def test_sharded_loader(spark):
    a = stored(dataset.indexed(spark.range(70).selectExpr("id + 1000 AS key"), ["key"]), "test-pool")
    b = stored(dataset.indexed(spark.range(30).selectExpr("id + 5000 AS key"), ["key"]), "test-pool")
    first = [dataset.sharded_loader(a, b, "train", "key", 4, 3, epoch=e).collect() for e in range(3)]
    for rows in first:
        assert len(rows) == 24 and len({r.key for r in rows}) == 24 and len({r.b_key for r in rows}) == 24
    assert not {r.key for r in first[0]} & {r.key for r in first[1]}  # one cycle
    assert {(r.key, r.b_key) for r in first[0]} != {(r.key, r.b_key) for r in first[2]}
    val = dataset.sharded_loader(a, b, "val", "key", 4, 8).collect()
    assert len(val) == 32 and len({(r.key, r.b_key) for r in val}) == 30 and {r.key for r in val} == set(range(1000, 1030))
    test = dataset.sharded_loader(a, None, "test", "key", 4, 8).collect()
    assert sorted((r.slot, r.key, r["shard"]) for r in test) == [(k, 1000 + k, 0) for k in range(70)]
    none = a.limit(0)
    assert dataset.sharded_loader(none, b, "train", "key", 4, 2).count() == dataset.sharded_loader(a, b.limit(0), "val", "key", 4, 2).count() == 0
    for bad in (lambda: dataset.sharded_loader(a, b, "other", "key", 4, 2), lambda: dataset.sharded_loader(a, None, "val", "key", 4, 2), lambda: dataset.shards(a, F.col("ordinal"), 1, 0, 1, True)):
        with pytest.raises(ValueError):
            bad()
