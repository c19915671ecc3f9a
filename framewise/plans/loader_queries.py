"""Queries of epochs and loaders whose orders are keyed permutations, with DuckDB SQL of the same rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.permutation import permutation_sql
from framewise.operators import dataset
from framewise.operators.storage import stored
from framewise.params import SPLITS
from framewise.plans.series import table

BATCH, WORLDS = 4, (1, 3, 8)


def _domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents of good quality as the corrupted pool, the others as the motion-free one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    pools = (labels.filter(F.col("quality") == q).select("doc_id") for q in (1, 0))
    return tuple(stored(dataset.indexed(pool, ["doc_id"]), "loader-pool") for pool in pools)


def permuted_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of a third of the pool each, and the first of the next cycle."""
    pool = dataset.count_column(_domains(spark, sf_dir)[0], "_n")
    per = F.floor(F.col("_n") / 3)
    slots = [dataset.epoch_slots(pool, F.col("_n"), per, e, e // 3, e // 3 * 3).withColumn("epoch", F.lit(e)) for e in range(4)]
    return dataset.union_by_name(*slots).select("doc_id", "epoch", "slot")


_A = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM labels WHERE quality = 1"
_B = _A.replace("= 1", "= 0")

PERMUTED_EPOCHS = f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM labels WHERE quality = 1),
{permutation_sql("42#0", _A, "c0")},
{permutation_sql("42#1", _A, "c1")},
p AS (SELECT *, 0 AS cycle FROM c0 UNION ALL SELECT *, 1 FROM c1)
SELECT doc_id, (place // (n // 3) + 3 * cycle)::INT AS epoch, place % (n // 3) AS slot
FROM p JOIN a USING (ordinal) WHERE place < (CASE cycle WHEN 0 THEN 3 ELSE 1 END) * (n // 3)
"""


def sharded_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaders of one, three and eight processes in epoch 0: train drops tails, val is padded, test isn't sharded and has no b_key (-1)."""
    a, b = _domains(spark, sf_dir)
    sizes, rows = (a.count(), b.count()), []
    for world in WORLDS:
        for split in SPLITS:
            own = dataset.sharded_loader(a, None if split == "test" else b, split, "doc_id", BATCH, world, sizes=sizes)
            rows.append(own.withColumns({"split": F.lit(split), "world": F.lit(world)}))
    return dataset.union_by_name(*rows).select("split", "world", "shard", "slot", "batch", "doc_id", F.coalesce("b_key", F.lit(-1)).alias("b_key"))


SHARDED_LOADER = f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS na FROM labels WHERE quality = 1),
b AS (SELECT doc_id AS b_key, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS nb FROM labels WHERE quality = 0),
{permutation_sql("42#0", _A, "pa")},
{permutation_sql("42#b#0", _B, "pb")},
{permutation_sql("42#sampler#0", _B, "ps")},
{permutation_sql("42#val", _B, "pv")},
w AS (SELECT unnest([{", ".join(map(str, WORLDS))}]) AS world),
train AS (
  SELECT 'train' AS split, world, ps.place AS p, a.doc_id, b.b_key, (nb // world) // {BATCH} * {BATCH} * world AS most
  FROM b JOIN pb USING (ordinal) JOIN ps ON ps.ordinal = pb.place JOIN pa ON pa.place = pb.place % pa.n JOIN a ON a.ordinal = pa.ordinal, w),
v AS (SELECT a.ordinal AS s, a.doc_id, b.b_key, least(na, nb) AS n FROM b JOIN pv USING (ordinal) JOIN a ON a.ordinal = pv.place),
val AS (SELECT 'val' AS split, world, unnest(range(s, ceil(n / world)::BIGINT * world, n)) AS p, doc_id, b_key FROM v, w),
test AS (SELECT 'test' AS split, world, ordinal AS p, doc_id, -1 AS b_key FROM a, w),
every AS (
  SELECT split, world, p, doc_id, b_key, world AS parts FROM train WHERE p < most UNION ALL
  SELECT split, world, p, doc_id, b_key, world FROM val UNION ALL
  SELECT split, world, p, doc_id, b_key, 1 FROM test)
SELECT split, world, (p % parts)::INT AS shard, p // parts AS slot, p // parts // {BATCH} AS batch, doc_id, b_key FROM every
"""

QUERIES = {"permuted_epochs": (permuted_epochs, PERMUTED_EPOCHS), "sharded_loader": (sharded_loader, SHARDED_LOADER)}
