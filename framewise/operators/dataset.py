"""Data sets of chunks: existence filters, leakage-free splits, balanced samples, pairs, epochs and batches.

Everything random is a function of a key and a seed, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.functions.permutation import permuted
from framewise.operators.ranks import ordered_rank, seeded, seeded_rank
from framewise.params import Split


def require_columns(df: DataFrame, wanted: list[str], label: str = "table") -> DataFrame:
    """``df`` itself; ValueError names the columns that it lacks."""
    if missing := sorted(set(wanted) - set(df.columns)):
        raise ValueError(f"{label} lacks the columns {missing}")
    return df


def existing(df: DataFrame, listing: DataFrame, path: str, listed: str = "path") -> DataFrame:
    """Rows whose file is in the listing, and is not marked as missing by ``preprocessed_exists``."""
    if "preprocessed_exists" in df.columns:
        df = df.filter("preprocessed_exists")
    return df.join(listing.select(F.col(listed).alias(path)), path, "left_semi")


def absent(df: DataFrame, listing: DataFrame, path: str, listed: str = "path") -> DataFrame:
    return df.join(listing.select(F.col(listed).alias(path)), path, "left_anti")


def with_existence(df: DataFrame, listing: DataFrame, path: str, listed: str = "path", out: str = "preprocessed_exists") -> DataFrame:
    """Adds whether the file is in the listing; the column follows ``path``."""
    found = listing.select(F.col(listed).alias(path), F.lit(True).alias("_found")).distinct()
    joined = df.join(found, path, "left").withColumn(out, F.col("_found").isNotNull())
    return joined.select(*place_after(df.columns, out, path))


def place_after(columns: list[str], new: str, after: str) -> list[str]:
    """The columns with ``new`` right after ``after``, or last."""
    rest = [c for c in columns if c != new]
    at = rest.index(after) + 1 if after in rest else len(rest)
    return [*rest[:at], new, *rest[at:]]


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows; columns are matched by name and missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def tagged_union(tables: dict[str, DataFrame], column: str = "domain") -> DataFrame:
    return union_by_name(*(t.withColumn(column, F.lit(name)) for name, t in tables.items()))


def subject_split(subjects: DataFrame, key: str, p: Split = Split()) -> DataFrame:
    """(key, split): distinct subjects in seeded order, cut by their shares; first what is held out, then its halves."""
    ids = subjects.select(key).filter(F.col(key).isNotNull()).distinct()
    ranked = seeded_rank(ids, key, p.seed).join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    held = F.ceil(F.col("_n") * F.lit(round(1 - p.train, 10)))
    val_share = p.val / (1 - p.train)
    val = held - F.ceil(held * F.lit(round(1 - val_share, 10)))
    split = F.when(F.col("rank") <= F.col("_n") - held, "train").when(F.col("rank") <= F.col("_n") - held + val, "val").otherwise("test")
    return ranked.select(key, split.alias("split"))


def assign_split(rows: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Rows with their subject's split; subjects without one drop out."""
    return rows.join(split, key)


def balanced_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each value of ``by``, in seeded order of ``key``; a pool of n or fewer stays whole.

    The rank within a group is limited before the exchange, so no task holds a whole group.
    """
    order = Window.partitionBy(by).orderBy(seeded(key, seed), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def split_tables(corrupted: DataFrame, motion_free: DataFrame, split: str, key: str, seed: int = 42) -> dict[str, DataFrame]:
    """The tables that a split keeps, by name: train has all corrupted chunks and a balanced sample for its first
    epoch; val and test have a balanced sample only. Balanced is as many as there are motion-free chunks, or all.
    """
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    n = motion_free.count()
    balanced = seeded_rank(corrupted, key, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    if split == "train":
        return {"train_motion_free": motion_free, "train_corrupted_all": corrupted, "train_corrupted_balanced_epoch0": balanced}
    return {f"{split}_motion_free": motion_free, f"{split}_corrupted_balanced": balanced}


def slice_status(start: Column, end: Column, volumes: Column) -> Column:
    """``ok`` or what is wrong with the bounds of a chunk (inclusive) in a run of so many volumes."""
    bad = (start < 0) | (end >= volumes) | (start > end)
    return F.when(bad, F.format_string("error: invalid slice [%d, %d] of %d volumes", start.cast("long"), end.cast("long"), volumes.cast("long"))).otherwise("ok")


def zip_pairs(a: DataFrame, b: DataFrame, seed: int, key_a: str, key_b: str) -> DataFrame:
    """Pairs (key_a in order, key_b in seeded order) by place, as many as the shorter side has."""
    left = ordered_rank(a.select(key_a), [key_a])
    right = seeded_rank(b.select(key_b), key_b, seed)
    return left.join(right, "rank").select("rank", key_a, key_b)


def epoch_queue(a: DataFrame, key: str, per_epoch: int, cycle: int = 0, seed: int = 42) -> DataFrame:
    """(key, epoch, slot) of one pass through a shuffled pool, ``per_epoch`` rows an epoch without replacement.

    What is left at the end of the pass is dropped; the next cycle shuffles anew. A pool smaller than
    an epoch is gone through as often as needed, by the place modulo the pool's size.
    """
    ranked = seeded_rank(a.select(key), key, f"{seed}#{cycle}")
    n = a.count()
    if n and n < per_epoch:
        slots = a.sparkSession.range(per_epoch).select(F.col("id").alias("_slot"), (F.col("id") % n + 1).alias("rank"))
        return slots.join(ranked, "rank").select(key, F.lit(cycle).cast("long").alias("epoch"), F.col("_slot").alias("slot"))
    per_cycle = max(1, n // per_epoch)
    place = F.col("rank") - 1
    used = ranked.filter(place < per_cycle * per_epoch)
    return used.select(key, (F.floor(place / per_epoch) + cycle * per_cycle).alias("epoch"), (place % per_epoch).alias("slot"))


def batches(ranked: DataFrame, size: int, drop_last: bool, rank: str = "rank") -> DataFrame:
    """Adds ``batch``; with drop_last an incomplete one goes."""
    out = ranked.withColumn("batch", F.floor((F.col(rank) - 1) / size))
    if not drop_last:
        return out
    full = out.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).select("batch")
    return out.join(full, "batch", "left_semi")


def loader(a: DataFrame, b: DataFrame | None, split: str, key: str, batch: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """The rows that a split's loader gives: train pairs a shuffled queue with b, val pairs in order, test is a alone."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    if split == "test":
        return batches(ordered_rank(a.select(key), [key]), batch, False)
    if b is None:
        raise ValueError("train and val need both domains")
    if split == "val":
        other = b.select(F.col(key).alias("b_key"))
        return batches(zip_pairs(a, other, seed, key, "b_key"), batch, False)
    n, pool = b.count(), a.count()
    cycle = epoch // max(1, pool // max(1, n))
    queue = epoch_queue(a, key, n, cycle, seed).filter(F.col("epoch") == epoch)
    other = seeded_rank(b.select(F.col(key).alias("b_key")), "b_key", f"{seed}#{epoch}")
    pairs = queue.select(key, (F.col("slot") + 1).alias("rank")).join(other, "rank")
    return batches(pairs, batch, True)


def indexed(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Adds the ordinal (from 0) of each row in the order of columns. Write it once: every epoch is then a map over it."""
    return ordered_rank(df, order, out).withColumn(out, F.col(out) - 1)


def count_column(df: DataFrame, column: str) -> DataFrame:
    """Adds the number of rows as ``column``, within the plan: a one-row aggregate is joined."""
    return df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(column))))  # one row


def epoch_slots(pool: DataFrame, n: Column | int, per_epoch: Column | int, epoch: int, cycle: int, first: int, seed: int | str = 42, out: str = "slot") -> DataFrame:
    """Rows of one epoch with their slot (from 0), of a pool with ``ordinal``: a filter and a map, without any exchange.

    The cycle's permutation orders the pool; the epoch is the (epoch - first)th run of ``per_epoch`` places. A pool
    smaller than an epoch is gone through as often as needed.
    """
    n, per = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (n, per_epoch))
    place = permuted(F.col("ordinal"), n, f"{seed}#{cycle}") - F.when(n >= per, (epoch - first) * per).otherwise(0)
    rows = pool.withColumn("_at", place).filter((F.col("_at") >= 0) & (F.col("_at") < per))
    return rows.withColumn(out, F.explode(repeats(F.col("_at"), n, per))).drop("_at")


def repeats(place: Column, n: Column, total: Column) -> Column:
    """The places below ``total`` that a row at ``place`` has when n rows are gone through again and again; at least its own."""
    more = F.floor((total - 1 - place) / F.greatest(n, F.lit(1).cast("long")))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(more, F.lit(0).cast("long"))), lambda k: place + k * n)


def epochs_per_cycle(n: int, per_epoch: int) -> int:
    """Epochs that one shuffle of the pool lasts."""
    return max(1, n // max(1, per_epoch))


def shards(rows: DataFrame, place: Column, n: Column | int, world: int, batch: int, drop_last: bool) -> DataFrame:
    """Adds shard, slot and batch: place p of n rows is slot p // world of shard p % world; a map, with one explode for padding.

    All shards are equal in length. With drop_last the tail beyond a multiple of ``world`` goes, and so does every
    shard's last, incomplete batch; without, the first rows come again at the end until the shards are equal.
    """
    if world < 1 or batch < 1:
        raise ValueError("world and batch must be positive")
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    at = rows.withColumn("_place", place.cast("long")).filter((F.col("_place") >= 0) & (F.col("_place") < n))
    if drop_last:
        each = F.floor(n / F.lit(world))
        kept = at.filter(F.col("_place") < F.floor(each / F.lit(batch)) * F.lit(batch * world))
    else:
        total = F.ceil(n / F.lit(world)) * world
        kept = at.withColumn("_place", F.explode(repeats(F.col("_place"), n, total)))
    out = kept.withColumns({"shard": (F.col("_place") % world).cast("int"), "slot": F.floor(F.col("_place") / world)})
    return out.withColumn("batch", F.floor(F.col("slot") / batch)).drop("_place")


def sharded_loader(
    a: DataFrame, b: DataFrame | None, split: str, key: str, batch: int, world: int, epoch: int = 0, seed: int = 42, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """The rows of a split's loader in ``world`` processes: shard, slot, batch, key and, but for test, b_key.

    a and b have ``key`` and, from indexed(), ``ordinal``; sizes are their rows, which are counted if not given.
    train: the epoch's slots of a meet b's order of that epoch, pairs are shuffled over the shards and incomplete
    tails go. val: a in order with b in seeded order, as many as the shorter has, padded by the first pairs. test:
    a alone in order; every process has all of it, as shard 0. Orders are permutations of ordinals; what moves is
    the join of the two domains by slot.
    """
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    if split != "test" and b is None:
        raise ValueError("train and val need both domains")
    na, nb = sizes or (a.count(), 0 if b is None else b.count())
    own = a.select(key, "ordinal")
    if split == "test":
        return shards(own, F.col("ordinal"), na, 1, batch, False).select("shard", "slot", "batch", key)
    other = b.select(F.col(key).alias("b_key"), F.col("ordinal").alias("b_ordinal"))
    if split == "val":
        pairs = own.withColumnRenamed("ordinal", "_slot").join(other.select("b_key", permuted(F.col("b_ordinal"), nb, f"{seed}#val").alias("_slot")), "_slot")
        return shards(pairs, F.col("_slot"), min(na, nb), world, batch, False).select("shard", "slot", "batch", key, "b_key")
    per = epochs_per_cycle(na, nb)
    left = epoch_slots(own, na, nb, epoch, epoch // per, epoch // per * per, seed, "_slot")
    pairs = left.join(other.select("b_key", permuted(F.col("b_ordinal"), nb, f"{seed}#b#{epoch}").alias("_slot")), "_slot")
    return shards(pairs, permuted(F.col("_slot"), nb, f"{seed}#sampler#{epoch}"), nb, world, batch, True).select("shard", "slot", "batch", key, "b_key")
