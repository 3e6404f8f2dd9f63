"""Time-ordered target encoding: how often earlier lines of other folds, that share a value, were returned.

Lines are added up by (sale, item, vendor) first; the rows that are left stay what they are and go through four exchanges, one by
item, by vendor, by client and by time. In each they are dealt to shards. A key with less than one part in ``shards`` of all rows
goes to the shard of its hash; a hot key is cut into time slices at quantiles of a bounded sample of its times, and rows of one
moment that fill more than a slice are dealt out evenly, as they are no history of each other. A shard is cogrouped with the sums
of what comes before its slices (by value and fold) and with the attributes of its keys: numpy sorts its times, searches every row's
time in the times of each fold, takes the difference of prefix sums there and adds what came before.

Hot keys and their slices are bounded by ``shards`` alone, whatever the input; nothing else reaches the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, ship

FOLDS = 5
#: Rows of a shard where there are few.
ROWS = 2048
#: Sampled times a slice.
SAMPLED = 16
#: What stands for a null key within the exchanges.
NO_ID = -(2**63)


def _micros(df: DataFrame, name: str) -> Column:
    """A moment as microseconds, by its own clock: timestamps without a zone are read as they are written, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


@dataclass
class Slices:
    """The time slices of hot keys. Of a key with bounds b1 < b2 < ... they are, in order: before b1, at b1, between b1 and b2, at b2
    and so on. What lies at a bound is dealt to as many shards as quantiles fell there."""

    keys: np.ndarray  # hot keys, sorted
    bounds: list[np.ndarray]  # times, for each
    shards: list[np.ndarray]  # first shard of each slice, for each key; and one past the last

    @classmethod
    def of(cls, sample: pd.DataFrame, first: int) -> Slices:
        """sample (key, at): about SAMPLED times a slice."""
        keys, bounds, shards = [], [], []
        for key, times in sample.groupby("key")["at"]:
            t = np.sort(times.to_numpy(np.int64))
            b, n = np.unique(t[SAMPLED // 2 :: SAMPLED], return_counts=True)
            width = np.ones(2 * len(b) + 1, np.int64)
            width[1::2] = n
            keys.append(key)
            bounds.append(b)
            shards.append(first + np.concatenate([[0], np.cumsum(width)]))
            first = int(shards[-1][-1])
        order = np.argsort(np.array(keys, np.int64)) if keys else []
        return cls(np.array([keys[i] for i in order], np.int64), [bounds[i] for i in order], [shards[i] for i in order])

    def table(self, spark: SparkSession) -> DataFrame:
        """(key, slice, shard): every shard of every slice."""
        rows = [(int(k), i, int(x)) for k, s in zip(self.keys, self.shards, strict=True) for i in range(len(s) - 1) for x in range(s[i], s[i + 1])]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "slice", "shard"]).astype("int64"), "key long, slice long, shard long") if rows else spark.createDataFrame([], "key long, slice long, shard long")

    def place(self, key: np.ndarray, at: np.ndarray, salt: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slice, shard) of rows: -1 and the given shard for keys that are not hot."""
        slice_, shard = np.full(len(key), -1, np.int64), shard.copy()
        if len(self.keys):
            hot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hot = np.where(self.keys[hot] == key, hot, -1)
            for h in np.unique(hot[hot >= 0]):
                rows, b, s = np.flatnonzero(hot == h), self.bounds[h], self.shards[h]
                i = np.searchsorted(b, at[rows], "left") + np.searchsorted(b, at[rows], "right")
                slice_[rows], shard[rows] = i, s[i] + salt[rows] % (s[i + 1] - s[i])
        return slice_, shard


def looked_up(keys: np.ndarray, names: np.ndarray, values: np.ndarray, other: int | np.ndarray) -> np.ndarray:
    """For each key the value (a number or a row of them) of the equal name, else other. Names are distinct."""
    if not len(names):
        return np.broadcast_to(other, (len(keys), *values.shape[1:]))
    order = np.argsort(names)
    at = order[np.minimum(np.searchsorted(names[order], keys), len(names) - 1)]
    hit = names[at] == keys
    return np.where(hit.reshape(-1, *[1] * (values.ndim - 1)), values[at], other)


def sums_before(value: np.ndarray, at: np.ndarray, fold: np.ndarray, n: np.ndarray, s: np.ndarray, names: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sums of n and s over rows of its value, of other folds and of an earlier time, and over what came before:
    names, and for each the sums of n by fold and of s by fold."""
    if not len(value):
        return n, s
    order = np.lexsort((at, value))
    v, t, f = value[order], at[order], fold[order]
    opens_value = np.concatenate([[True], v[1:] != v[:-1]])
    rank = np.cumsum(opens_value | np.concatenate([[True], t[1:] != t[:-1]]))  # of (value, time)
    heads, which = np.flatnonzero(opens_value), np.cumsum(opens_value) - 1
    first = rank[heads]  # of each value
    known = looked_up(v[heads], names, before, 0)
    out = np.zeros((2, len(v)), np.int64)
    for k in range(FOLDS):
        mine = np.flatnonzero(f == k)
        times = rank[mine]
        to, since = np.searchsorted(times, rank, "left"), np.searchsorted(times, first, "left")
        for j, x in enumerate((n, s)):
            prefix = np.concatenate([[0], np.cumsum(x[order][mine])])
            out[j] += np.where(f == k, 0, prefix[to] + (known[:, FOLDS * j + k] - prefix[since])[which])
    back = np.empty_like(out)
    back[:, order] = out
    return back[0], back[1]


def _spread(tables: Tables, rows: DataFrame, count: int, key: str, columns: dict[str, str], shards: int, attributes: DataFrame | None = None) -> DataFrame:
    """rows with, for each name and value column of columns, name_n and name_s: the sums over earlier rows of other folds that share
    the value. Rows are dealt by key (``key`` is ``whole`` to deal by time alone). attributes (id, one value), ids distinct: joined to
    the key on the way; NO_ID where a key has none."""
    spark = rows.sparkSession
    parts = min(shards, max(16, count // ROWS))
    salt = F.xxhash64(F.lit(3), "sale_id", "item_id", "vendor_id").bitwiseAND(F.lit(2**62 - 1))
    base = rows.withColumn("key", F.col(key)).withColumn("salt", salt).withColumn("shard", _bucket(parts))
    many = base.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") * parts > count).select("key")
    hot = F.broadcast(spark.createDataFrame([(k,) for k in many.toPandas()["key"].tolist()], "key long"))  # fewer than parts, as each has more than a part of the rows
    hot_rows = base.join(hot, "key", "left_semi").select(*base.columns)
    slices = Slices.of(hot_rows.filter(F.col("salt") % count < SAMPLED * parts).select("key", "at").toPandas(), parts)
    shared = spark.sparkContext.broadcast(slices)
    places = F.broadcast(slices.table(spark))  # fewer than four times parts
    kept = rows.columns
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            slice_, shard = shared.value.place(*(b.column(c).to_numpy() for c in ("key", "at", "salt", "shard")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), b.column("key"), pa.array(slice_), pa.array(shard)], [*kept, "key", "slice", "shard"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.mapInArrow(place, f"{schema}, key long, slice long, shard long")

    # what comes before each slice, by value and fold
    names = [f"{c}{k}" for c in ("n", "s") for k in range(FOLDS)]
    sums = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for c in ("n", "s") for k in range(FOLDS)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("value")) for i, c in enumerate(columns.values())]))
    seen = dealt(hot_rows).select("key", "slice", "fold", "n", "s", each.alias("e")).groupBy("key", "slice", "e.dim", "e.value").agg(*sums)
    order = Window.partitionBy("key", "dim", "value").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most two slices a shard
    gone = seen.select("key", "slice", "dim", "value", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(c) for c in names])
    told = gone.join(places, ["key", "slice"]).select("shard", "dim", "value", *names, F.lit(0).cast("long").alias("attribute"))
    new = None
    if attributes is not None:
        new = attributes.columns[1]
        a = attributes.toDF("key", "attribute").join(places, "key", "left").withColumn("bucket", _bucket(parts))
        told = told.union(a.select(F.coalesce("shard", "bucket"), F.lit(-1), "key", *[F.lit(0).cast("long")] * len(names), "attribute"))
    made = [f"{name}_{c}" for name in columns for c in ("n", "s")] + ([new] if new else [])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        have = {c: left.column(c).to_numpy() for c in left.column_names}
        dim, value = right.column("dim").to_numpy(), right.column("value").to_numpy()
        out = []
        for i, column in enumerate(columns.values()):
            mine = np.flatnonzero(dim == i)
            before = np.stack([right.column(c).to_numpy()[mine] for c in names], axis=1)
            out += sums_before(have[column], have["at"], have["fold"], have["n"], have["s"], value[mine], before)
        if new:
            mine = np.flatnonzero(dim == -1)
            out.append(looked_up(have["key"], value[mine], right.column("attribute").to_numpy()[mine], NO_ID))
        return pa.table([*(left.column(c) for c in kept), *map(pa.array, out)], names=[*kept, *made])

    out = dealt(base).groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(answered, schema + "".join(f", {c} long" for c in made))
    return tables.write(out)


def _bucket(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(parts)).cast("long")


def _attribute(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a number for the value) of the rows that have both; of rows that repeat a key the least value counts."""
    known = table.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(value).alias(value))
    return known.select(key, F.xxhash64(value).alias(value))


def encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, weight: int = 50, prior: int = 500_000, shards: int = 1024) -> DataFrame:
    """One row for each (sale_id, item_id, vendor_id) of the lines that have a sale with a sold_at: n_lines, n_returned, and of item,
    vendor and client the number of lines in its history (item_n, ...) and their rate of returns in millionths (item_rate, ...).

    lines: sale_id, item_id, vendor_id, flag. sales: sale_id, client_id, sold_at. items: item_id, kind. vendors: vendor_id, nation_id.
    clients: client_id, segment. Other columns are not read. A sale's fold is the crc32 of its id modulo 5. A line's history is all
    lines of other folds sold earlier, not at the same moment. Without history of its own a value has the rate of the wider group
    (item: kind; vendor: nation; client: segment; these: all lines; all lines: prior), else that rate weighs as much as ``weight`` lines.

    A null item or client is the id -1; a null vendor is an id of its own, returned as null. Unknown ids, and known ones whose kind,
    nation or segment is null, share one group. Lines with a null sale, and repeated lines, are dropped and counted as often as they
    stand. Of sales that repeat a sale_id the earliest, then the one of the least client, counts; of items, vendors and clients that
    repeat an id, the least value. Ties in time are no history of each other. A null flag is not returned. No lines: no rows.

    shards: how finely rows are cut, which bounds what a task holds to a few parts in so many of all rows; kinds, nations and
    segments are told apart by 64-bit hashes.
    """
    spark = lines.sparkSession
    ship(spark)
    tables = Tables(spark)
    own = lines.filter("sale_id is not null").select(
        F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce(F.col("vendor_id").cast("long"), F.lit(NO_ID)).alias("vendor_id"), (F.col("flag") == "returned").alias("r")
    )
    own = own.groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.count_if("r").alias("s"))
    sold = sales.filter("sale_id is not null and sold_at is not null").select(F.col("sale_id").cast("long").alias("sale_id"), _micros(sales, "sold_at").alias("at"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"))
    sold = tables.write(sold.groupBy("sale_id").agg(F.min(F.struct("at", "client_id")).alias("x")).select("sale_id", "x.at", "x.client_id"))
    fold = (F.crc32(F.col("sale_id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold")
    # neither side is broadcast; a hot sale's partition is split, as nothing above needs its rows together
    rows = own.join(sold.hint("merge"), "sale_id").select("sale_id", "item_id", "vendor_id", "client_id", "at", fold, "n", "s", F.lit(0).cast("long").alias("whole"))
    rows = tables.write(rows)
    count = rows.count()
    for key, of in (("item", (items, "item_id", "kind")), ("vendor", (vendors, "vendor_id", "nation_id")), ("client", (clients, "client_id", "segment"))):
        before, rows = rows, _spread(tables, rows, count, f"{key}_id", {key: f"{key}_id"}, shards, _attribute(*of))
        tables.drop(before)
    before, rows = rows, _spread(tables, rows, count, "whole", {"all": "whole", "kind": "kind", "nation": "nation_id", "segment": "segment"}, shards)
    tables.drop(before, sold)
    rate = lambda name, p: F.expr(f"if({name}_n < 1, {p}, (1000000L * {name}_s + {weight}L * {p}) div ({name}_n + {weight}L))")
    rows = rows.withColumn("all_rate", rate("all", f"{prior}L"))
    rows = rows.withColumns({f"{x}_rate": rate(x, "all_rate") for x in ("kind", "nation", "segment")})
    rows = rows.withColumns({f"{x}_rate": rate(x, f"{y}_rate") for x, y in (("item", "kind"), ("vendor", "nation"), ("client", "segment"))})
    vendor = F.nullif("vendor_id", F.lit(NO_ID)).alias("vendor_id")
    return rows.select("sale_id", "item_id", vendor, F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")
