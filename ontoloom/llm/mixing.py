"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target is a weighted share of the whole budget,
held to a multiple of the source's size, the excess being shared again. Whole epochs of a source are taken first; what
remains of its target is filled by counts of documents for each length: an even share of every length first, then the
largest lengths that still fit, and at last a bounded-knapsack dynamic program over the lengths left, which fits the
remaining words as closely as whole documents can. The counts are then met by seeded choice: the documents of a length
are ordered by a hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, ship
from ontoloom.llm.words import words

#: Hash ranges into which the documents of one source and length are dealt, so that no task orders all of them.
RANGES = 1024


def _sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        n = [len(words(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each document's text (null: 0)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(_sizes, "doc_id long, source string, size long")


def targets(totals: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """totals (source, source_size) to (source, source_size, target): one row a source.

    Sources in order of code points, null last, get the weights in turn. The budget is share times all sizes. Water
    filling: with the sources in order of epochs * size / weight, those below the level are held to their bound and the
    others share what remains by weight; running sums give the level without a loop.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    t = totals.withColumn("w", w).withColumn("bound", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(all_) * float(share))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source in this order that the level does not fill sets the level of all that follow
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "level"))).over(all_)["level"])
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("level") * F.col("w"))).alias("target"))


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as near the budget as the program finds.

    lengths: distinct and positive. The program's table has entries for eight of the largest lengths and some thousand words
    more, or for two of them beyond four million.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    room = int(round(budget)) - int((lengths * take).sum())
    longest = int(lengths.max(initial=1))
    most = max(min(4 * longest + 32_768, 2**21), longest + 2048)
    order = np.argsort(-lengths, kind="stable")
    for k in order:  # large ones first, until the table holds what is left
        if room <= most:
            break
        more = min(int(counts[k] - take[k]), (room - most) // int(lengths[k]) + 1)
        take[k] += more
        room -= more * int(lengths[k])
    for part in (1, 1, 2, 4, 8, 16, 32):  # and back again, so that the program has a choice of lengths
        for k in order:
            back = min(part, int(take[k]), (most - room) // int(lengths[k]))
            if back > 0:
                take[k] -= back
                room += back * int(lengths[k])
    if room <= 0:
        return take
    # reachable sums with the item that first reached each; items are powers of two of a length
    size = 2 * room + 1
    first = np.full(size, -1, np.int32)
    first[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in order:
        left, part = int(min(counts[k] - take[k], size // max(1, int(lengths[k])))), 1
        while left > 0:
            part = min(part, left)
            w = part * int(lengths[k])
            if w < size:
                new = (first[: size - w] >= 0) & (first[w:] < 0)
                first[w:][new] = len(items)
            items.append((int(k), part))
            left, part = left - part, part * 2
        if first[room] >= 0:
            break
    reached = np.flatnonzero(first >= 0)
    at = int(reached[np.argmin(np.abs(reached - room))])
    while at:
        k, part = items[first[at]]
        take[k] += part
        at -= part * int(lengths[k])
    return take


def _fit(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    epochs = int(target // total) if total else 0
    take = np.zeros(len(size), np.int64)
    used = size > 0
    take[used] = fitted(size[used], n[used], target - epochs * total)
    return pd.DataFrame({"source": pdf["source"], "size": size, "epochs": epochs, "take": take, "source_size": total, "target": target})


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 20) -> DataFrame:
    """Choose documents so that each source's words come near its target.

    docs: doc_id, text, source; other columns are not read. Returns one row for each row of docs: doc_id, source, size,
    source_size, target, taken (the words the mix takes: size times the number of times that the row is in the mix).
    A null text has size 0; null sources form a source of their own, last in order; a null doc_id is a row like others.
    Rows that repeat a doc_id count and are chosen each for themselves in the order of their sizes; equal rows share one
    hash and are told apart by an arbitrary number, which does not change the result as a bag. No documents: no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = tables.write(sized(docs).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("range", F.pmod("h", F.lit(RANGES)).cast("int")))
    by_range = tables.write(rows.groupBy("source", "size", "range").agg(F.count("*").alias("n")))
    by_length = by_range.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_epochs)
    goals = goals.withColumnRenamed("source", "s")
    plan = by_length.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = tables.write(plan.groupBy("source").applyInPandas(_fit, "source string, size long, epochs long, take long, source_size long, target double"))
    # documents of a length in hash order: whole ranges first, then the first of the range in which the count ends
    order = Window.partitionBy("source", "size").orderBy("range")
    ranges = by_range.withColumn("before", F.sum("n").over(order) - F.col("n"))
    p, r = plan.alias("p"), ranges.alias("r")
    parts = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))).select(F.col("r.source").alias("s"), F.col("r.size").alias("z"), F.col("r.range").alias("g"), "epochs", "source_size", "target", F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("want"), "n")
    ranked = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("range") == F.col("g"))).drop("s", "z", "g")
    whole = ranked.filter("want = 0 or want = n").withColumn("more", F.col("want") > 0)
    cut = ranked.filter("want > 0 and want < n").withColumn("more", F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("h", "doc_id")) <= F.col("want"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more").cast("long"))).alias("taken")]
    return whole.select(*cols).union(cut.select(*cols))
