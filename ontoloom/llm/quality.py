"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The features approximate a Gaussian kernel over a few dozen statistics of a whole text. Each task sums the normal equations
of its labelled documents by two folds; the sums of all tasks are added up by row, and one small system is solved. Scores
are then made probabilities by pooling adjacent violators over score bins; for that each document is scored by the system of
the fold that it is not in, so that calibration sees no score of a row that was learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, batches, held_out, ship

FEATURES, BINS = 256, 200
_SYMBOL = re.compile(r"[^\w\s]")


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text; all 0 for an empty one."""
    t = text or ""
    w = t.split()
    if not w:
        return [0.0] * N_STATISTICS
    raw = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, nw = int(raw.sum()), len(w)
    share = lambda *r: float(sum(raw[a:b].sum() for a, b in r)) / n
    upper, lower, digit, space, newline = share((65, 91)), share((97, 123)), share((48, 58)), share((32, 33)), share((10, 11))
    symbol = share((33, 48), (58, 65), (91, 97), (123, 127))
    stop, comma, mark, bar, other = share((46, 47)), share((44, 45)), share((33, 34), (63, 64)), share((124, 125)), share((35, 39), (42, 44), (60, 63))
    high = share((128, 256))
    lines = t.split("\n")
    length = np.fromiter(map(len, w), np.int64, nw)
    distinct = len(set(w)) / nw
    bits = raw[raw > 0] / n
    return [
        np.log1p(nw) / 10, np.log1p(n / nw), float(length.std()) / 10, float(length.max(initial=0) > 40), distinct, len(set(lines)) / len(lines), np.log1p(nw / len(lines)) / 5,
        upper, lower, digit, space, newline, min(1.0, 4 * symbol), min(1.0, 10 * stop), min(1.0, 10 * comma), min(1.0, 10 * mark), min(1.0, 10 * bar), min(1.0, 10 * other), high,
        sum(x.isupper() for x in w) / nw, sum(x.istitle() for x in w) / nw, sum(1 for x in w if _SYMBOL.search(x)) / nw, sum(not x[-1].isalnum() for x in w) / nw, sum(not any(map(str.isalpha, x)) for x in w) / nw,
        sum(map(str.__eq__, w, w[1:])) / nw, min(1.0, 4 * sum(len(x) == 1 and not x.isalnum() for x in w) / nw),
        float(-(bits * np.log2(bits)).sum()) / 8, len(set(zip(w, w[1:], strict=False))) / max(1, nw - 1), len(set(zip(w, w[1:], w[2:], strict=False))) / max(1, nw - 2),
    ]


N_STATISTICS = 29


@dataclass
class Model:
    """Everything that scoring needs; a few hundred KB whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to value by weighted squares: adjacent violators are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def solved(a: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by normal equations with their right side as the last column; the last feature is 1, so it counts the rows."""
    n = len(a)
    return np.linalg.solve(a[:, :n] + ridge * np.eye(n) * max(1.0, a[-1, n - 1] / 1000), a[:, n])


def _stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1, N_STATISTICS)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATISTICS), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), flat], ["fold", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 200_000, gamma: float = 0.1, ridge: float = 1e-2, seed: int = 2) -> Model:
    """Learn from the documents that have a label 0 or 1.

    most_rows bounds the labelled rows learned from: with more, an even share of them is drawn row by row. Labels of documents
    that are not there, null labels and null ids are passed over; without any label of a kind every score is 0.5 or that of
    the other kind. Repeated labels of a document, and rows that repeat a doc_id, each count. Texts are read whole, however
    long; a null text is an empty one. No documents: nothing is learned.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)")
    n = y.count()
    if n > most_rows:
        y = y.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(2**40)) < int(0.97 * 2**40 * most_rows / n))
    y = y.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id")  # at most most_rows rows
    rows = tables.write(joined.select("fold", "y", "text").mapInArrow(_stats, "fold int, y double, x array<double>"))
    moments = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).orderBy("i").toPandas()
    rng = np.random.default_rng(seed)
    mean, sd = (moments["m"].to_numpy(), moments["s"].to_numpy()) if len(moments) else (np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    base = float(moments["y"].iloc[0]) if len(moments) else 0.5
    model = Model(mean, np.maximum(sd, 1e-3), rng.normal(0, np.sqrt(2 * gamma / N_STATISTICS), (N_STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([base]))
    if not len(moments):
        return model

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for pdf in it:
            for fold, part in pdf.groupby("fold"):
                z = model.features(np.stack(part["x"].to_numpy()))
                a[fold] += z.T @ np.hstack([z, part["y"].to_numpy()[:, None]])
        for fold in (0, 1):
            yield pd.DataFrame({"fold": fold, "i": np.arange(FEATURES + 1), "row": list(a[fold])})

    parts = rows.mapInPandas(sums, "fold int, i int, row array<double>")
    added = parts.groupBy("fold", "i").applyInPandas(lambda key, pdf: pd.DataFrame({"fold": [key[0]], "i": [key[1]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]}), "fold int, i int, row array<double>")
    a = np.stack(added.toPandas().sort_values(["fold", "i"])["row"].to_numpy()).reshape(2, FEATURES + 1, FEATURES + 2)
    model.weights = solved(a.sum(axis=0), ridge)
    others = np.stack([solved(a[1], ridge), solved(a[0], ridge)], axis=1)  # by fold, what was learned from the other one

    def binned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                s = (model.features(np.stack(pdf["x"].to_numpy())) @ others)[np.arange(len(pdf)), pdf["fold"].to_numpy()]
                yield pd.DataFrame({"bin": np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype(int), "s": s, "y": pdf["y"]}).groupby("bin", as_index=False).agg(n=("y", "size"), s=("s", "sum"), y=("y", "sum"))

    bins = rows.mapInPandas(binned, "bin int, n long, s double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("y").alias("y")).orderBy("bin").toPandas()
    model.edges = (bins["s"] / bins["n"]).to_numpy()
    # half a document of the mean label in each bin keeps scores off 0 and 1
    model.levels = isotonic(((bins["y"] + 0.5 * base) / (bins["n"] + 0.5)).to_numpy(), (bins["n"] + 0.5).to_numpy())
    tables.drop(rows)
    return model


def scored(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= least): every row, whole texts; a null text is
    scored as an empty one. Columns score and predicted of docs itself are replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = [shared.value.score(np.array([statistics(t) for t in texts[k : k + 512]], float)) for k in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    # as nondeterministic, so that no plan evaluates it once for the score and once more for the prediction
    return docs.withColumn("score", score.asNondeterministic()(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= least).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learned from labels of ids that are not held out (crc32 of the
    id as text leaves 0 modulo 5; a null id is not held out). Only texts enter a score; equal texts get equal scores; other
    columns are not read; no rows: no rows."""
    model = fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, least).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
