"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its character
n-grams instead, the longest first: where an n-gram is unknown, shorter ones take its place, down to single characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, batches, held_out, ship

_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Unseen words that a worker remembers.
REMEMBERED = 200_000


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals that are no digits (such as superscripts and fractions) are no letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, LONGEST + 1):
        for k in range(len(padded) - n + 1):
            yield padded[k : k + n]


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in c]), pa.array([k[1] for k in c]), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    c: Counter = Counter()
    for b in batches(it):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for w, n in Counter(letters(text)).items():
                c[lang, w] += n
        if len(c) > 500_000:
            yield out(c)
            c = Counter()
    if c:
        yield out(c)


def _split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        c: Counter = Counter()
        for lang, w, n in zip(pdf["lang"], pdf["word"], pdf["n"], strict=True):
            for g in grams(w):
                c[lang, g] += n
        yield pd.DataFrame([(k[0], k[1], n) for k, n in c.items()], columns=["lang", "gram", "n"])


class Model:
    """Languages, and log frequencies by language of known words and of known n-grams, each a name's row in a matrix."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray):
        self.langs, self.words, self.grams, self.gram_rows = langs, words, grams, gram_rows
        self.known, self.rows = len(word_rows), word_rows  # after the known words' rows come those of unseen ones

    def backoff(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its positions of the longest known n-gram there; positions without one do not count."""
        at, counts, get = [], [], self.grams.get
        for word in words:
            padded, before = f" {word} ", len(at)
            for k in range(len(padded)):
                for n in range(min(LONGEST, len(padded) - k), 0, -1):
                    if (i := get(padded[k : k + n])) is not None:
                        at.append(i)
                        break
            counts.append(len(at) - before)
        n = np.array(counts, np.int64)
        sums = np.zeros((len(words), len(self.langs)))
        if at:
            hit = np.flatnonzero(n)
            sums[hit] = np.add.reduceat(self.gram_rows[at], (np.cumsum(n) - n)[hit], axis=0)
        return sums / np.maximum(1, n)[:, None]

    def learn(self, words: set[str]) -> None:
        """Give unseen words their rows; those of earlier texts are forgotten when they are too many."""
        if len(self.words) > self.known + REMEMBERED:
            self.words = {w: i for w, i in self.words.items() if i < self.known}
            self.rows = self.rows[: self.known]
        new = sorted(words - self.words.keys())
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.words.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, self.backoff(part)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and its share of the likelihood; und and 0 without letters. Of equally likely ones the first in order."""
        found = [letters(t) for t in texts]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        size = np.array([len(f) for f in found], np.int64)
        hit = np.flatnonzero(size)
        if not len(hit) or not self.langs:
            return names, score
        self.learn(set().union(*found))
        ids = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, int(size.sum()))
        total = np.add.reduceat(self.rows[ids], (np.cumsum(size) - size)[hit], axis=0)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score[hit] = p[np.arange(len(hit)), best]
        for k, i in zip(hit, best, strict=True):
            names[k] = self.langs[i]
        return names, score


def _table(counts: pd.DataFrame, key: str, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Names in order, and their log frequencies with half a count for each language that lacks the name."""
    names, rows = np.unique(counts[key].to_numpy(object).astype(str), return_inverse=True) if len(counts) else (np.zeros(0, str), np.zeros(0, int))
    n = np.zeros((len(names), len(langs)))
    n[rows, counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = counts["n"].to_numpy(float)
    return {str(x): i for i, x in enumerate(names)}, np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(names))))


def fit(docs: DataFrame, rows_per_lang: int = 5_000, least_word: int = 2, least_gram: int = 5, seed: int = 10) -> Model:
    """Learn from text and lang of docs (null or empty lang, and null text: passed over).

    Learns from at most about rows_per_lang documents of a language: with more, an even share of them by a hash of id and text.
    That bounds the model, which holds every word that is counted least_word times there in a language, and every n-gram that
    is counted least_gram times; rarer ones are as good as unseen. Texts are counted whole, each row of repeated ones. No
    documents: no language is known, and every text is und.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and lang <> '' and text is not null")
    per = d.groupBy("lang").agg(F.count("*").alias("rows")).filter(F.col("rows") > rows_per_lang)
    share = {r["lang"]: rows_per_lang / r["rows"] for r in per.collect()}  # the languages with more rows than that
    bound = F.lit(2**40)
    for lang, x in share.items():
        bound = F.when(F.col("lang") == lang, F.lit(int(x * 2**40))).otherwise(bound)
    part = d.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(2**40)) < bound)
    words = tables.write(part.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    known = words.filter(F.col("n") >= least_word).toPandas()
    split = words.mapInPandas(_split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = split.filter(F.col("n") >= least_gram).toPandas()
    langs = sorted(set(known["lang"]) | set(kept["lang"]))
    tables.drop(words)
    # an n-gram's frequency is that among n-grams of its length
    grams, rows = {}, []
    for n in range(1, LONGEST + 1):
        names, logs = _table(kept[kept["gram"].str.len() == n].reset_index(drop=True), "gram", langs)
        before = len(grams)
        grams.update((x, before + i) for x, i in names.items())
        rows.append(logs)
    return Model(langs, *_table(known, "word", langs), grams, np.concatenate(rows))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row's whole text, however long; `und` with score 0 if it is null, empty or has no
    letter. Rows that repeat a doc_id or a text are scored each; of equally likely languages the first in order is taken; other
    columns are not read; no rows: no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            names, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, learned from rows that are not held out (crc32 of the id as text leaves 1
    modulo 3). A null doc_id is not held out, but is not learned from either."""
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)))
    return predicted(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
