"""Substring dedup: repeated word sequences of a fixed length, found by grouping windows by their hashes.

This takes the place of a suffix tree: windows are told apart by two hashes of their words, so there is no order of suffixes by their
words, no common-prefix length and no maximal repeat; removing every window of ``length`` words that starts earlier needs the
equality of windows alone. The README has the figures for a tree.

Every word of a text begins a suffix. Only suffixes whose first words can repeat are kept: each window of ``length`` words names the
least hash among its ``short`` -word grams, equal windows name equal grams, and a gram that one document alone names rules its
windows out. The windows left are dealt to groups by the hash of their first ``short`` words, or of the full length where a group
would be large; in a group they are sorted by hash and equal ones stand together. Before the shuffle each task keeps, of equal
windows, only those of the least document that it has met: all others are known to be repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.jaccard import OUT, _chunks, shared_runs
from ontoloom.llm.search import meeting
from ontoloom.llm.shared import BROADCAST_ROWS, Tables, batches, semi, ship
from ontoloom.llm.words import hashes, signed, windows, words

#: Suffixes of one prefix from which it is lengthened; with more suffixes the bound rises, so that at most 2**16 are.
GROUP, MOST_GROUPS = 20_000, 16
#: Bits of a position that are its place in a text; the ones above are the text's number among those of its doc_id.
PLACES = 40
#: Suffixes that a task gathers before it looks for equal ones among them.
HELD = 1_000_000


def _whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        n, sha = [], []
        for t in b.column("text").to_pylist():
            w = words(t)
            n.append(len(w))
            sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "sha"])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        sha = [hashlib.sha256(b" ".join(words(t))).hexdigest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(sha, pa.string())], ["doc_id", "text", "sha"])


def _named(h: np.ndarray, short: int, length: int) -> np.ndarray:
    """For each window of a text's word hashes the least hash of the grams in it."""
    g = windows(h, short)
    return np.lib.stride_tricks.sliding_window_view(g, length - short + 1).min(axis=1)


def _grams(short: int, length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(t)
                if len(w) >= length:
                    out.append((doc, np.unique(_named(hashes(w), short, length))))
            if out:
                yield from _chunks([signed(np.concatenate([g for _, g in out])), np.repeat(np.array([d for d, _ in out], np.int64), [len(g) for _, g in out])], ["gram", "doc_id"])

    return run


def _suffixes(short: int, length: int):
    """Rows (doc_id, text, grams) to suffixes (p, q, doc_id, pos): hashes of the first short and length words. Suffixes that a
    smaller document of this task repeats come with no p and q."""

    def settled(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        p, q, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, q, p))
        p, q, doc, pos = p[order], q[order], doc[order], pos[order]
        opens = np.ones(len(p), bool)
        opens[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        least = doc[np.maximum.accumulate(np.where(opens, np.arange(len(p)), 0))]
        known = doc > least
        for k in range(0, len(p), OUT):
            x = slice(k, k + OUT)
            yield pa.RecordBatch.from_arrays([pa.array(p[x], mask=known[x]), pa.array(q[x], mask=known[x]), pa.array(doc[x]), pa.array(pos[x])], ["p", "q", "doc_id", "pos"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches(it):
            for doc, number, t, grams in zip(b.column("doc_id").to_pylist(), b.column("number").to_pylist(), b.column("text").to_pylist(), b.column("grams"), strict=True):
                h = hashes(words(t))
                if len(h) < length:
                    continue
                pos = np.flatnonzero(np.isin(signed(_named(h, short, length)), grams.values.to_numpy()))
                held.append((signed(windows(h, short))[pos], signed(windows(h, length))[pos], np.full(len(pos), doc, np.int64), pos + (number << PLACES)))
                size += len(pos)
                if size > HELD:
                    yield from settled(held)
                    held, size = [], 0
        if size:
            yield from settled(held)

    return run


def _repeats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (p, q, doc_id, pos) in order, to those under a node (p, q) whose first leaf is of a smaller document."""
    node, least = None, 0
    for b in it:
        p, q, doc, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(p):
            continue
        opens = np.ones(len(p), bool)
        opens[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        opens[0] = node != (p[0], q[0])
        start = np.maximum.accumulate(np.where(opens, np.arange(len(p)), -1))
        first = np.where(start >= 0, doc[start], least)
        node, least = (p[-1], q[-1]), first[-1]
        again = doc > first
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(pos[again])], ["doc_id", "pos"])


def repeated(docs: DataFrame, short: int = 5, length: int = 13) -> DataFrame:
    """docs (doc_id, number, text) to (doc_id, starts): the windows of length words that also start in a document with a smaller
    doc_id, each as number << PLACES plus its place. Documents without such a window are not listed."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    grams = docs.select("doc_id", "text").mapInArrow(_grams(short, length), "gram long, doc_id long").repartition("gram").sortWithinPartitions("gram", "doc_id").mapInArrow(shared_runs, "gram long, doc_id long, head_doc_id long")
    grams = tables.write(grams.select("gram", "doc_id"))
    ids = tables.write(grams.select("doc_id").distinct())
    named = grams.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    texts = semi(docs.select("doc_id", "number", "text"), ids, "doc_id").join(named, "doc_id").select("doc_id", "number", "text", "grams")
    leaves = tables.write(texts.mapInArrow(_suffixes(short, length), "p long, q long, doc_id long, pos long"))
    open_ = leaves.filter("p is not null")
    bound = max(GROUP, open_.count() >> MOST_GROUPS)
    large = open_.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > bound).select("p", F.lit(True).alias("large"))
    dealt = open_.join(F.broadcast(large), "p", "left").withColumn("prefix", F.when(F.col("large"), F.col("q")).otherwise(F.col("p")))  # at most 2**16 rows
    again = dealt.repartition("prefix").sortWithinPartitions("p", "q", "doc_id", "pos").select("p", "q", "doc_id", "pos").mapInArrow(_repeats, "doc_id long, pos long")
    return leaves.filter("p is null").select("doc_id", "pos").union(again).groupBy("doc_id").agg(F.collect_list("pos").alias("starts"))


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of length words that begins at one of starts."""
    step, starts = np.zeros(n + 1, np.int64), starts[starts + length <= n]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def _kept(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n, gone, kept, spans = [], [], [], []
            for t, number, starts in zip(b.column("text").to_pylist(), b.column("number").to_pylist(), b.column("starts"), strict=True):
                w, at = words(t), starts.values.to_numpy()
                out = covered(len(w), at[at >> PLACES == number] & ((1 << PLACES) - 1), length)
                n.append(len(w))
                gone.append(int(out.sum()))
                kept.append(b" ".join([x for x, o in zip(w, out.tolist(), strict=True) if not o]).decode("utf-8", "surrogatepass"))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                spans.append(edge.tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def _numbered(tables: Tables, docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and rows with number: of an id's different texts each has its own, from 0; where ids are unique, all have 0."""
    zero = F.lit(0).cast("long").alias("number")
    again = tables.write(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a < b").select("doc_id"))
    if again.isEmpty():
        return docs.select("doc_id", "text", zero), rows.select("*", zero)
    texts = semi(rows, again, "doc_id").select("doc_id", "sha").distinct()
    texts = tables.write(texts.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha")).cast("long") - 1))
    rows = rows.join(texts, ["doc_id", "sha"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
    hashed = semi(docs, again, "doc_id").mapInArrow(_hashed, "doc_id long, text string, sha string").join(texts, ["doc_id", "sha"]).select("doc_id", "text", "number")
    return docs.join(again, "doc_id", "left_anti").select("doc_id", "text", zero).union(hashed), rows.select("doc_id", "n_words", "sha", "number")


def deduplicated(docs: DataFrame, length: int = 13, short: int = 5, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of length words that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are not read. Returns one row for each row of docs: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and, with_text, kept and spans (from, to, from, to, ... in words).
    Windows are judged on the input. Null texts have no words. Rows with a null doc_id neither lose words nor take any from
    others. Texts are taken whole, however long. Of rows that repeat a doc_id each text is one of that document: it loses what
    starts in a smaller doc_id, nothing to the other texts of its own, and rows with the same text get the one result. No
    documents: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = tables.write(docs.mapInArrow(_whole, "doc_id long, n_words long, sha string"))
    docs, rows = _numbered(tables, docs, rows)
    # texts that repeat a smaller document's word for word go as a whole and need no search
    firsts = rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    rows = meeting(rows, tables.write(firsts), "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= length))
    rows = tables.write(rows)
    copies = tables.write(rows.filter("copy").select("doc_id", "number").distinct())
    small = copies.count() <= BROADCAST_ROWS
    search = docs.filter("doc_id is not null").join(F.broadcast(copies) if small else copies, ["doc_id", "number"], "left_anti")
    found = tables.write(repeated(search, short, length))
    hit = semi(search, found.select("doc_id"), "doc_id").join(found, "doc_id").select("doc_id", "number", "text", "starts")
    cut = hit.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept string, spans array<long>")
    sha = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    extra = [F.col("kept"), F.col("spans")] if with_text else []
    out = cut.select("doc_id", "n_words", "n_removed", sha, *extra)
    gone = rows.filter("copy")
    nothing = [F.lit("").alias("kept"), F.array(F.lit(0).cast("long"), "n_words").alias("spans")] if with_text else []
    out = out.unionByName(gone.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), *nothing))
    same = rows.filter("not copy").join(found.select("doc_id"), "doc_id", "left_anti")
    if with_text:
        texts = docs.select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).alias("kept"))
        texts = texts.withColumn("own", F.sha2(F.col("kept").cast("binary"), 256)).dropDuplicates(["id", "own"])
        same = same.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha"))).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), "kept", F.expr("cast(array() as array<long>)").alias("spans"))
    else:
        same = same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return out.unionByName(same)
