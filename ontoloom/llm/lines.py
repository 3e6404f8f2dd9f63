"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept of each component.

Lines are compared after lower-casing and with runs of white space as one blank. Each distinct line gets a signature of
minima over its character shingles; bands of the signature deal it to buckets; bucket members are held against the bucket's
head, then, where they are not yet linked, against each other, list by list; a pair counts only if the exact Jaccard
similarity of its shingles reaches the threshold; linked lines are joined by distributed union-find. Of each component the
first line (by doc_id, then place) stays. A line shorter than a shingle is one shingle as a whole, so it is like equal ones alone.

Buckets are exchanged as blocks of numbers: a task sorts what it has gathered by bucket and sends each range of buckets as
one block, so a line costs 16 bytes a band and no row of its own. Of a bucket that a task has filled with several lines only
the head goes to the bucket's range; the others, named as its members, are dealt to all ranges evenly and written as they
come, so a task of a bucket of any size meets one head for each block of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.components import components
from ontoloom.llm.search import bundled, linked_lists, linked_pairs, meeting, runs
from ontoloom.llm.shared import BROADCAST_ROWS, Tables, batches, semi, ship
from ontoloom.llm.words import mixed, signed

#: Characters of a shingle, bands, and minima of a band: at a similarity of 0.75 a pair meets in a bucket with 0.998.
SIZE, BANDS, ROWS = 8, 16, 4
#: Characters that are signed at a time (their hashes stay in a core's cache), and buckets that a task gathers before it sends.
SIGNED, HELD = 1 << 16, 1_000_000
#: Characters of a block of lines that are searched for each other.
BLOCK_CHARS = 1_000_000
#: Buckets that one range of them should have.
RANGE = 500_000
_STEP = 0x9E3779B97F4A7C15


def normal(line: str) -> str:
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":  # no printable white space but the blank
        return line.lower()
    return " ".join(line.lower().split())


def key_of(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >> 63 else h


def chars(text: str) -> np.ndarray:
    """Hashes of a text's shingles in order; of a text shorter than one, of the whole."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(c) < SIZE:
        return mixed(np.array([sum(int(x) * pow(_STEP, k, 2**64) for k, x in enumerate(reversed(c.tolist()))) % 2**64], np.uint64))
    width = 1
    while width < SIZE:  # a hash of width characters and the next one make a hash of twice the width
        c = c[:-width] * np.uint64(pow(_STEP, width, 2**64)) + c[width:]
        width *= 2
    return mixed(c)


def shingles(line: str) -> np.ndarray:
    return np.unique(chars(line))


def sets(lines: list[str]) -> Iterator[np.ndarray]:
    """The shingles of each line in turn, hashed for many lines at a time."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    total = np.cumsum(size)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SIGNED, "right")))
        h, start = chars("".join(lines[at:to])), 0
        for k in range(at, to):
            if size[k] < SIZE:
                yield shingles(lines[k])
            else:
                own = np.sort(h[start : start + size[k] - SIZE + 1])  # without shingles that span it and the next line
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                yield own[new]
            start += size[k]
        at = to


#: Odd numbers that order the hashes anew, one for each minimum.
_MULTIPLIERS = np.random.default_rng(3).integers(0, 2**31, (BANDS, ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bands(lines: list[str]) -> np.ndarray:
    """One row of band hashes for each line of at least SIZE characters."""
    out, size = np.empty((len(lines), BANDS), np.uint64), np.fromiter(map(len, lines), np.int64, len(lines))
    total = np.cumsum(size)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SIGNED, "right")))
        h = (chars("".join(lines[at:to])) >> np.uint64(32)).astype(np.uint32)
        # a line's own shingles, then those that span it and the next line, which no one takes
        cut = np.repeat(np.concatenate([[0], np.cumsum(size[at : to - 1])]), 2)
        cut[1::2] += size[at:to] - SIZE + 1
        cut, product = cut[:-1], np.empty_like(h)
        for band in range(BANDS):
            acc = np.zeros(to - at, np.uint64)
            for a in _MULTIPLIERS[band]:
                np.multiply(h, a, out=product)
                acc = mixed(acc + np.minimum.reduceat(product, cut)[::2].astype(np.uint64) + np.uint64(1))
            out[at:to, band] = acc + np.uint64(band)
        at = to
    return out


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to (doc_id, line, key) of the lines that hold text."""
    for b in batches(it):
        doc, line, key = [], [], []
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            for k, x in enumerate((t or "").split("\n")):
                if x := normal(x):
                    doc.append(d)
                    line.append(k)
                    key.append(key_of(x))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int64()), pa.array(key, pa.int64())], ["doc_id", "line", "key"])


def _heads(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, key) to the distinct tokens with their least keys, and (token, head, key) of the other members."""
    order = np.argsort(token)
    token, key = token[order], key[order]
    alone = np.ones(len(token) + 1, bool)
    np.not_equal(token[1:], token[:-1], out=alone[1:-1])
    some = np.flatnonzero(~(alone[:-1] & alone[1:]))  # rows whose token stands several times: only these need an order of keys
    key[some] = key[some[np.lexsort((key[some], token[some]))]]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key = token[new], key[new]
    opens = np.ones(len(token), bool)
    opens[1:] = token[1:] != token[:-1]
    head = key[np.maximum.accumulate(np.where(opens, np.arange(len(token)), 0))]
    return token[opens], key[opens], token[~opens], head[~opens], key[~opens]


def _blocks(ranges: int):
    """Rows to (range, opened, members): blocks of buckets' heads (token, key) and of their other members (token, head, key)."""

    def sent(token: list[np.ndarray], key: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, k, mt, mh, mk = _heads(np.concatenate(token), np.concatenate(key))
        edges = np.array([r * 2**64 // ranges for r in range(1, ranges)], np.uint64)  # tokens sort as unsigned numbers
        a = np.concatenate([[0], np.searchsorted(t, edges), [len(t)]])
        m = np.arange(ranges + 1) * len(mt) // ranges  # members need not meet others of their bucket
        for r in range(ranges):
            x, y = slice(a[r], a[r + 1]), slice(m[r], m[r + 1])
            if x.stop > x.start or y.stop > y.start:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r], pa.int32()),
                        pa.array([np.concatenate([signed(t[x]), k[x]]).tobytes()], pa.binary()),
                        pa.array([np.concatenate([signed(mt[y]), mh[y], mk[y]]).tobytes()], pa.binary()),
                    ],
                    ["range", "opened", "members"],
                )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        token, key, size = [], [], 0
        for b in batches(it, 256):
            new: dict[int, str] = {}
            for t in b.column("text").to_pylist():
                for x in (t or "").split("\n"):
                    if len(x := normal(x)) >= SIZE and (k := key_of(x)) not in seen:
                        seen.add(k)
                        new[k] = x
            if new:
                token.append(bands(list(new.values())).ravel())
                key.append(np.repeat(np.fromiter(new, np.int64, len(new)), BANDS))
                size += len(token[-1])
            if size > HELD:
                yield from sent(token, key)
                token, key, size = [], [], 0
        if size:
            yield from sent(token, key)

    return run


def _stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by range to (token, u, v): members v of buckets with head u as they come, then other heads of the range's buckets."""
    for group in runs(it, 1):
        token, key = [], []
        for b in group:
            for opened, members in zip(b.column("opened"), b.column("members"), strict=True):
                x, y = np.frombuffer(opened.as_buffer(), np.int64), np.frombuffer(members.as_buffer(), np.int64)
                token.append(x[: len(x) // 2])
                key.append(x[len(x) // 2 :])
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in y.reshape(3, -1)], ["token", "u", "v"])
        _, _, *heads = _heads(np.concatenate(token), np.concatenate(key))
        if len(heads[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in heads], ["token", "u", "v"])


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        found = {key_of(x): x for t in b.column("text").to_pylist() for x in map(normal, (t or "").split("\n")) if x}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["key", "text"])


def links(docs: DataFrame, places: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """(u, v): links between keys of lines of at least SIZE characters that connect all that share a bucket and are similar."""
    ranges = max(1, -(-places.count() * BANDS // RANGE))
    blocks = docs.select("text").mapInArrow(_blocks(ranges), "range int, opened binary, members binary")
    stars = tables.write(blocks.repartition("range").sortWithinPartitions("range").mapInArrow(_stars, "token long, u long, v long"))
    members = stars.select("token", F.col("u").alias("key")).union(stars.select("token", F.col("v").alias("key"))).distinct()
    keys = tables.write(stars.select(F.col("u").alias("key")).union(stars.select(F.col("v").alias("key"))).distinct())
    ids = tables.write(semi(places, keys, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    texts = semi(semi(docs, ids, "doc_id").select("text").mapInArrow(_texts, "key long, text string"), keys, "key")
    texts = tables.write(texts.dropDuplicates(["key"]).withColumn("size", F.length("text")))
    # of a line's heads the one that it shares most buckets with, and the least: a group of near copies then has few heads
    by_pair = stars.groupBy("u", "v").agg(F.count("*").alias("c"))
    best = by_pair.groupBy("v").agg(F.min_by("u", F.struct(-F.col("c"), "u")).alias("x"), F.min("u").alias("y"))
    pairs = tables.write(best.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("u"), "v"))
    found = linked_pairs(tables, pairs, texts, sets, percent)
    roots = tables.write(components(found))
    labels = roots.withColumnRenamed("node", "key").withColumnRenamed("root", "label")
    labelled = meeting(members, labels, "key", "left").select("token", "key", F.coalesce("label", "key").alias("label"))
    labelled = bundled(tables, tables.write(labelled))
    more = linked_lists(tables, labelled, texts, sets, percent, BLOCK_CHARS)
    tables.drop(stars, keys, ids, texts, pairs, labelled, roots)
    return found.union(more)


def repeats(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, line, key): the lines that go, by place in the text split at newlines; each line that stands after another of its
    component in the order of doc_id and place. Lines without text take no part."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    places = tables.write(docs.mapInArrow(_lines, "doc_id long, line long, key long"))
    found = tables.write(components(links(docs, places, tables, percent)))
    rooted = meeting(places, found.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "line", "key", F.coalesce("root", "key").alias("root"))
    rooted = tables.write(rooted)
    firsts = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = meeting(rooted, tables.write(firsts), "root")
    return again.filter(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line", "key")


def _without(keep: tuple[str, ...]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            kept, n, gone = [], [], []
            for t, cut in zip(b.column("text").to_pylist(), b.column("cut").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                rest = lines
                if cut:
                    places, out = set(cut[0]), set(zip(*cut, strict=True))
                    rest = [x for k, x in enumerate(lines) if k not in places or (k, key_of(normal(x))) not in out]
                kept.append(t if len(rest) == len(lines) else "\n".join(rest))
                n.append(0 if t is None else len(lines))
                gone.append(len(lines) - len(rest))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), *map(b.column, keep)], ["doc_id", "text", "n_lines", "n_removed", *keep])

    return run


def deduplicated(docs: DataFrame, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, text without the lines that repeat an earlier one exactly or nearly, n_lines, n_removed,
    and the columns named in keep.

    docs: doc_id, text; other columns are not read. Lines are the parts of a text between newlines, compared by their shingles
    of SIZE characters after normalisation; a shorter line is one shingle. Lines without text always stay. All
    lines of rows with a null doc_id stay. A null text stays null and has no lines; an empty one is one line without text.
    Texts and lines of any length are taken whole. Rows that repeat a doc_id and text are one document; rows that repeat a
    doc_id with different texts are compared line by line, places counted in each; of equal lines the least doc_id and
    place stays. No documents: no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    schema = "doc_id long, text string, n_lines long, n_removed long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema[2:])
    cuts = tables.write(repeats(docs, percent).groupBy("doc_id").agg(F.collect_list(F.struct("line", "key")).alias("cut")).select("doc_id", F.array("cut.line", "cut.key").alias("cut")))
    ids = cuts.select("doc_id")
    small = ids.count() <= BROADCAST_ROWS
    whole = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").withColumn("cut", F.lit(None).cast("array<array<bigint>>"))
    hit = semi(docs, ids, "doc_id").join(cuts, "doc_id")
    return whole.unionByName(hit).mapInArrow(_without(keep), schema)
