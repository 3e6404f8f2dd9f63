"""Best-fit packing of token sequences in bulk-synchronous rounds.

In a round documents and gaps are sorted by size and cut into ranges of equal rank; the k-th ranges of both meet in a task,
which sweeps them, largest first, and gives each document the successor of its length among the gaps; what is left over
goes into the next round with the gaps as they are by then. Few rounds are needed, whatever the number of documents.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.search import runs
from ontoloom.llm.shared import Tables, batches, ship

#: Documents and gaps of a range that one task sweeps, and rows that it gives out at a time.
BLOCK, OUT = 50_000, 100_000
#: Strings whose ids a worker remembers in each of two generations, and the longest that it remembers.
REMEMBERED, LONGEST = 200_000, 64
#: Strings that are encoded as one text, and bytes of text whose strings are told apart at a time.
TOGETHER, GATHERED = 256, 16 << 20
#: Strings of a text with the blanks before them.
_STRING = re.compile("[ ]?(?:[^ ]|(?<=\\s)[ ])+|[ ]")
#: A blank behind white space.
_RUN = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


class Encoder:
    """Ids of texts by a ``tokenizers`` file, with a memory of strings that the file's pre-tokenizer never looks beyond.

    A byte-level pre-tokenizer always cuts before a blank that follows no white space, so a text's ids are those of its strings
    in order, each with the blank before it; white space that holds blanks stays whole. Of many texts each string is looked up
    once, and those that are not remembered are encoded many at a time, as one text: its blanks begin tokens, and no other token
    begins with one, so they tell where a string's ids begin. Strings that end with white space, or do not begin with their only
    blank, are encoded by themselves.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True  # how byte-level tokens write a blank

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def together(self, strings: list[str]) -> list[bytes]:
        """Ids of strings, in order."""
        one = [s.rfind(" ") == 0 and not s[-1].isspace() for s in strings]
        joined, out = list(compress(strings, one)), []
        for k in range(0, len(joined), TOGETHER):
            (e,) = self.tokenizer.encode_batch_fast(["".join(joined[k : k + TOGETHER])], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            at, data = (4 * np.flatnonzero(self.opens[ids])).tolist(), ids.tobytes()
            out += [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)]
        if len(out) != len(joined):
            raise ValueError("the pre-tokenizer does not cut before each blank")
        if len(out) == len(strings):
            return out
        rest, out = iter(self.direct([s for s, x in zip(strings, one, strict=True) if not x])), iter(out)
        return [next(out if x else rest) for x in one]

    def strings(self, strings: list[str]) -> list[bytes]:
        """Ids of distinct strings that hold no blank, each with one before it."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, strings))
        if older:
            for k, ids in enumerate(out):
                if ids is None and (ids := older.get(strings[k])) is not None:
                    out[k] = known[strings[k]] = ids
        new = [k for k, ids in enumerate(out) if ids is None]
        room = max(0, 2 * REMEMBERED - len(known))
        for n, (k, ids) in enumerate(zip(new, self.together([" " + strings[k] for k in new]), strict=True)):
            out[k] = ids
            if n < room and len(strings[k]) <= LONGEST:
                known[strings[k]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (no nulls)."""
        runs = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        split = [_STRING.findall(t) for t in texts.filter(pa.array(runs)).to_pylist()]
        parts = pc.split_pattern(texts, " ")
        at, strings = parts.offsets.to_numpy(), parts.values
        heads = iter(self.direct(strings.take(pa.array(at[:-1][~runs])).to_pylist()))
        coded = (strings.filter(pa.array(np.repeat(~runs, np.diff(at)))) if runs.any() else strings).dictionary_encode()
        at = np.concatenate([[0], np.cumsum(np.where(runs, 0, np.diff(at)))])
        more = list({s for t in split for s in t})
        special = dict(zip(more, self.direct(more), strict=True))
        whole = iter([b"".join([special[s] for s in t]) for t in split])
        ids = pa.array(self.strings(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), memoryview(ids.buffers()[2] or b"")
        return [next(whole) if run else next(heads) + data[ends[i + 1] : ends[j]] for run, i, j in zip(runs, at[:-1], at[1:], strict=True)]


def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of, but for single rows and the last, at least half of GATHERED bytes."""
    held, size = [], 0
    for b in batches(it, 1024):
        if held and size + b.nbytes > GATHERED:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a sequence's pieces; what is over goes first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece of each row's text (null: empty)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in gathered(it):
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(pc.fill_null(b.column("text"), "")), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array([r[5] for r in out], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Fit:
    """Gaps of one task by size; a document gets a sequence of the smallest gap that holds it, the successor of its length."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.sizes = capacity, [[] for _ in range(capacity + 1)], []

    def put(self, gap: int, sequence: int) -> None:
        if gap:
            if not self.held[gap]:
                bisect.insort(self.sizes, gap)
            self.held[gap].append(sequence)

    def place(self, length: int) -> tuple[int, int] | None:
        """(sequence, offset) of a document; None if no gap holds it."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        sequence = self.held[gap].pop()
        if not self.held[gap]:
            self.sizes.pop(at)
        self.put(gap - length, sequence)
        return sequence, self.capacity - gap

    def rest(self) -> list[tuple[int, int]]:
        return [(gap, x) for gap in self.sizes for x in self.held[gap]]


#: Ranges of hashes of one size by which the documents that open sequences are counted.
RANGES = 4096
#: What a row of a round is: a gap, a document without a place, a document with one.
GAP, FREE, PLACED = 0, 1, 2


def _sweep(capacity: int):
    """Rows (block, size, kind, id) sorted by block, size descending and kind, to the block's gaps, free and placed documents."""

    def given(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "id", "size", "sequence", "offset"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(it, 1):
            fit, out = Fit(capacity), []
            for b in group:
                for size, kind, i in zip(*(b.column(c).to_pylist() for c in ("size", "kind", "id")), strict=True):
                    if kind == GAP:
                        fit.put(size, i)
                    elif (at := fit.place(size)) is None:
                        out.append((FREE, i, size, None, None))
                    else:
                        out.append((PLACED, i, size, *at))
                if len(out) > OUT:
                    yield given(out)
                    out = []
            out += [(GAP, x, gap, None, None) for gap, x in fit.rest()]
            if out:
                yield given(out)

    return run


def best_fit(tables: Tables, docs: DataFrame, capacity: int) -> DataFrame:
    """docs (id, size), ids distinct and sizes from 1 to the capacity, to (id, sequence, offset): bulk-synchronous best fit.

    A round opens sequences for the longest documents, exactly as many as the documents' volume needs beyond that of the gaps (after a
    round that found places for few, as many as half of their volume needs, so that rounds end). Then documents and gaps are sorted by size, largest first, and cut into ranges of equal rank, of which the k-th of both meet in
    one task; ties are cut by a hash of their ids. Each task gives every document of its range, longest first, the
    successor of its length among the range's gaps, as they are by then. Gaps and documents that are left go into the next
    round. Ranks come from how many there are of each size, which is all that the driver sees."""
    spark = docs.sparkSession
    free, gaps, placed = docs.select("id", "size"), None, []
    stuck = False  # whether the round before found places for few
    for turn in count():
        waiting = _by_size(free)
        if not waiting:
            break
        there = _by_size(gaps) if gaps is not None else {}
        usable = {s: n for s, n in there.items() if s >= min(waiting)}
        volume = sum(s * n for s, n in waiting.items())
        need = volume - sum(s * n for s, n in usable.items())
        long = sum(n for s, n in waiting.items() if 2 * s > capacity and s > max(usable, default=0))
        m = max(long, -(-need // capacity), 0 if usable else 1, -(-volume // (2 * capacity)) if stuck else 0)
        if m:
            split = tables.write(_opening(free, waiting, m, 2 * turn))
            new = split.filter("opens").select("id", (F.lit(capacity) - F.col("size")).alias("size"))
            placed.append(new.select("id", F.col("id").alias("sequence"), F.lit(0).alias("offset")))
            free = split.filter("not opens").select("id", "size")
            opened = new.filter("size > 0")
            gaps = tables.write(opened if gaps is None else gaps.union(opened))
            waiting, there = _by_size(free), _by_size(gaps)
            if not waiting:
                break
        fits = {s: n for s, n in there.items() if s >= min(waiting)}
        idle = gaps.filter(F.col("size") < min(waiting))
        blocks = max(1, min(-(-(sum(waiting.values()) + sum(fits.values())) // BLOCK), sum(fits.values())))  # a range without a gap places nothing
        rows = None
        for kind, df, sizes in ((GAP, gaps.filter(F.col("size") >= min(waiting)), fits), (FREE, free, waiting)):
            share = F.col("rank") * blocks / max(1, sum(sizes.values()))
            part = _ranked(df, sizes, 2 * turn + 1).select(F.least(F.lit(blocks - 1), F.floor(share)).cast("long").alias("block"), "size", F.lit(kind).alias("kind"), "id")
            rows = part if rows is None else rows.union(part)
        met = rows.repartition(blocks, "block").sortWithinPartitions("block", F.desc("size"), "kind", "id")
        met = tables.write(met.mapInArrow(_sweep(capacity), "kind int, id long, size int, sequence long, offset int"))
        placed.append(met.filter(F.col("kind") == PLACED).select("id", "sequence", "offset"))
        left = met.filter(F.col("kind") == FREE).select("id", "size")
        stuck = 5 * left.count() > 4 * sum(waiting.values())
        free, gaps = left, tables.write(met.filter(F.col("kind") == GAP).select("id", "size").union(idle))
    return reduce(DataFrame.union, placed) if placed else spark.createDataFrame([], "id long, sequence long, offset int")


def _by_size(df: DataFrame) -> dict[int, int]:
    """How many rows there are of each size; sizes are whole numbers up to the capacity."""
    return {r["size"]: r["count"] for r in df.groupBy("size").count().collect()}


def _opening(df: DataFrame, sizes: dict[int, int], m: int, salt: int) -> DataFrame:
    """df with opens: whether a document is one of the m longest; of the size where the cut falls those of the least hashes. They are
    counted by ranges of the hash, and only the range where the cut falls is put in order."""
    last, left = max(sizes), m
    for last in sorted(sizes, reverse=True):
        if left <= sizes[last]:
            break
        left -= sizes[last]
    place = F.xxhash64(F.lit(salt), "id").bitwiseAND(F.lit(RANGES - 1)).cast("long")
    df = df.select("id", "size", place.alias("range"))
    cut, rest = RANGES, 0
    if left < sizes[last]:
        for r in df.filter(F.col("size") == last).groupBy("range").count().orderBy("range").collect():  # at most RANGES rows
            if left <= r["count"]:
                cut, rest = r["range"], left
                break
            left -= r["count"]
    edge = df.filter((F.col("size") == last) & (F.col("range") == cut))
    k = F.row_number().over(Window.partitionBy("range").orderBy("id"))  # one range of one size
    sure = df.filter((F.col("size") != last) | (F.col("range") != cut)).select("id", "size", ((F.col("size") > last) | ((F.col("size") == last) & (F.col("range") < cut))).alias("opens"))
    return sure.union(edge.select("id", "size", (k <= rest).alias("opens")))


def _ranked(df: DataFrame, sizes: dict[int, int], salt: int) -> DataFrame:
    """df with rank, from 0 for the largest size: that of its size plus, among equal ones, the place that a hash of the id has. A salt is
    used once: what a rank has left behind is no even share by the same hash."""
    before, rows = 0, []
    for s in sorted(sizes, reverse=True):
        rows.append((s, before, sizes[s]))
        before += sizes[s]
    first = F.broadcast(df.sparkSession.createDataFrame(rows, "size int, before long, n long"))  # at most one row a size
    place = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(2**40)) / float(2**40)
    return df.join(first, "size").select("id", "size", (F.col("before") + F.floor(place * F.col("n"))).alias("rank"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack the token ids of every row's text, each ended by end_id, into sequences of at most capacity tokens.

    docs: doc_id, text; other columns are not read. A document longer than the capacity is cut into pieces of the capacity,
    of which the first may be shorter; no other is cut. Texts are encoded whole, however long. Returns one row a piece: doc_id,
    piece, start, length, ids_crc32, (ids,) sequence_id, offset. A null or empty text is packed as its end_id alone; a null
    doc_id, and rows that repeat a doc_id, are documents like others; ties of length are ordered by a hash. No documents: no
    rows.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.write(pieces(docs, tokenizer_path, capacity, end_id, with_ids).withColumn("id", F.monotonically_increasing_id()))
    places = tables.write(best_fit(tables, rows.select("id", F.col("length").cast("int").alias("size")), capacity))
    both = rows.join(places, "id")
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
