"""N-gram Jaccard join by T-occurrence search over inverted lists.

A document is the set of its word shingles. Two sets that link share at least T of them, so after k - 1 fewer than T tokens
have been set aside, at least k shared ones lie among the rest. The tokens set aside are those with the longest lists: all
tokens stand in one global order, tokens with long lists last.

First each member is held against the head of its list, which links most members of a group of near copies. Then only lists
with members that are still in different components are searched. Of the short ones, those that a set is in are brought to
it and merged with counts; what comes up k times is a candidate, and its exact overlap is found by binary probes of one set
in the other. Long lists are never merged across the cluster: what their members have of all these lists meets in square
blocks, where lists are merged with counts (``search.counted_lists``). No text is sent but those of candidates. Equal sets are
one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.components import components
from ontoloom.llm.search import bundled, counted_lists, linked_pairs, meeting, runs
from ontoloom.llm.shared import BROADCAST_ROWS, Tables, batches, semi, ship
from ontoloom.llm.words import shingles, signed

#: Lists are long beyond so many members; members of shorter lists are brought to each other, which costs at most so many numbers a member.
#: In the order of tokens those of ORDERED times as long lists stand last; that bound rises with them, so that they are at most 2**20.
LONG, ORDERED, MOST_LONG = 64, 8, 20
#: Characters of a block of documents that are searched for each other.
BLOCK_CHARS = 4_000_000
#: Tokens of a block, with some eight characters for each.
BLOCK_TOKENS = BLOCK_CHARS // 8
#: Share of a set's tokens that a pair must have in common among the short lists.
SHARE = 0.05
#: Tokens after which a task counts what it has gathered, and rows that it gives out at a time.
HELD, OUT = 2_000_000, 200_000


def key_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def least_overlap(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def least_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * SHARE))


def _chunks(arrays: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(arrays[0]), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + OUT]) for a in arrays], names)


def _sets(words: int):
    """Per row its set's size and key; then, with no doc_id, tokens that several sets of the task hold, and how many."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        names = ["doc_id", "n", "key", "token"]

        def counted() -> Iterator[pa.RecordBatch]:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            none = pa.nulls(len(token), pa.int64())
            if len(token):
                yield pa.RecordBatch.from_arrays([none, pa.array(n), none, pa.array(signed(token))], names)

        for b in batches(it):
            ids, ns, keys = b.column("doc_id").to_pylist(), [], []
            for doc, text in zip(ids, b.column("text").to_pylist(), strict=True):
                s = shingles(text, words)
                ns.append(len(s))
                keys.append(key_of(s) if len(s) and doc is not None else None)
                if keys[-1] is not None and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(ids), pa.int64())], names)
            if size > HELD:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return run


def _postings(words: int, percent: int, long_lists):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = long_lists.value
        seen: set[int] = set()
        for b in batches(it):
            out: list[tuple[np.ndarray, int, int]] = []
            for text in b.column("text").to_pylist():
                s = signed(shingles(text, words))
                if not len(s) or (key := key_of(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                prefix = n - -(-n * percent // 100) + max(1, int(n * SHARE))
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    s = s[np.lexsort((s, np.where(tokens[at] == s, counts[at], 0)))]
                out.append((s[:prefix], key, n))
            if out:
                reps = [len(p) for p, _, _ in out]
                yield from _chunks([np.concatenate([p for p, _, _ in out]), np.repeat(np.array([k for _, k, _ in out], np.int64), reps), np.repeat(np.array([n for _, _, n in out], np.int64), reps)], ["token", "key", "n"])

    return run


def shared_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, ...) sorted by token: those of tokens with two keys or more, each key once, and each run's first key.

    Only one row and the head of the run are carried from batch to batch, so a run of any length takes no memory.
    """
    last: list[np.ndarray] | None = None  # the row that is held back
    token, first_head = None, None  # of a run that goes on
    for b in it:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if last is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(last, cols, strict=True)]
        if not len(cols[0]):
            continue
        t, k = cols[0], cols[1]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        cols = [c[new] for c in cols]
        t, k = cols[0], cols[1]
        opens = np.ones(len(t), bool)
        opens[1:] = t[1:] != t[:-1]
        if token is not None and t[0] == token:
            opens[0] = False
        start = np.maximum.accumulate(np.where(opens, np.arange(len(t)), -1))
        heads = [np.where(start >= 0, c[start], h) for c, h in zip(cols[1:], first_head or [0] * (len(cols) - 1), strict=True)]
        keep = ~opens
        keep[:-1] |= ~opens[1:]
        # the last row is held back: whether it opens a run of several is not known yet
        token_before = t[-1] if not opens[-1] else None
        last = [c[-1:] for c in cols]
        keep[-1] = False
        out = [c[keep] for c in cols] + [h[keep] for h in heads]
        token, first_head = token_before, [h[-1] for h in heads]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], [*b.schema.names, *(f"head_{n}" for n in b.schema.names[1:])])
    if last is not None and token is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last] + [pa.array([h]) for h in first_head], [*b.schema.names, *(f"head_{n}" for n in b.schema.names[1:])])


def of_a_size(members: DataFrame, percent: int) -> DataFrame:
    """members (bundle, key, label, n) to (bundle, key, label), bundles of more tokens than a block holds cut by the sets' sizes. The sizes of
    two sets that link are at least percent / 100 of each other, so their classes by that ratio are the same or next to each other: a
    set is in the part of its class and in that of the class below, and any two that can link meet in one."""
    large = members.groupBy("bundle").agg((F.sum("n") > BLOCK_TOKENS).alias("large"))
    members = members.join(large, "bundle")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    parts = members.withColumn("c", F.explode(F.when(~F.col("large"), F.array(F.lit(None).cast("long"))).otherwise(F.array(size, size - 1) if percent < 100 else F.array(size))))
    return parts.select(F.xxhash64("bundle", "c").alias("bundle"), "key", "label")


def short_partners(short: DataFrame) -> DataFrame:
    """Short lists' rows (token, key, n, label) in any order, to the pairs (u, v, c) that meet often enough, and how often. In all lists two
    sets stand in one order, that of size and key, so what they share is counted on one side."""
    partners = short.repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(_partners, "key long, need long, list array<long>")
    return partners.repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "u long, v long, c long").distinct()


def can_link(n: Column, m: Column, c: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can link that share c of the tokens kept in lists. Up to where the first of their two prefixes ends in
    the order of all tokens they share no more than these c, and beyond that no more than the rest of the set whose prefix it is."""
    rest = lambda x: F.ceil(x * percent / 100) - F.greatest(F.lit(1), F.floor(x * SHARE))
    needed = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    return (c + F.greatest(rest(n), rest(m)) >= needed) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def least_shared(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """How many of the tokens kept in lists a set of n tokens must share with sets of m tokens to link, by all that ``can_link`` and the least count
    ask for; of sets that cannot link by their sizes, more than they have."""
    some = lambda x: np.maximum(1, (x * SHARE).astype(np.int64))
    n = np.full(len(m), n)
    rest = np.maximum(-(-n * percent // 100) - some(n), -(-m * percent // 100) - some(m))
    out = np.maximum(some(np.minimum(n, m)), -(-(n + m) * percent // (100 + percent)) - rest)
    return np.where(np.minimum(n, m) * 100 >= np.maximum(n, m) * percent, out, n + m)


def _partners(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short lists' rows (token, key, n, label) sorted by token, n and key, to one row a member: (key, need, list): the members after it
    with other labels, and how often one must be met in all such lists. No list has more than LONG members."""
    held: list[np.ndarray] | None = None

    def rows(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, key, n, label = cols
        if not len(token):
            return
        end = np.searchsorted(token, token, "right")  # token is sorted
        at, step, left, right = np.arange(len(token)), 0, [], []
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            other = at[label[at] != label[at + step]]
            left.append(other)
            right.append(other + step)
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        member, start = np.unique(left, return_index=True)
        for k in range(0, len(member), OUT):
            m = member[k : k + OUT]
            ends = np.append(start, len(left))[k : k + len(m) + 1]
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(key[right[ends[0] : ends[-1]]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[m]), pa.array(np.maximum(1, (n[m] * SHARE).astype(np.int64))), lists], ["key", "need", "list"])

    for b in it:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(held, cols, strict=True)]
        if len(cols[0]):
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on in the next batch
            yield from rows([c[:last] for c in cols])
            held = [c[last:] for c in cols]
    if held is not None:
        yield from rows(held)


def _merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, need, list) sorted by key to the pairs (u, v, c) of a key with what its lists, merged, hold often enough."""
    for group in runs(it, 1):
        merged = np.sort(np.concatenate([b.column("list").flatten().to_numpy() for b in group]))
        opens = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.append(opens, len(merged)))
        key, need = group[0].column("key")[0].as_py(), group[0].column("need")[0].as_py()
        enough = count >= need
        found, times = merged[opens][enough], count[enough]
        for k in range(0, len(found), OUT):
            x = found[k : k + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, key)), pa.array(np.maximum(x, key)), pa.array(times[k : k + OUT])], ["u", "v", "c"])


def _texts(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            keys = [key_of(shingles(t, words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("text")], ["key", "text"])

    return run


def two_heads(stars: DataFrame) -> DataFrame:
    """(u, v, c, h) to pairs (u, v): of the heads u that v shares lists with, the one with the most lists c and the first in the order
    of h. A group of near copies then has a few heads, however many lists it has."""
    best = stars.groupBy("v").agg(F.min_by("u", F.struct(-F.col("c"), "u")).alias("x"), F.min_by("u", F.struct("h", "u")).alias("y"))
    return best.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("u"), "v")


def keyed(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with the key of each row's set: null for rows without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = [signed(shingles(t, words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key_of(s) if len(s) else None for s in sets], pa.int64())], [*b.schema.names, "key"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", key long")


def joined(docs: DataFrame, words: int = 5, percent: int = 75, with_sets: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    docs: doc_id, text; other columns are not read. Returns one row for each row of docs: doc_id, n_shingles and
    component_id, the smallest doc_id that links reach. Documents without words (null or empty text) have no shingles and
    are alone; so are rows with a null doc_id, whose component_id is null. Rows that repeat a doc_id are documents of their
    own, each with its own set. No documents: no rows. Sets and shingles are told apart by 64-bit hashes. with_sets adds key,
    the row's set, and root, its component's least key; both are null for rows without words or id.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = tables.write(docs.mapInArrow(_sets(words), "doc_id long, n long, key long, token long"))
    rows = both.filter("token is null").drop("token")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(LONG * ORDERED, total >> MOST_LONG)
    counts = both.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= bound)
    long_ = counts.toPandas().sort_values("token")  # at most total / bound, so 2**20 rows
    long_lists = spark.sparkContext.broadcast((long_["token"].to_numpy(np.int64), long_["n"].to_numpy(np.int64)))

    # a list's head is its most copied set: near copies are mostly copies of that one
    copied = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    postings = docs.filter("doc_id is not null").select("text").mapInArrow(_postings(words, percent, long_lists), "token long, key long, n long")
    postings = postings.join(copied, "key", "left").select("token", "key", "n", F.coalesce("copies", F.lit(1)).alias("copies"))
    lists = postings.repartition("token").sortWithinPartitions("token", F.desc("copies"), "n", "key").mapInArrow(shared_runs, "token long, key long, n long, copies long, head_key long, head_n long, head_copies long")
    lists = tables.write(lists.drop("copies"))

    owner = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    def texts_of(keys: DataFrame) -> DataFrame:
        """(key, text, size): one text of each key."""
        keys = tables.write(keys)
        ids = tables.write(semi(owner, keys, "key").select("doc_id").distinct())
        found = semi(semi(docs, ids, "doc_id").select("text").mapInArrow(_texts(words), "key long, text string"), keys, "key")
        return tables.write(found.dropDuplicates(["key"]).withColumn("size", F.length("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) of keys, to those that link."""
        pairs = tables.write(pairs)
        texts = texts_of(pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct())
        out = linked_pairs(tables, pairs, texts, to_sets, percent)
        tables.drop(pairs, texts)
        return out

    def to_sets(texts: list[str]) -> Iterator[np.ndarray]:
        return (shingles(t, words) for t in texts)

    least = F.least("n", "head_n")
    held = lists.filter("key <> head_key").filter(least * 100 >= F.greatest("n", "head_n") * percent)
    held = held.groupBy(F.col("head_key").alias("u"), F.col("key").alias("v")).agg(F.count("*").alias("c"), F.first(least).alias("m"), F.first(F.struct(-F.col("head_copies"), F.col("head_n"))).alias("h"))
    links = verified(two_heads(held.filter(F.col("c") >= least_count(F.col("m")))))
    labels = tables.write(components(links)).withColumnRenamed("node", "key").withColumnRenamed("root", "label")
    labelled = meeting(lists.select("token", "key", "n"), labels, "key", "left").select("token", "key", "n", F.coalesce("label", "key").alias("label"))
    labelled = tables.write(labelled)
    per_list = labelled.groupBy("token").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    per_list = tables.write(per_list.select("token", (F.col("members") > LONG).alias("long")))
    tables.drop(lists)
    # long lists: pairs that meet in one are counted in blocks, with all that they share in lists of either kind
    mixed = tables.write(meeting(labelled, per_list, "token"))
    tables.drop(labelled, per_list)
    long_members = mixed.filter("long").select("token", "key", "n", "label")
    sizes = long_members.select("key", "n").distinct()
    long_members = tables.write(of_a_size(bundled(tables, long_members.select("token", "key", "label")).join(sizes, "key"), percent))
    keys = tables.write(long_members.select("key").distinct())
    sets = tables.write(semi(mixed.select("key", "n", "token"), keys, "key").groupBy("key", "n").agg(F.collect_list("token").alias("tokens")))
    near = counted_lists(tables, long_members, sets, lambda n, m: least_shared(n, m, percent), BLOCK_CHARS // 8)
    # short lists: of each set the lists are merged with counts
    met = tables.write(short_partners(mixed.filter("not long").select("token", "key", "n", "label")))
    tables.drop(mixed, sets, long_members)
    # pairs that meet in a long list were found there; of the rest only those that what they share leaves possible are looked at
    sizes = tables.write(semi(rows.filter("key is not null").select("key", "n"), met.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "key").distinct())
    sized = meeting(meeting(met, sizes.toDF("u", "n"), "u"), sizes.toDF("v", "m"), "v")
    links = links.union(verified(sized.filter(can_link(F.col("n"), F.col("m"), F.col("c"), percent)).select("u", "v").union(near).distinct()))
    found = tables.write(components(links))
    # the class of a row, and the least id of the class's component
    labelled = tables.write(meeting(rows, found.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", "key", F.coalesce("root", "key").alias("root")))
    least_id = tables.write(labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    out = meeting(labelled, least_id, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(("key", "root") if with_sets else ()))
