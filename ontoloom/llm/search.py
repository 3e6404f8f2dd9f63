"""T-occurrence search of similar sets: who shares at least T tokens with a set, found from inverted lists.

``Shard`` holds the sets of one piece of work in memory and searches by DivideSkip: of a set's inverted lists the longest are
set aside, the short ones are merged with counts, and what the long ones add is found by a binary search for each of them in a
candidate's set. ``linked_pairs`` and ``linked_lists`` spread such searches over a cluster: pairs by their first member, lists of any
length by square blocks of their members, so that no list meets in one task. Both return links only, never the pairs that
were looked at; of the links inside a list, those that earlier ones imply are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import BROADCAST_ROWS, Tables

#: Weight in DivideSkip's rule for how many lists are set aside, and sets up to which all pairs are probed at once.
MU, FEW = 0.1, 4
#: Members that one copy of a pair's first set serves.
SERVED = 2048
#: Pairs that a task gives out at a time.
GIVEN = 200_000
#: Characters that are shuffled at once for pairs, if all texts together are fewer; else twice those.
ROUND_CHARS = 1 << 30

#: Texts to the set of each, in turn.
ToSets = Callable[[list[str]], Iterator[np.ndarray]]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens in both of two sorted sets: those of the smaller are looked up in the larger by binary search."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def similar(both, n, m, percent: int):
    """Whether sets of n and m tokens that share so many have a Jaccard similarity of at least percent / 100; both empty: no."""
    return (100 * both >= percent * (n + m - both)) & (both > 0)


class Shard:
    """Sorted sets in memory with an inverted list for each token."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        _, token, self.holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(self.size)
        self.sets = [token[a:b] for a, b in zip(ends - self.size, ends, strict=True)]  # tokens as places in their order
        self.members = np.repeat(np.arange(len(sets)), self.size)[np.argsort(token, kind="stable")]  # list after list
        self.starts = np.cumsum(self.holders) - self.holders

    def merged(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens' lists each member is in."""
        length = self.holders[tokens]
        ends = np.cumsum(length)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[tokens] - ends + length, length)
        return np.bincount(self.members[places], minlength=len(self.size))

    def candidates(self, x: int, wanted: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of the wanted members those that may be similar to x, likeliest first; for each member how many tokens it shares with x in
        the lists that were merged; and x's tokens whose lists were set aside."""
        least = -(-self.percent * int(self.size[x]) // 100)  # whatever the partner's size, they share so many
        tokens = self.sets[x]
        length = self.holders[tokens]
        if (length > 1).sum() < least:
            return [], length, tokens
        tokens = tokens[np.argsort(length, kind="stable")]
        aside = min(least - 1, int(least / (MU * np.log2(length.max()) + 1)))
        count = self.merged(tokens[: len(tokens) - aside])
        found = np.flatnonzero((count >= least - aside) & wanted)
        return found[np.argsort(-count[found], kind="stable")].tolist(), count, np.sort(tokens[len(tokens) - aside :])

    def similar(self, x: int, y: int, count: np.ndarray, long: np.ndarray) -> bool:
        return bool(similar(count[y] + overlap(long, self.sets[y]), self.size[x], self.size[y], self.percent))


def spanning(sets: list[np.ndarray], label: np.ndarray, percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets which similar ones connect, given that sets of one label are connected already. With
    block, only links between two blocks are looked for."""
    names, component, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    shard, out = Shard(sets, percent) if len(sets) > FEW else None, []
    left = np.ones(len(sets), bool)  # those that have not asked yet
    for x in np.flatnonzero(component != np.argmax(count)):  # a link to the largest label's members is found from outside
        left[x] = False
        wanted = left & (component != component[x])
        if block is not None:
            wanted &= block != block[x]
        if shard:
            found, *known = shard.candidates(x, wanted)
        else:
            found = np.flatnonzero(wanted).tolist()
        for y in found:  # once x is linked to a component, its other members need no look
            if component[y] == component[x]:
                continue
            if shard.similar(x, y, *known) if shard else similar(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y]), percent):
                out.append((int(x), int(y)))
                component[component == component[y]] = component[x]
    return out


def runs(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """A stream sorted by its first keys columns (whole numbers), as the batches of each run of equal keys in turn."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in it:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        changes = np.zeros(b.num_rows, bool)
        for c in cols:
            changes[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(changes).tolist(), b.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[start] for c in cols)
            if held and key != last:
                yield held
                held = []
            held.append(b.slice(start, end - start))
            last = key
    if held:
        yield held


def meeting(df: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined with another table of few numbers a row: sent to every executor if it was counted to be small, else shuffled."""
    return df.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, key, how)


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the text of their key. Rows that are few go to the texts, so that a text is shuffled once a row at most."""
    texts = texts.select("key", "text")
    return texts.join(F.broadcast(rows), "key") if rows.count() <= BROADCAST_ROWS else rows.join(texts, "key")


def linked_pairs(tables: Tables, pairs: DataFrame, texts: DataFrame, to_sets: ToSets, percent: int) -> DataFrame:
    """pairs (u, v) and texts (key, text, size) to the pairs whose texts' sets are similar. A set u is made once and probed with each
    of its v; a u with many is dealt to several tasks. A text goes to each of its pairs; pairs whose texts are more at once than twice all texts
    go one share after the other, so that what lies on disk does not grow with the pairs of a text."""
    hot = pairs.groupBy("u").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("parts")).filter("parts > 1")  # at most 1 a SERVED pairs
    dealt = meeting(pairs, tables.write(hot), "u", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = tables.write(dealt.select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v"))
    heads = dealt.select("u", "part").distinct().select("u", "part", F.lit(0).alias("late"), F.col("u").alias("key"))
    rows = tables.write(heads.union(dealt.select("u", "part", F.lit(1).alias("late"), F.col("v").alias("key"))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = None, None
        for b in it:
            u, part, late, key = (b.column(i).to_numpy() for i in range(4))
            keep = np.zeros(b.num_rows, bool)
            for k, s in enumerate(to_sets(b.column("text").to_pylist())):
                if not late[k]:
                    head, of = s, (u[k], part[k])
                elif of == (u[k], part[k]):
                    keep[k] = similar(overlap(head, s), len(head), len(s), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(key[keep])], ["u", "v"])

    sizes = tables.write(texts.select("key", "size"))
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sent = meeting(rows.groupBy("key").agg(F.count("*").alias("times")), sizes, "key").agg(F.coalesce(F.sum(F.col("times") * F.col("size")), F.lit(0))).first()[0]
    rounds = max(1, -(-sent // max(ROUND_CHARS, 2 * whole)))
    parts = []
    for k in range(rounds):
        some = rows if rounds == 1 else tables.write(rows.filter(F.pmod(F.xxhash64("part", "u"), F.lit(rounds)) == k))
        sent = with_texts(some, texts).repartition("u", "part").sortWithinPartitions("u", "part", "late")
        parts.append(tables.write(sent.select("u", "part", "late", "key", "text").mapInArrow(run, "u long, v long")))
    tables.drop(dealt, rows, sizes)
    return reduce(DataFrame.union, parts)


def bundled(tables: Tables, members: DataFrame) -> DataFrame:
    """members (token, key, label) of lists to (bundle, key, label): lists with one label alone are left out, and lists that share
    many members become one bundle, so that a key's text is not needed once for each of its lists. A list's bundle is the
    least label that its members' lists hold; whatever meets in a list meets in its bundle."""
    per = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token", "low")
    mixed = tables.write(meeting(members, tables.write(per), "token"))
    lows = tables.write(mixed.groupBy("key").agg(F.min("low").alias("least")))
    bundles = tables.write(meeting(mixed.select("token", "key"), lows, "key").groupBy("token").agg(F.min("least").alias("bundle")))
    out = tables.write(meeting(mixed.select("token", "key", "label"), bundles, "token").select("bundle", "key", "label").distinct())
    tables.drop(mixed, lows)
    return out


def in_blocks(tables: Tables, members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """members (bundle, key, label), sizes (key, size) to rows (bundle, i, j, block, key, label): what is in block i or j of a bundle, for all blocks
    that meet. Members outside a bundle's most frequent label are cut into blocks that meet each other and the blocks of that label's
    members, which need not meet among themselves; the sizes of a block add up to about the given one."""
    most = members.groupBy("bundle", "label").agg(F.count("*").alias("n")).groupBy("bundle").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    sized = meeting(meeting(members, tables.write(sizes), "key"), tables.write(most), "bundle").withColumn("out", F.col("label") != F.col("main"))
    sized = tables.write(sized.select("bundle", "key", "label", "size", "out"))
    many = lambda own, most: F.greatest(F.lit(1), F.ceil(F.sum(F.when(own, F.col("size"))) / most)).cast("int")
    blocks = sized.groupBy("bundle").agg(many(F.col("out"), block).alias("few"), many(~F.col("out"), block).alias("rest"))
    dealt = meeting(sized, tables.write(blocks), "bundle").withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("out"), F.col("few")).otherwise(F.col("rest"))).cast("int"))
    outside = "concat(transform(sequence(0, few - 1), k -> struct(least(own, k) as i, greatest(own, k) as j)), transform(sequence(0, rest - 1), k -> struct(own as i, few + k as j)))"
    inside = "transform(sequence(0, few - 1), k -> struct(k as i, few + own as j))"
    rows = dealt.withColumn("at", F.explode(F.expr(f"if(out, {outside}, {inside})"))).select("bundle", "at.i", "at.j", F.expr("if(out, own, few + own)").alias("block"), "key", "label")
    rows = tables.write(rows)
    tables.drop(sized)
    return rows


def counted_lists(tables: Tables, members: DataFrame, sets: DataFrame, least: Callable, block: int) -> DataFrame:
    """members (bundle, key, label) and sets (key, n, tokens) to the pairs (u, v) of a bundle with other labels that share enough of the tokens.
    Only tokens are sent, a block has about so many, and pairs are counted where their blocks meet. least(n, m): how many a set of n tokens
    in all and those of m tokens or more must share, as two arrays."""
    rows = in_blocks(tables, members, sets.select("key", F.size("tokens").alias("size")), block)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(it, 3):
            table = pa.Table.from_batches(group).combine_chunks()
            key, label, own, n = (table.column(c).to_numpy() for c in ("key", "label", "block", "n"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            if len(key) < 2 or not (label != label[0]).any():
                continue
            size = table.column("tokens").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            _, token = np.unique(table.column("tokens").combine_chunks().flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(size)
            asks, answers = np.ones(len(key), bool), np.ones(len(key), bool)
            if i < j:  # the block of fewer members asks the other
                asks = own == i if (own == i).sum() * 2 <= len(key) else own == j
                answers = ~asks
            held = np.repeat(answers, size)
            holder, at = np.repeat(np.arange(len(key)), size)[held], token[held]
            holder = holder[np.argsort(at, kind="stable")]
            length = np.bincount(at, minlength=int(token.max()) + 1)
            starts = np.cumsum(length) - length
            left, right, found = [], [], 0
            for x in np.flatnonzero(asks):
                mine = token[ends[x] - size[x] : ends[x]]
                many = length[mine]
                last = np.cumsum(many)
                places = np.arange(last[-1] if len(last) else 0) + np.repeat(starts[mine] - last + many, many)
                y, c = np.unique(holder[places], return_counts=True) if len(places) * 8 < len(key) else (None, np.bincount(holder[places], minlength=len(key)))
                if y is None:
                    y = np.flatnonzero(c)
                    c = c[y]
                ok = label[y] != label[x]
                if i == j:
                    ok &= y > x
                y, c = y[ok], c[ok]
                y = y[c >= least(n[x], n[y])] if len(y) else y
                if len(y):
                    left.append(np.full(len(y), key[x]))
                    right.append(key[y])
                    found += len(y)
                if found > GIVEN:
                    yield _pairs(left, right)
                    left, right, found = [], [], 0
            if found:
                yield _pairs(left, right)

    sent = rows.join(sets, "key").repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j", "key")
    out = tables.write(sent.select("bundle", "i", "j", "block", "key", "label", "n", "tokens").mapInArrow(run, "u long, v long"))
    tables.drop(rows)
    return out


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def linked_lists(tables: Tables, members: DataFrame, texts: DataFrame, to_sets: ToSets, percent: int, block: int) -> DataFrame:
    """members (bundle, key, label) and texts (key, text, size) to links (u, v) that connect all keys of a bundle which similar sets
    connect. Blocks are as ``in_blocks`` makes them of so many characters, and a task holds two."""
    rows = in_blocks(tables, members, texts.select("key", "size"), block)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(it, 3):
            table = pa.Table.from_batches(group)
            key, label, block = (table.column(c).to_numpy() for c in ("key", "label", "block"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            if len(key) > 1 and (label != label[0]).any():
                links = spanning(list(to_sets(table.column("text").to_pylist())), label, percent, block if i < j else None)
                if links:
                    a, b = (key[list(x)] for x in zip(*links, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    sent = with_texts(rows, texts).repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j", "key")
    out = tables.write(sent.select("bundle", "i", "j", "block", "key", "label", "text").mapInArrow(run, "u long, v long"))
    tables.drop(rows)
    return out
