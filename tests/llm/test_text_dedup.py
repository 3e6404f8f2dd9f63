"""Jaccard join, substring dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import components as connected
from ontoloom.llm import jaccard, lines, search, substrings
from ontoloom.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t: str | None) -> frozenset:
    w = SPLIT.findall(lower(t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False))


def roots(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(sets: dict) -> dict:
    return roots(sets, [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(connected, "SMALL", small)
    edges = [(9, 8), (8, 7), (1, 2), (2, 3), (3, 1), (5, 5), (20, 1), (7, 9)] + [(100 + k, 101 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df).distinct().collect()}
    want = roots({x for e in edges for x in e}, edges)
    want.pop(5)
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_jaccard(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = near(sets)
    got = jaccard.joined(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        else:
            assert r["component_id"] is None
    assert len(set(want.values())) < len(want) - 12  # there is something to find


def test_jaccard_long_lists(spark, monkeypatch):
    """Many near copies and a passage in every text: all lists are long."""
    monkeypatch.setattr(jaccard, "LONG", 3)
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(60)], [word() for _ in range(30)]
    texts = [[*(word() if rng.random() < 0.02 else w for w in base)] for _ in range(60)]
    texts += [[word() for _ in range(25)] + passage + [word() for _ in range(rng.randint(0, 30))] for _ in range(40)]
    texts += [passage + [word()] for _ in range(5)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    want = near({i: shingles(" ".join(t)) for i, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(df).collect()} == want


def test_jaccard_empty(no_docs):
    assert jaccard.joined(no_docs).collect() == []


def test_jaccard_repeated_ids(spark):
    text = "one two three four five six"
    got = jaccard.joined(spark.createDataFrame([(1, text), (1, text), (2, text), (1, "quite another text than the one above")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1)]


def kept(rows, length=13) -> dict:
    w = {r[0]: SPLIT.findall(r[1] or "") for r in rows if r[0] is not None}
    first: dict = {}
    for i in sorted(w):
        for k in range(len(w[i]) - length + 1):
            first.setdefault(tuple(w[i][k : k + length]), i)
    out = {}
    for i, x in w.items():
        gone = set()
        for k in range(len(x) - length + 1):
            if first[tuple(x[k : k + length])] < i:
                gone.update(range(k, k + length))
        rest = [y for k, y in enumerate(x) if k not in gone]
        out[i] = (len(x), len(gone), hashlib.sha256(" ".join(rest).encode()).hexdigest(), " ".join(rest))
    return out


def test_substrings(docs, rows):
    want = kept(rows)
    got = substrings.deduplicated(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3]
            assert r["kept"] == want[r["doc_id"]][3]
            assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"]
        else:
            assert r["n_removed"] == 0
    short = substrings.deduplicated(docs, with_text=False).filter("doc_id is not null").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in short} == {k: v[:3] for k, v in want.items()}


def test_substrings_long_prefixes(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 1)
    want = kept(rows)
    got = substrings.deduplicated(docs, with_text=False).filter("doc_id is not null").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {k: v[1] for k, v in want.items()}


def test_substrings_of_repeated_ids(spark):
    """Each text of an id loses what a smaller id holds, whatever other texts the id has."""
    w, v = (" ".join(f"{c}{k}" for k in range(20)) for c in "wv")
    rows = [(1, w), (5, w), (5, v), (5, v), (8, v + " tail end"), (8, "quite short"), (9, "x y " + w)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(
        [(1, 20, 0, w), (5, 20, 20, ""), (5, 20, 0, v), (5, 20, 0, v), (8, 22, 20, "tail end"), (8, 2, 0, "quite short"), (9, 22, 20, "x y")]
    )


def test_substrings_empty(no_docs):
    assert substrings.deduplicated(no_docs).collect() == []


def test_lines(docs, rows):
    """Lines of the fixture are alike in nearly all shingles or in few, so MinHash must find what brute force finds."""
    where = {(i, k): lines.normal(x) for i, t, *_ in rows if i is not None for k, x in enumerate((t or "").split("\n"))}
    sets = {p: frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for p, x in where.items() if x}
    root = roots(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    gone = {p for p, r in root.items() if r != p}
    got = lines.deduplicated(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        t = texts[r["doc_id"]]
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r["doc_id"], k) not in gone)
        assert r["text"] == want
    assert len(gone) > 15


def test_short_lines(spark):
    """Lines of any length are compared by their shingles: near copies of short ones go too, a line shorter than a shingle only if equal."""
    texts = ["page one of three pages\nthe end.\nno more", "Page one of three pages.\nthe end!\nno more", "a chapter head\na chapter hea\nno mare", "a chapter head.\nno more"]
    out = lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["text"] for r in out}
    assert got == {0: texts[0], 1: "the end!", 2: "a chapter head\nno mare", 3: ""}


def test_hot_bucket(spark, monkeypatch):
    """Members of a bucket that most lines share go to all ranges, its heads to one; all of them are one component."""
    monkeypatch.setattr(lines, "HELD", 400)
    monkeypatch.setattr(lines, "RANGE", 2000)
    texts = [f"the same long line about the same few things in every text of this table, number {k}" for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    blocks = df.select("text").mapInArrow(lines._blocks(8), "range int, opened binary, members binary").collect()
    sent = [sum(len(b["members"]) for b in blocks if b["range"] == r) for r in range(8)]
    assert max(sent) < 2 * min(sent)
    assert sorted(r["doc_id"] for r in lines.deduplicated(df).filter("n_removed = 0").collect()) == [0]


def test_lines_empty(no_docs):
    assert lines.deduplicated(no_docs).collect() == []


def test_search_by_lists():
    """DivideSkip in a shard against all pairs, with lists of every length, by labels and by blocks."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 40, 80))
    sets = [np.unique(np.where(rng.random(len(base)) < p, rng.integers(0, 1 << 40, len(base)), base)) for p in rng.choice([0.02, 0.1, 0.15, 0.2], 70)]
    sets += [np.unique(rng.integers(0, 200, rng.integers(1, 120))) for _ in range(60)] + [base[:1], base[:1], base[:2]]
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    want = roots(range(len(sets)), [(i, j) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])])
    assert roots(range(len(sets)), search.spanning(sets, np.arange(len(sets)), 75)) == want
    label = np.arange(len(sets))
    label[:40] = [want[i] for i in range(40)]  # what is known already
    got = search.spanning(sets, label, 75)
    assert roots(range(len(sets)), got + [(i, int(label[i])) for i in range(40)]) == want
    block = rng.integers(0, 2, len(sets))
    cross = [(i, j) for i, j in combinations(range(len(sets)), 2) if block[i] != block[j] and alike(sets[i], sets[j])]
    assert roots(range(len(sets)), search.spanning(sets, np.arange(len(sets)), 75, block)) == roots(range(len(sets)), cross)


def test_small_blocks(docs, rows, monkeypatch):
    """Lists cut into many blocks, and firsts of pairs dealt to many tasks, change nothing."""
    monkeypatch.setattr(jaccard, "LONG", 2)
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", 400)
    monkeypatch.setattr(lines, "BLOCK_CHARS", 400)
    monkeypatch.setattr(search, "SERVED", 2)
    want = near({r[0]: shingles(r[1]) for r in rows if r[0] is not None})
    got = jaccard.joined(docs).filter("doc_id is not null").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    monkeypatch.setattr(lines, "HELD", 50)
    test_lines(docs, rows)


def test_line_signatures():
    """Signatures do not depend on what is signed together, and equal minima come up as often as sets are similar."""
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    some = [text(int(n)) for n in rng.integers(8, 400, 300)] + [text(lines.SIGNED + 5), text(8), text(9)]
    together = lines.bands(some)
    assert all((lines.bands([x])[0] == b).all() for x, b in zip(some, together, strict=True))
    pairs, met, exact = 300, 0, 0.0
    for _ in range(pairs):
        x = text(200)
        y = x[: (cut := int(rng.integers(150, 190)))] + text(200 - cut)
        a, b = lines.shingles(x), lines.shingles(y)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        exact += 1 - (1 - j**lines.ROWS) ** lines.BANDS
        met += bool((lines.bands([x])[0] == lines.bands([y])[0]).any())
    assert abs(met - exact) < 0.05 * pairs


def test_short_lists_with_ties(spark):
    """Two sets of one size meet in eight lists whichever of them stands first in each; sets of one label do not."""
    rows = [(t, k, 100, k) for t in range(8) for k in ((1, 2) if t % 2 else (2, 1))] + [(t, k, 100, 7) for t in range(8) for k in (5, 6)]
    got = jaccard.short_partners(spark.createDataFrame(rows, "token long, key long, n long, label long").repartition(5))
    pairs = {tuple(r) for r in got.collect()}
    assert (1, 2, 8) in pairs and (5, 6, 8) not in pairs and len(pairs) == 5


def test_pairs_that_can_link(spark):
    """Whatever two sets share, if they link then what their prefixes share does not rule them out."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.choice(100, n, replace=False)
        b = np.union1d(rng.permutation(a)[: n - int(rng.integers(0, 1 + n // 6))], 100 + rng.choice(100, int(rng.integers(0, 1 + n // 6)), replace=False))
        both, order = len(np.intersect1d(a, b)), rng.permutation(200)
        prefix = lambda x: sorted(x, key=lambda t: order[t])[: len(x) - -(-len(x) * 75 // 100) + max(1, int(len(x) * jaccard.SHARE))]
        if 100 * both >= 75 * (len(a) + len(b) - both):
            rows.append((len(a), len(b), len(set(prefix(a)) & set(prefix(b)))))
    assert len(rows) > 100
    got = spark.createDataFrame(rows, "n long, m long, c long").filter(~jaccard.can_link(F.col("n"), F.col("m"), F.col("c"), 75))
    assert got.count() == 0
    assert spark.createDataFrame([(100, 100, 5)], "n long, m long, c long").filter(jaccard.can_link(F.col("n"), F.col("m"), F.col("c"), 75)).count() == 0


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_parts_by_size(spark, monkeypatch, percent):
    """Any two sizes that can link meet in a part of their bundle."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 10)
    sizes = [*range(1, 70), 100, 133, 134, 1000, 1333, 1334, 10**6, 4 * 10**6 // 3]
    got = jaccard.of_a_size(spark.createDataFrame([(1, n, n, n) for n in sizes], "bundle long, key long, label long, n long"), percent).collect()
    parts = {n: {r["bundle"] for r in got if r["key"] == n} for n in sizes}
    assert all(parts[a] & parts[b] for a in sizes for b in sizes if a <= b and 100 * a >= percent * b)
    assert not parts[10] & parts[1000]


def test_sets_of_many_lines(monkeypatch):
    """Lines hashed together have the shingles that each has by itself, and are not hashed one by one; short ones among them too."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcd é\U0001f600"), n))
    some = [text(int(n)) for n in rng.integers(0, 300, 400)] + ["", "a", text(lines.SIZE), "ab" * 500, text(lines.SIGNED + 9), text(12)]
    want, calls, chars = [lines.shingles(x) for x in some], [], lines.chars
    monkeypatch.setattr(lines, "chars", lambda t: calls.append(len(t)) or chars(t))
    got = list(lines.sets(some))
    assert len(got) == len(want) and all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))
    assert len([n for n in calls if n >= lines.SIZE]) < 8 and list(lines.sets([])) == []


@pytest.mark.parametrize("line", ["", " ", "A b", " A b", "A b ", "A  b", "A\tb", "A\u00a0b", "A\u2003 b", "\x1cA", "ΑΣ ΣΑ", "İ I", "a\u200bb", "a\x00b", "\u0085", "a\u3000"])
def test_normal_lines(line):
    assert lines.normal(line) == " ".join(line.lower().split())


def test_heads_are_the_least_keys():
    rng = np.random.default_rng(6)
    token, key = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(-9, 9, 300)
    t, k, mt, mh, mk = lines._heads(token, key)
    held = {int(x): sorted({int(b) for a, b in zip(token, key, strict=True) if a == x}) for x in sorted(set(token.tolist()))}
    assert t.tolist() == list(held) and k.tolist() == [v[0] for v in held.values()]
    assert list(zip(mt.tolist(), mh.tolist(), mk.tolist(), strict=True)) == [(x, v[0], y) for x, v in held.items() for y in v[1:]]
    assert [len(x) for x in lines._heads(token[:0], key[:0])] == [0] * 5


def test_long_lists_send_tokens(spark, monkeypatch):
    """Long lists of texts that do not link: pairs are counted by tokens in blocks, whatever the order of sizes, and no text goes to a block."""
    monkeypatch.setattr(jaccard, "LONG", 8)
    monkeypatch.setattr(jaccard, "BLOCK_CHARS", 800)
    sent = []
    monkeypatch.setattr(search, "with_texts", lambda rows, texts, old=search.with_texts: sent.append(rows.count()) or old(rows, texts))
    common = " ".join(f"c{k}" for k in range(24))
    texts = [f"{common} " + " ".join(f"w{d}x{k}" for k in range(30)) for d in range(40)]  # they share 20 of 50 shingles
    texts += [texts[d] + " and more" for d in range(0, 40, 4)] + [f"{common} tail{d}" for d in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    assert got == roots(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])])
    assert sum(sent) < 20 * len(texts)  # in blocks of texts each would go to all others


def test_pairs_in_rounds(spark, monkeypatch):
    from ontoloom.llm.shared import Tables

    tables, texts = Tables(spark), [(k, "x" * (5 + k % 3), 5 + k % 3) for k in range(30)]
    pairs = tables.write(spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, 30)], "u long, v long"))
    known = tables.write(spark.createDataFrame(texts, "key long, text string, size int"))
    find = lambda: sorted(map(tuple, search.linked_pairs(tables, pairs, known, lambda ts: (np.arange(len(t)) for t in ts), 85).collect()))
    whole = find()
    monkeypatch.setattr(search, "ROUND_CHARS", 100)
    made = []
    monkeypatch.setattr(search, "with_texts", lambda rows, texts, old=search.with_texts: made.append(rows.count()) or old(rows, texts))
    assert find() == whole and whole and len(made) > 5 and sum(made) == 435 + 29


def test_shuffles_go_with_their_table(spark, tmp_path):
    """What a table was written of leaves no shuffle files, though the driver has not collected its garbage."""
    from pathlib import Path

    from ontoloom.llm.shared import CLEAN, Tables

    left = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in map(str, Path(d).rglob("shuffle_*.data"))}
    before, told = left(), spark.conf.get(CLEAN, None)
    Tables(spark).write(spark.range(10_000).repartition(3, "id"))
    assert left() <= before and spark.conf.get(CLEAN, None) == told
