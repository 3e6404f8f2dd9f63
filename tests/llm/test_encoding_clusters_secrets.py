"""Target encoding, centroid clustering and secret scans against plain versions, with awkward rows and hot keys."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import clusters, encoding, queries, secrets

SF = "/root/testdata/sf0.001"


# target encoding


def plain_encoding(lines, sales, items, vendors, clients):
    """Every line against every other."""
    first = {}
    for s, c, t in sales:
        if s is not None and t is not None:
            x = (t, -1 if c is None else c)
            first[s] = min(first.get(s, x), x)
    kind, nation, segment = ({k: min(v for i, v in rows if i == k and v is not None) for k, v in rows if k is not None and v is not None} for rows in (items, vendors, clients))
    made = []
    for s, i, v, flag in lines:
        if s in first:
            t, c = first[s]
            i = -1 if i is None else i
            made.append({"sale": s, "item": i, "vendor": v, "client": c, "t": t, "fold": zlib.crc32(str(s).encode()) % 5, "r": flag == "returned", "kind": kind.get(i), "nation": nation.get(v), "segment": segment.get(c), "all": 0})
    out = {}
    for x in made:
        key = (x["sale"], x["item"], x["vendor"])
        if key in out:
            continue
        before = [y for y in made if y["fold"] != x["fold"] and y["t"] < x["t"]]

        def rate(column, p, x=x, before=before):
            mine = [y for y in before if y[column] == x[column]]
            n, s = len(mine), sum(y["r"] for y in mine)
            return n, p if n < 1 else (1000000 * s + 50 * p) // (n + 50)

        _, p = rate("all", 500000)
        own = [y for y in made if (y["sale"], y["item"], y["vendor"]) == key]
        row = [len(own), sum(y["r"] for y in own)]
        for column, group in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            row += rate(column, rate(group, p)[1])
        out[key] = tuple(row)
    return out


def shop(spark, lines, sales, items, vendors, clients):
    make = lambda rows, schema: spark.createDataFrame(rows, schema).withColumns({"key": F.lit("k"), "shard": F.lit("s"), "at": F.lit("a")})
    return (
        make(lines, "sale_id long, item_id long, vendor_id long, flag string").repartition(3),
        make(sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
        make(items, "item_id long, kind string"),
        make(vendors, "vendor_id long, nation_id int"),
        make(clients, "client_id long, segment string"),
    )


@pytest.mark.parametrize("rows,shards", [(60, 4), (400, 16), (400, 1024)])
def test_encoding(spark, monkeypatch, rows, shards):
    """Nulls, unknown ids, ties in time, repeated lines, one hot sale, item and client; slices of any width."""
    monkeypatch.setattr(encoding, "ROWS", 8)
    rng = random.Random(rows)
    begin = datetime(2024, 3, 30, 23, 0, 0)  # zones change their clocks in the night that follows
    sales = [(k, rng.choice([1, 1, 2, 3, None]), begin + timedelta(microseconds=rng.choice([0, 1, 2, 3_600_000_000, k * 600_000_000]))) for k in range(40)]
    sales += [(40, 1, None), (41, None, begin), (41, 5, begin - timedelta(days=1)), (None, 1, begin)]
    lines = [(rng.choice([0, 0, 0, *range(45), None]), rng.choice([7, 7, 8, *range(12), None]), rng.choice([1, 2, None]), rng.choice(["returned", "kept", None])) for _ in range(rows)]
    lines += lines[:5]
    items = [(k, rng.choice(["a", "b", None])) for k in range(9)] + [(None, "a"), (3, "c")]
    vendors, clients = [(1, 4), (1, 3), (2, None)], [(1, "x"), (2, None), (3, "y")]
    out = encoding.encoded(*shop(spark, lines, sales, items, vendors, clients), shards=shards)
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in out.collect()} == plain_encoding(lines, sales, items, vendors, clients)


def test_encoding_empty(spark):
    out = encoding.encoded(*shop(spark, [], [], [], [], []))
    assert out.collect() == [] and out.columns[:5] == ["sale_id", "item_id", "vendor_id", "n_lines", "n_returned"]
    assert encoding.encoded(*shop(spark, [(1, 1, 1, "kept")], [], [], [], [])).count() == 0


def test_slices():
    """Rows of one key go to slices in the order of their times; a moment that fills several is dealt to as many."""
    import pandas as pd

    rng = np.random.default_rng(1)
    at = np.concatenate([rng.integers(0, 1000, 300), np.full(300, 500)])
    made = encoding.Slices.of(pd.DataFrame({"key": 9, "at": at}), 10)
    slice_, shard = made.place(np.full(len(at), 9), at, rng.integers(0, 2**40, len(at)), np.zeros(len(at), np.int64))
    for a, b in zip(np.argsort(at, kind="stable")[:-1], np.argsort(at, kind="stable")[1:], strict=True):
        assert slice_[a] <= slice_[b] and (at[a] == at[b] or slice_[a] < slice_[b] or slice_[a] % 2 == 0)
    assert len({*shard[at == 500].tolist()}) > 10 and shard.min() >= 10
    other = made.place(np.array([3]), np.array([5]), np.array([1]), np.array([4]))
    assert [x.tolist() for x in other] == [[-1], [4]]


# clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)
    c = [x for *_, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if groups[j] else y for j, y in enumerate(c)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = defaultdict(int)
    for _, j, d in out:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("x"), "owner": F.lit("o"), "distance": F.lit("d")}).repartition(3)


@pytest.mark.parametrize("count", [3, 15, 200])
def test_clusters(spark, count):
    """Nulls, other lengths, non-finite components, repeated ids and vectors, ties and fewer vectors than clusters."""
    rng = np.random.default_rng(count)
    made = [(k, rng.choice([-0.5, -0.25, 0.0, 0.1, 0.75], 64).tolist()) for k in range(count)]
    made += [made[0], (made[1][0], made[2][1]), (None, made[0][1]), (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [0.0] * 64), (906, [])]
    got = sorted((tuple(r) for r in clusters.clustered(vectors(spark, made)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == plain_clusters(made)


def test_clusters_empty_and_large(spark):
    assert clusters.clustered(vectors(spark, [])).collect() == []
    with pytest.raises(ValueError):
        clusters.clustered(vectors(spark, [(1, [3e38] * 64)]))


def test_clusters_compare_less():
    """Later rounds compare rows whose owner stood still with moved centroids only, and find what all comparisons find."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-64, 64, (500, 8)), rng.integers(-64, 64, (6, 8))
    owner, distance, first = clusters.nearest(x, c, np.full(500, -1), np.zeros(500, np.int64), np.arange(6))
    c[[1, 4]] += rng.integers(-20, 20, (2, 8))
    got = clusters.nearest(x, c, owner, distance, np.array([1, 4]))
    want = clusters.squared(x, c)
    assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all() and got[2] < first


@pytest.mark.parametrize("name,tables", [("op11_target_encoding", "sale_lines sales items vendors clients"), ("op13_centroid_clustering", "embeddings")])
def test_against_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*cols).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


# secrets


def plain_base(text):
    found = []
    for place, (kind, pattern, group, least, flags) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0),
    )):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return [x for *_, x in sorted(found)]


def test_secrets_base(spark, docs, rows):
    """Counts and digests of the plain spans, over awkward texts too."""
    hexes = "0123456789abcdef" * 2
    extra = [(900, f'Password : "{hexes}" and AKIA{"A1" * 9} x', *[None] * 9), (901, "token=abc secret = 12345 API_KEY='abcdef", *[None] * 9), (902, hexes + "\U0001f600 " + hexes, *[None] * 9), (903, "paſſword = abcdefgh", *[None] * 9)]
    df = docs.union(spark.createDataFrame(extra, docs.schema))
    want = defaultdict(list)
    for r in [*rows, *extra]:
        told = plain_base(r[1])
        want[r[0]].append((*(sum(x.startswith(k) for x in told) for k in ("assign:", "access:", "hex:")), hashlib.sha256(",".join(told).encode()).hexdigest(), ",".join(told)))
    got = defaultdict(list)
    for r in secrets.scanned(df).collect():
        got[r[0]].append((*r[1:5], ",".join(x for x in r["spans"].split(",") if x and not x.startswith("format:"))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_secrets_learned_formats(spark):
    """Tokens of a learned format are found without the words that the plain patterns need; ordinary long words and numbers are not."""
    rng = random.Random(3)
    key = lambda: "zk-" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(28))
    word = lambda: "".join(rng.choice(["hen", "keit", "lich", "ung", "ver", "ein"]) for _ in range(rng.randint(5, 8)))
    texts = [f"api_key = {key()} here" for _ in range(120)] + [f"{word()} {word()} {rng.randint(10**15, 10**16)} text" for _ in range(300)]
    lone = [key() for _ in range(40)]
    texts += [f"see {x} there" for x in lone]
    out = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {r["doc_id"] for r in out if "format:" in r["spans"]}
    assert len(added & set(range(420, 460))) >= 38 and not added & set(range(120, 420))
    one = next(r for r in out if r["doc_id"] in added)
    assert one["spans"] == f"format:4:{4 + 31}" and one["n_assign"] == 0
    again = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_secrets_automaton():
    """States that go on alike become one: a language of repeats needs as many states as it has phases, and keeps its start."""
    rng = random.Random(1)
    values = ["ab" + "".join(rng.choice("01") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    made = secrets.Automaton.inferred(values)
    assert len(made.met) < 20 and sum(made.ends) == 400
    assert made.likelihood("ab0101") > made.likelihood("010101") and made.likelihood("ab0101") > made.likelihood("zz")
    total = sum(np.exp(made.likelihood(v)) for v in {*values})
    assert total <= 1


def test_secrets_empty(spark, no_docs):
    assert secrets.scanned(no_docs).collect() == []
    bare = secrets.scanned(spark.createDataFrame([(1, "nothing to see in averyveryverylongword"), (None, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["spans"]) for r in bare} == {(1, ""), (None, "")}
