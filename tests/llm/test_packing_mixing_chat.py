"""Packing, mixing and chat formatting: exact round trips and brute-force checks."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ontoloom.llm import chat, mixing, packing, queries
from ontoloom.llm.shared import Tables


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_whole_texts(tokenizer, rows):
    texts = [r[1] or "" for r in rows]
    enc = packing.Encoder(queries.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(pa.array(texts)) == want
    assert enc.encode(pa.array(texts)) == want  # from memory
    assert enc.encode(pa.array(texts).slice(3, 20)) == want[3:23]
    assert enc.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, rows, tokenizer, capacity):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])
    out = packing.packed(docs, queries.tokenizer_path(), capacity, with_ids=True).collect()
    places, got = defaultdict(list), defaultdict(dict)
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= capacity
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            got[r["doc_id"]][r["piece"]] = r
    for i, parts in got.items():
        whole = ids[i][0]
        assert sum((parts[k]["ids"] for k in range(len(parts))), []) == whole
        assert [parts[k]["start"] for k in range(len(parts))] == np.cumsum([0, *(parts[k]["length"] for k in range(len(parts) - 1))]).tolist()
        assert len(parts) == -(-len(whole) // capacity) and all(parts[k]["length"] == capacity for k in range(1, len(parts)))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in out)
    assert len(places) <= -(-total // capacity) * 1.06 + 1


def test_packing_empty(no_docs):
    assert packing.packed(no_docs, queries.tokenizer_path()).collect() == []


def plain_best_fit(sizes: list[int], capacity: int) -> int:
    """Sequences that best fit needs, longest first, one document after another."""
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else None
        bisect.insort(gaps, (capacity if gap is None else gap) - n)
    return len(gaps)


@pytest.mark.parametrize("block", [30, 10**6])
@pytest.mark.parametrize("kind", ["prose", "equal", "thirds", "tiny", "one"])
def test_best_fit_rounds(spark, monkeypatch, kind, block):
    """Rounds over ranges of any length place every document once, without overlap, in hardly more sequences than plain best fit."""
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = np.random.default_rng(8)
    made = {"prose": lambda: np.minimum(512, rng.lognormal(4.2, 1.2, 400)), "equal": lambda: np.full(100, 200), "thirds": lambda: rng.choice([171, 170, 340, 512, 1], 300), "tiny": lambda: rng.integers(1, 9, 500), "one": lambda: [77]}
    sizes = [max(1, int(x)) for x in made[kind]()]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int").repartition(3)
    got = packing.best_fit(Tables(spark), df, 512).collect()
    assert sorted(r["id"] for r in got) == list(range(len(sizes)))
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence"]].append((r["offset"], sizes[r["id"]]))
    for places in filled.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(filled) <= plain_best_fit(sizes, 512) * 1.05 + 1


def test_packing_against_plain_best_fit(spark):
    """The table's pieces in as many sequences as plain best fit needs, but for a few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.packed(docs, queries.tokenizer_path()).select("length", "sequence_id").collect()
    assert len({r["sequence_id"] for r in out}) <= plain_best_fit([r["length"] for r in out], 2048) * 1.01 + 1


@pytest.mark.parametrize("text", ["a", "a  b", "  a", "a ", "a.\nb c,\nd", "a\n\nb", "x\n y", "é è. ÀB!? c2 d_e it's", "<|endoftext|> a<|endoftext|>b", "a\tb \n c", "…. ,,a", "\u00a0a\u2003b", "день 日本 a\u0301"])
def test_remembered_ids(tokenizer, text):
    """Ids of strings put together are those of the whole text, when they are met first and when they are remembered."""
    made = packing.Encoder(queries.tokenizer_path())
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert [made.encode(pa.array([text, text + " " + text, text]))[k] for k in (0, 2)] == [want, want] == [made.encode(pa.array([text]))[0]] * 2


@pytest.mark.parametrize("text", ["a \u00a0 \u00a0", "a\t \u00a0 b\n \n c", "x\u00a0 \u00a0 y z"])
def test_white_space_with_blanks_stays_whole(tokenizer, text):
    """A token may hold several blanks with other white space between them."""
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.Encoder(queries.tokenizer_path()).encode(pa.array([text])) == [want]


def test_units_are_encoded_together(monkeypatch, tokenizer):
    """Strings that are met first do not cost a call each, and come out as by themselves."""
    enc = packing.Encoder(queries.tokenizer_path())
    strings = [f" w{k}x" for k in range(1000)] + [" ", "  a", " a b", " a\n", "b", " \u00a0", " <|endoftext|>", " a<|endoftext|>b"]
    want, direct = enc.direct(strings), enc.direct
    alone = []
    monkeypatch.setattr(enc, "direct", lambda texts: alone.extend(texts) or direct(texts))
    assert enc.together(strings) == want
    assert len(alone) < 10


def test_each_string_is_looked_up_once_for_many_rows(monkeypatch):
    """Small batches of texts are put together, so a string that all of them hold is looked up once; a large row stays by itself."""
    texts = [f"same words {k}" for k in range(400)] + ["x " * 5000] + ["same words"] * 3
    rows = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    asked, strings = [], packing.Encoder.strings
    monkeypatch.setattr(packing, "GATHERED", 8000)
    monkeypatch.setattr(packing.Encoder, "strings", lambda self, s: asked.extend(s) or strings(self, s))
    enc, sizes, got = packing.Encoder(queries.tokenizer_path()), [], []
    for b in packing.gathered(iter(rows)):
        sizes.append(b.nbytes)
        got += enc.encode(b.column("text"))
    assert got == enc.direct(texts) and all(n <= 8000 for n in sizes if n < 10000) and len(sizes) < 8
    assert asked.count("words") < 8


def shares(sizes: dict, total: float) -> dict:
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), total
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(docs, rows):
    size = lambda t: len((t or "").encode().split())
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = shares(sizes, 1.5 * sum(sizes.values()))
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    taken: dict = defaultdict(int)
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():  # as near as whole epochs and a subset of one more can come
        epochs, sums = (int(t // sizes[s]), 1) if sizes[s] else (0, 1)
        for r in rows:
            sums |= sums << size(r[1]) if r[3] == s else 0
        best = min(abs(epochs * sizes[s] + k - t) for k in range(sums.bit_length()) if sums >> k & 1)
        assert abs(taken[s] - t) <= best + 1
    again = mixing.mixed(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixing_empty(no_docs):
    assert mixing.mixed(no_docs).collect() == []


def test_mixing_without_words(spark):
    out = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2


@pytest.mark.parametrize("budget", [0, 1, 7, 100, 12345, 10**6])
def test_fitted_is_near(budget):
    lengths, counts = np.array([3, 50, 700, 2000]), np.array([40, 9, 10, 3])
    take = mixing.fitted(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert abs(int((take * lengths).sum()) - min(budget, int((lengths * counts).sum()))) <= 2


TURNS = [
    (1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "<next>&amp;<turn:user>"), (1, 2, "assistant", None), (1, 3, "assistant", "é\n</turn>\n"),
    (2, 5, None, "x"), (2, None, "assistant", ""), (3, 0, "a>b<c&", "t"), (None, 1, "user", "lost"), (4, 1, "user", "b"), (4, 1, "assistant", "a"), (5, 0, "assistant", ""),
    (5, 0, "assistant", ""), (6, 0, "user", "long " * 20000),
]


def turns_of(key, rows=TURNS):
    return [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "x", "y") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, t string").repartition(3)
    out = chat.parsed(chat.formatted(df)).collect()
    assert len(out) == len({t[0] for t in TURNS})
    for r in out:
        want = turns_of(r["conv_id"])
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss_texts"] == [t for role, t in want if role == "assistant"]
    one = next(r["formatted"] for r in out if r["conv_id"] == 1)
    assert one.count(chat.OPEN) == 2  # adjacent assistant turns share a block
    assert chat.formatted(df.limit(0)).collect() == []


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.parsed(chat.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_chat_formatting(spark, sf).toPandas().sort_values("conv_id", ignore_index=True)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_chat_formatting"]).df().sort_values("conv_id", ignore_index=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes.to_dict()))
    probe = r"\### Assistant: </turn> ok"
    row = got[got["conv_id"] == -7].iloc[0]
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
