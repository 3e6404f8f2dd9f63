"""Quality classifier and language identification: held-out accuracy, ranges and awkward rows."""

from __future__ import annotations

import numpy as np
import pytest

from ontoloom.llm import language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(tables):
    docs, labels = tables
    out = quality.classified(docs, labels).join(labels, "doc_id").toPandas()
    test = out[out["held_out"]]
    assert out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    assert (test["predicted"] == test["quality"]).mean() >= 0.9


def test_quality_awkward(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7), (10**9, 1)], "doc_id long, quality int")
    out = quality.classified(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert quality.classified(no_docs, labels).collect() == []
    none = quality.classified(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality.scored(docs, quality.fit(docs, labels))
    assert set(docs.columns) <= set(kept.columns) and kept.count() == len(rows)


def test_quality_against_plain_fit(tables):
    """Ridge weights and calibration levels of the table by a plain solution and a plain isotonic fit."""
    docs, labels = tables
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], float(r["quality"])) for r in labels.collect() if r["doc_id"] in texts and r["quality"] in (0, 1)]
    x, y = np.array([quality.statistics(texts[i]) for i, _ in rows]), np.array([v for _, v in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = np.cos(np.clip((x - model.mean) / model.scale, -6, 6) @ model.frequencies + model.phases) * np.sqrt(2 / quality.FEATURES)
    z = np.hstack([z, np.ones((len(z), 1))])
    fitted = lambda keep: np.linalg.lstsq(np.vstack([z[keep], np.sqrt(1e-2 * max(1, keep.sum() / 1000)) * np.eye(z.shape[1])]), np.concatenate([y[keep], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weights, fitted(np.ones(len(y), bool)), atol=1e-6)
    ids = docs.sparkSession.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 2) as int) as fold").collect()
    fold = np.array([dict(map(tuple, ids))[i] for i, _ in rows])
    s = np.where(fold == 0, z @ fitted(fold == 1), z @ fitted(fold == 0))
    at = np.clip(np.floor((s + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    bins = [at == k for k in sorted(set(at))]
    w = np.array([b.sum() + 0.5 for b in bins])
    v = np.array([(y[b].sum() + 0.5 * y.mean()) for b in bins]) / w
    mean = lambda i, j: (v[i:j] * w[i:j]).sum() / w[i:j].sum()
    plain = [max(min(mean(i, j) for j in range(k + 1, len(v) + 1)) for i in range(k + 1)) for k in range(len(v))]
    assert np.allclose(model.edges, [s[b].mean() for b in bins], atol=1e-6) and np.allclose(model.levels, plain, atol=1e-9)


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 3.0, 2.0, 5.0, 4.0]), np.ones(5))
    assert got.tolist() == [1.0, 2.5, 2.5, 4.5, 4.5]


def test_statistics_size():
    assert len(quality.statistics("Some words, and more.\nA line")) == quality.N_STATISTICS == len(quality.statistics(None))


def test_language_held_out(tables):
    docs, _ = tables
    out = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert out["score"].between(0, 1).all()
    test = out[out["held_out"] & out["lang"].notna()]
    assert (test["lang_pred"] == test["lang"]).mean() >= 0.95


def test_language_awkward(docs, no_docs, rows):
    out = {r["doc_id"]: r for r in language.identified(docs).collect()}
    assert len(out) == len({r[0] for r in rows})
    for i, t, *_ in rows:
        if i is not None:
            letters = any(c.isalpha() for c in t or "")
            assert out[i]["lang_pred"] in ({"aa", "bb"} if letters else {"und"})
    assert language.identified(no_docs).collect() == []


def test_backoff_prefers_words_then_longer_grams():
    logs = lambda *rows: np.log(np.array(rows))
    m = language.Model(["a", "b"], {"ok": 0}, logs((0.9, 0.1)), {"o": 0, "k": 1, "ko": 2}, logs((0.1, 0.9), (0.1, 0.9), (0.8, 0.2)))
    assert m.predict(["ok", "o", "", "12 !", None, "ko", "xyz"])[0] == ["a", "b", "und", "und", "und", "b", "a"]
    assert m.predict(["ok"])[1][0] == pytest.approx(0.9) and m.predict(["o ok"])[1][0] == pytest.approx(0.5)


def test_numerals_are_no_letters(spark):
    assert language.letters("x² ½ Ⅷ a1b2 É_é") == ["x", "a", "b", "é", "é"]
    rows = [(i, "the one and the other", "en") for i in range(30)] + [(100, "² ½", "en"), (101, "", "en"), (102, "٣ ⅷ ①", None)]
    got = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102)) and got[0]["lang_pred"] == "en"


def test_language_against_plain_counts(spark):
    """The table's rows predicted by a plain version of the same rule."""
    import math
    import zlib
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in language.letters(t):
                words[lang][w] += 1
                for n in range(1, 6):
                    for k in range(len(w) + 3 - n):
                        grams[lang, n][f" {w} "[k : k + n]] += 1
    langs = sorted(words)

    def logs(counts: dict, least: int) -> dict:
        names = {x for c in counts.values() for x, n in c.items() if n >= least}
        kept = {lang: Counter({x: n for x, n in counts[lang].items() if n >= least}) for lang in langs}
        size = {lang: sum(kept[lang].values()) + 0.5 * max(1, len(names)) for lang in langs}
        return {x: [math.log((kept[lang][x] + 0.5) / size[lang]) for lang in langs] for x in names}

    known, parts = logs(words, 2), {n: logs({lang: grams[lang, n] for lang in langs}, 5) for n in range(1, 6)}

    def scored(w: str) -> list[float]:
        if w in known:
            return known[w]
        hits = []
        for k in range(len(w) + 2):
            at = [parts[n][x] for n in range(5, 0, -1) if len(x := f" {w} "[k : k + n]) == n and x in parts[n]]
            hits += at[:1]
        return [sum(h[j] for h in hits) / max(1, len(hits)) for j in range(len(langs))]

    got = {r["doc_id"]: r for r in language.identified(docs).collect()}
    for i, t, _ in rows:
        found = language.letters(t)
        if not found:
            assert got[i]["lang_pred"] == "und"
            continue
        total = [sum(x) for x in zip(*map(scored, found), strict=True)]
        p = [math.exp(x - max(total)) for x in total]
        assert got[i]["lang_pred"] == langs[p.index(max(p))] and got[i]["score"] == pytest.approx(max(p) / sum(p), abs=1e-6)
