from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, token string, size string, rank string, u string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "to", "mi", "ren", "sol", "ved", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Rows with copies, near copies, shared passages and lines, and every awkward kind of value."""
    rng = random.Random(7)
    passage, line = prose(rng, 40), "All rights to this line are reserved by nobody at all."
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    texts: list[str | None] = list(base)
    texts += [base[3], base[3], base[4]]
    for k in range(12):  # near copies: a word or two differ
        w = base[5].split()
        w[k] = "other"
        texts.append(" ".join(w))
    texts += [base[k] + " " + passage + " " + prose(rng, 30) for k in range(6, 12)]
    texts += [prose(rng, 20) + "\n" + line + "\n" + prose(rng, 20) for _ in range(6)]
    texts += [prose(rng, 20) + "\n" + line.replace("nobody", "anybody") + "\nshort\n" for _ in range(2)]
    texts += [None, None, "", "", " \n\t ", "one", "one", "two words", "a b c d", "a b c d", "A B C D", "12 34 !!", prose(rng, 5000), "x" * 30000, "ein wort und noch eins mehr hier", "  double  blanks   and tabs\t\tin  here  ok ", "<|endoftext|> is <turn:user>text</turn> & so on"]
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s1", "s1", "s2", None]), 0, "k", "s", "t", "z", "r", "u") for i, t in enumerate(texts)]
    rows.append((None, base[3], None, None, None, *"kstzru"))
    rows.append((None, None, None, None, None, *"kstzru"))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
