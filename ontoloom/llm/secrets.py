"""Secret scans by grammar inference: the formats of credentials are learned from the ones that plain patterns find.

One pass over the texts finds the spans of three plain patterns and every other long token. A bounded sample of the credentials found
so, labelled by their pattern, and one of ordinary long tokens become prefix trees. In each tree, states whose continuations and ends are
equally frequent by Hoeffding's bound, all the way down, are merged (the least state first), which leaves a probabilistic automaton of
each format. Then every token is scored: by its likelihood a character under the best format, and by how much likelier that format is than
ordinary tokens. Tokens that fit a format as well as labelled credentials that were not learned from do are added to the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.shared import Tables, batches, ship

#: The plain patterns, in the order of their kinds, with the group that holds the credential and its least length (fixed values).
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
#: The kind of spans that only an automaton finds; it comes after the others.
INFERRED = "format"
ORDINARY = "ordinary"
TOKEN = "[A-Za-z0-9+/_.=-]"
#: Characters that a token can have (fixed by the pattern) and its end.
SYMBOLS = 68


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the plain patterns' matches, leftmost and not overlapping within a kind, by start, then kind."""
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), place, kind, m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(found)]


def tokens(text: str, base: list[tuple], pattern: re.Pattern, least: int) -> list[tuple[int, int, str]]:
    """(start, end, token) of long tokens, without the full stops around them, that overlap no plain span."""
    out, taken, k = [], sorted((s, e) for _, s, e, _ in base), 0
    for m in pattern.finditer(text):
        token = m.group().strip(".")
        start = m.start() + m.group().index(token)
        end = start + len(token)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= least and (k == len(taken) or taken[k][0] >= end):
            out.append((start, end, token))
    return out


@dataclass
class Automaton:
    """States with how often each was met and ended in, and for each symbol the next state and how often it was taken."""

    met: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    to: list[dict[str, int]] = field(default_factory=list)
    taken: list[dict[str, int]] = field(default_factory=list)

    def state(self) -> int:
        for x, new in ((self.met, 0), (self.ends, 0), (self.to, {}), (self.taken, {})):
            x.append(new)
        return len(self.met) - 1

    @classmethod
    def inferred(cls, values: list[str], alpha: float = 0.05) -> Automaton:
        """The prefix tree of the values with its compatible states merged."""
        tree = cls()
        tree.state()
        for value in values:
            at = 0
            tree.met[0] += 1
            for c in value:
                if c not in tree.to[at]:
                    tree.to[at][c] = tree.state()
                tree.taken[at][c] = tree.taken[at].get(c, 0) + 1
                at = tree.to[at][c]
                tree.met[at] += 1
            tree.ends[at] += 1
        return tree.merged(math.sqrt(0.5 * math.log(2 / alpha)))

    def merged(self, bound: float) -> Automaton:
        kept, waiting = [0], [(0, c) for c in sorted(self.to[0])]
        while waiting:
            source, c = waiting.pop(0)
            new = self.to[source][c]
            if new in kept:
                continue
            like = next((k for k in kept if self.alike(k, new, bound)), None)
            if like is None:
                kept.append(new)
                waiting += [(new, x) for x in sorted(self.to[new])]
                continue
            self.to[source][c] = like
            self.fold(like, new)
            known = set(waiting)
            waiting += [(k, x) for k in kept for x in sorted(self.to[k]) if self.to[k][x] not in kept and (k, x) not in known]
        out, place = Automaton(), {k: i for i, k in enumerate(kept)}
        for k in kept:
            i = out.state()
            out.met[i], out.ends[i], out.taken[i] = self.met[k], self.ends[k], dict(self.taken[k])
            out.to[i] = {c: place[t] for c, t in self.to[k].items()}
        return out

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether two states end and go on alike; b stands in the tree, so this ends."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            n, m = self.met[a], self.met[b]
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most < 1:
                if abs(self.ends[a] / n - self.ends[b] / m) > most:
                    return False
                x, y = self.taken[a], self.taken[b]
                if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > most for c in x.keys() | y.keys()):
                    return False
            work += [(self.to[a][c], t) for c, t in self.to[b].items() if c in self.to[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Put the tree below b into a."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            self.met[a] += self.met[b]
            self.ends[a] += self.ends[b]
            for c, t in self.to[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + self.taken[b][c]
                if c in self.to[a]:
                    work.append((self.to[a][c], t))
                else:
                    self.to[a][c] = t

    def likelihood(self, value: str) -> float:
        """Log probability of a value and its end; what a state has not met shares half a count, and leads to even odds."""
        total, at = 0.0, 0
        for i, c in enumerate(value):
            n = self.met[at] + 0.5
            total += math.log((self.taken[at].get(c, 0) + 0.5 / SYMBOLS) / n)
            if c not in self.to[at]:
                return total - (len(value) - i) * math.log(SYMBOLS)
            at = self.to[at][c]
        return total + math.log((self.ends[at] + 0.5 / SYMBOLS) / (self.met[at] + 0.5))

    def table(self) -> list[tuple[int, int, int, str, int, int]]:
        return [(i, self.met[i], self.ends[i], c, self.to[i][c], self.taken[i][c]) for i in range(len(self.met)) for c in self.to[i]] + [(i, self.met[i], self.ends[i], "", 0, 0) for i in range(len(self.met))]

    @classmethod
    def of(cls, rows: list) -> Automaton:
        out = cls()
        for _ in range(1 + max(r["state"] for r in rows)):
            out.state()
        for r in rows:
            out.met[r["state"]], out.ends[r["state"]] = r["met"], r["ends"]
            if r["symbol"]:
                out.to[r["state"]][r["symbol"]], out.taken[r["state"]][r["symbol"]] = r["to"], r["taken"]
        return out


@dataclass
class Grammar:
    """The automata of formats with the least likelihood a character that each asks for, and that of ordinary tokens."""

    formats: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None
    odds: float

    def score(self, token: str) -> tuple[float, float]:
        """(how far above its bound the best format's likelihood a character is, log odds of it against ordinary tokens)."""
        if not self.formats:
            return -math.inf, -math.inf
        plain = self.ordinary.likelihood(token) if self.ordinary else -(len(token) + 1) * math.log(SYMBOLS)
        each = [(x, x / (len(token) + 1) - least) for a, least in self.formats.values() for x in [a.likelihood(token)]]
        fit, above = max(each)
        return above, fit - plain

    def fits(self, token: str) -> bool:
        above, odds = self.score(token)
        return above >= 0 and odds >= self.odds


def found(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(doc_id, base: kind, start, end, value; other: start, end, token) of every row's whole text. Values longer than longest are null."""
    spark = docs.sparkSession
    ship(spark)
    pattern = re.compile(f"{TOKEN}{{{least},}}")
    span = [("start", pa.int64()), ("end", pa.int64())]
    kinds = [pa.list_(pa.struct([("kind", pa.string()), *span, ("value", pa.string())])), pa.list_(pa.struct([*span, ("token", pa.string())]))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            base, other = [], []
            for text in pc.fill_null(b.column("text"), "").to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e, "value": v if len(v) <= longest else None} for k, s, e, v in spans])
                other.append([{"start": s, "end": e, "token": t} for s, e, t in tokens(text, spans, pattern, least)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kinds[0]), pa.array(other, kinds[1])], ["doc_id", "base", "other"])

    schema = "doc_id long, base array<struct<kind: string, start: long, end: long, value: string>>, other array<struct<start: long, end: long, token: string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fit(spans: DataFrame, most: int = 600, longest: int = 200, odds: float = math.log(1000), seed: int = 12) -> Grammar:
    """Automata of what found() has: of each kind at most ``most`` distinct credentials of at most ``longest`` characters, and as many
    ordinary tokens, those of the least hashes. Four fifths of the credentials are learned from; a token must have the likelihood a
    character of the other fifth, less four deviations. A kind with fewer than five values is not learned."""
    labelled = spans.select(F.explode("base").alias("s")).select("s.kind", "s.value").filter("value is not null")
    plain = spans.select(F.explode("other").alias("s")).select(F.lit(ORDINARY).alias("kind"), F.col("s.token").alias("value")).filter(F.length("value") <= longest)
    pool = labelled.union(plain).groupBy("kind", "value").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "kind", "value"))
    pool = Tables(spans.sparkSession).write(pool)
    picked = None
    for kind in (*PATTERNS, ORDINARY):
        part = pool.filter(F.col("kind") == kind).orderBy("h", "value").limit(most).select("kind", "value", "h")
        picked = part if picked is None else picked.union(part)

    def learned(values: pd.DataFrame) -> pd.DataFrame:
        rows = values.sort_values(["h", "value"])
        kind, values_ = rows["kind"].iloc[0], rows["value"].tolist()
        kept = values_ if kind == ORDINARY else [v for i, v in enumerate(values_) if i % 5]
        made = Automaton.inferred(kept)
        held = [made.likelihood(v) / (len(v) + 1) for v in values_[::5]]
        out = pd.DataFrame(made.table(), columns=["state", "met", "ends", "symbol", "to", "taken"])
        return out.assign(kind=kind, least=float(np.mean(held) - 4 * np.std(held)), values=len(values_))

    rows = picked.groupBy("kind").applyInPandas(learned, "state long, met long, ends long, symbol string, to long, taken long, kind string, least double, values long").collect()  # bounded by the samples
    made = {k: [r for r in rows if r["kind"] == k] for k in {r["kind"] for r in rows if r["values"] >= 5}}
    return Grammar({k: (Automaton.of(r), r[0]["least"]) for k, r in sorted(made.items()) if k != ORDINARY}, Automaton.of(made[ORDINARY]) if ORDINARY in made else None, odds)


def scanned(docs: DataFrame, least: int = 16, most: int = 600, longest: int = 200) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs: doc_id, text; other columns are not read. Counts and base_sha256 are of the plain patterns' spans, kind:start:end in code
    points by start, then kind, joined by commas. spans has those and, of the kind ``format``, the spans of tokens of at least ``least``
    characters that the automata take for credentials and that overlap no plain span.

    Texts are scanned whole, however long. A null or empty text has no spans. Repeated rows, repeated ids and a null doc_id are rows like
    others; spans of one start are in the order assign, access, hex, format. Without labelled credentials nothing is added to the plain
    spans. No rows: no rows. What is learned from is bounded by ``most`` values a kind, of at most ``longest`` characters.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    spans = tables.write(found(docs, least, longest))
    shared = spark.sparkContext.broadcast(fit(spans, most, longest))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, grammar, known = list(PATTERNS), shared.value, {}
        for b in batches(it):
            out: list[tuple] = []
            for base, other in zip(b.column("base").to_pylist(), b.column("other").to_pylist(), strict=True):
                told = [f"{s['kind']}:{s['start']}:{s['end']}" for s in base]
                rows = [(s["start"], kinds.index(s["kind"]), text) for s, text in zip(base, told, strict=True)]
                for t in other:
                    if len(known) > 100_000:
                        known.clear()
                    if t["token"] not in known:
                        known[t["token"]] = grammar.fits(t["token"])
                    if known[t["token"]]:
                        rows.append((t["start"], len(kinds), f"{INFERRED}:{t['start']}:{t['end']}"))
                count = [sum(s["kind"] == k for s in base) for k in kinds]
                out.append((*count, hashlib.sha256(",".join(told).encode()).hexdigest(), ",".join(x for *_, x in sorted(rows))))
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    return spans.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
