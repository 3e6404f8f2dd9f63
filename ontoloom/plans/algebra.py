"""Set expressions compiled to DataFrame plans.

Each leaf (an extent, a navigation, a projection, a property state) is a table of ids. The domain gets one boolean column per
distinct leaf by existence joins, and the whole expression becomes one boolean column over them, so Catalyst simplifies
it and plans the joins. Every value is clipped to the domain.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import graph as ops
from ontoloom.operators import inherit, terms
from ontoloom.plans.language import STATES, YIELDS, Applied, Combined, Compared, Complement, Concept, Expr, LanguageError, Number, Relation, Whole, parse, parts, type_of, written
from ontoloom.sources.model import COEXTENSION, GENUS, INHERITED, Graph

#: Names of relations (fixed values).
RELATIONS = {"genus": "14", "essential": "15", "attribute": "20", "purpose": "21", "action": "22", "material": "23", "content": "24", "product": "25", "agent": "26", "patient": "27", "coextension": "30"}
SAMPLE = 5


@dataclass
class Algebra:
    graph: Graph
    context: int = 1
    lang: str | None = None
    #: Ways up from single concepts, tables that were written when a trace first asked for them.
    ways: dict[tuple[int, bool], DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def compile(self, source: str, field: str = "expression") -> Expr:
        """Parse, check types and resolve every reference and relation before anything is computed."""
        try:
            tree = parse(source)
            type_of(tree, source)
            return self._resolved(tree, source)
        except LanguageError as e:
            e.field = field
            raise

    def _resolved(self, e: Expr, source: str) -> Expr:
        match e:
            case Concept():
                return Concept(e.span, id=self._concept(e, source))
            case Complement():
                return replace(e, operand=self._resolved(e.operand, source))
            case Combined() | Compared():
                return replace(e, left=self._resolved(e.left, source), right=self._resolved(e.right, source))
            case Applied():
                relation = self._relation(e.relation, source, e.name in STATES) if e.relation else None
                return replace(e, relation=relation, operands=tuple(self._resolved(x, source) for x in e.operands))
        return e

    def _concept(self, e: Concept, source: str) -> int:
        if e.id is not None:
            found = self.graph.concept.filter(F.col("id") == e.id).select("id")
        else:
            found = terms.resolved(self.graph, e.term, e.lang or self.lang)
        ids = sorted(r["id"] for r in found.limit(50).collect())
        if len(ids) != 1:
            raise LanguageError(f"{'ambiguous' if ids else 'unknown'} concept {e.term or e.id!r}", source, e.span, tuple(ids))
        return ids[0]

    def _relation(self, e: Relation, source: str, inherits: bool) -> Relation:
        code = RELATIONS.get(e.name, e.name)
        rows = {r["code"]: r["name"] for r in self.graph.rule.collect()}  # the grammar has a few dozen codes
        if code not in rows and code not in RELATIONS.values():
            named = [c for c, name in rows.items() if name == e.name]
            if len(named) != 1:
                raise LanguageError(f"unknown relation {e.name!r}", source, e.span)
            code = named[0]
        if inherits and code not in INHERITED:
            raise LanguageError(f"relation {code} does not inherit", source, e.span)
        return replace(e, found=code)

    def leaf(self, e: Expr, domain: DataFrame) -> DataFrame:
        """The ids of an expression that is no Boolean combination, before clipping."""
        g, c = self.graph, self.context
        if isinstance(e, Concept):
            return ops.extents(g, self._one(e.id), c).select("id").distinct()
        first = e.operands[0]
        if e.name == "exact":
            return self._one(first.id)
        if e.name in STATES:
            return inherit.states(g, e.relation.found, first.id, c, domain).filter(F.col("state") == STATES[e.name]).select("id")
        if e.relation:
            return ops.project(g, e.relation.found, self.ids(first, domain), e.name == "subjects", c)
        return ops.navigate(g, self.ids(first, domain), e.name, c)

    def _one(self, i: int) -> DataFrame:
        return self.graph.spark.range(i, i + 1).select("id")

    def flags(self, trees: list[Expr], domain: DataFrame, only: int | None = None) -> tuple[DataFrame, list[Column]]:
        """The domain with a column for each distinct leaf of the trees, and each tree as a Boolean column. only: of the domain this one concept;
        whether an extent holds it is found upwards from it, whatever the extent's size."""
        names: dict[str, str] = {}
        df = domain.select("id") if only is None else domain.filter(F.col("id") == only).select("id")
        up = None if only is None or not any(isinstance(x, Concept) for t in trees for x in _nodes(t)) else ops.holders(self.graph, self._one(only), self.context)

        def column(e: Expr) -> Column:
            nonlocal df
            match e:
                case Whole():
                    return F.lit(e.full)
                case Complement():
                    return ~column(e.operand)
                case Combined():
                    a, b = column(e.left), column(e.right)
                    return {"|": a | b, "&": a & b, "-": a & ~b, "^": a != b}[e.sign]
            text = written(e)
            if text not in names:
                names[text] = f"leaf{len(names)}"
                ids = up.filter(F.col("seed") == e.id).select("id") if up is not None and isinstance(e, Concept) else self.leaf(e, domain)
                df = df.join(ids.distinct().withColumn(names[text], F.lit(True)), "id", "left")
            return F.coalesce(F.col(names[text]), F.lit(False))

        columns = [column(t) for t in trees]  # joins the leaves to df
        return df, columns

    def ids(self, e: Expr, domain: DataFrame) -> DataFrame:
        df, (c,) = self.flags([e], domain)
        return df.filter(c).select("id")

    def domain(self, within: str | None) -> DataFrame:
        full = self.graph.concept.select("id")
        if within is None:
            return full
        e = self.compile(within, "within")
        if type_of(e) != "set":
            raise LanguageError("a domain is a set", within, e.span, field="within")
        return self.ids(e, full)

    def set(self, source: str, within: str | None = None) -> DataFrame:
        """The members (id) of a set expression."""
        e = self.compile(source)
        if type_of(e) != "set":
            raise LanguageError("the expression is not a set", source, e.span)
        return self.ids(e, self.domain(within))

    def value(self, source: str, within: str | None = None) -> DataFrame:
        """One row (value): of a count, a comparison, empty() or disjoint()."""
        return self._scalar(self.compile(source), self.domain(within))

    def _scalar(self, e: Expr, domain: DataFrame) -> DataFrame:
        spark = self.graph.spark
        if isinstance(e, Number):
            return spark.range(1).select(F.lit(e.value).cast("long").alias("value"))
        if isinstance(e, Applied):
            df, cs = self.flags(list(e.operands), domain)
            both = F.count_if(cs[0] if len(cs) == 1 else cs[0] & cs[1])
            return df.agg((both if e.name == "count" else both == 0).alias("value"))
        if type_of(e.left) != "set":
            a, b = (self._scalar(x, domain).withColumnRenamed("value", k) for x, k in ((e.left, "x"), (e.right, "y")))
            return a.crossJoin(b).select(_compared(e.sign, F.col("x"), F.col("y")).alias("value"))  # one row each
        df, (a, b) = self.flags([e.left, e.right], domain)
        left, right = F.count_if(a & ~b), F.count_if(b & ~a)
        out = {"==": (left == 0) & (right == 0), "!=": (left > 0) | (right > 0), "<=": left == 0, "<": (left == 0) & (right > 0), ">=": right == 0, ">": (right == 0) & (left > 0)}
        return df.agg(out[e.sign].alias("value"))

    def regions(self, source: str, within: str | None = None, sample: int = SAMPLE) -> DataFrame:
        """Diagnostics: (region, members, counterexample, sample, truncated). Of a comparison of sets or disjoint(): the three regions
        of its operands; of count() or empty(): the one region of its operand; of a comparison of numbers: the sets that its
        operands count, left_counted and right_counted."""
        e = self.compile(source)
        domain = self.domain(within)
        if isinstance(e, Compared) and type_of(e.left) == "int":
            counted = [(name, x.operands[0]) for name, x in (("left_counted", e.left), ("right_counted", e.right)) if isinstance(x, Applied)]
            if not counted:
                raise LanguageError("a comparison of plain numbers has no regions", source, e.span)
            df, cs = self.flags([x for _, x in counted], domain)
            names, wrong = [n for n, _ in counted], []
            inside = df.select("id", F.explode(F.array_compact(F.array(*(F.when(c, n) for c, n in zip(cs, names, strict=True))))).alias("region"))
        else:
            if not isinstance(e, Compared) and not (isinstance(e, Applied) and e.name in YIELDS) or type_of(parts(e)[0]) != "set":
                raise LanguageError("only a comparison, count, empty or disjoint has regions", source, e.span)
            df, cs = self.flags(list(parts(e)), domain)
            if len(cs) == 1:
                names, region, wrong = ["operand"], F.when(cs[0], "operand"), ["operand"] if e.name == "empty" else []
            else:
                a, b = cs
                names = ["left_only", "intersection", "right_only"]
                region = F.when(a & ~b, "left_only").when(a & b, "intersection").when(b & ~a, "right_only")
                sign = e.sign if isinstance(e, Compared) else e.name
                wrong = {"<=": ["left_only"], "<": ["left_only"], ">=": ["right_only"], ">": ["right_only"], "==": ["left_only", "right_only"], "disjoint": ["intersection"]}.get(sign, [])
            inside = df.select("id", region.alias("region")).filter("region is not null")
        base = self.graph.spark.createDataFrame([(x, x in wrong) for x in names], "region string, wrong boolean")
        members = F.coalesce("members", F.lit(0))
        found = base.join(sampled(inside, "region", sample), "region", "left")
        return found.select("region", members.alias("members"), (F.col("wrong") & (members > 0)).alias("counterexample"), F.coalesce("sample", F.lit("")).alias("sample"), (members > sample).alias("truncated"))

    def explain(self, source: str, concept: int, within: str | None = None) -> dict:
        """The trace of an expression for one concept, a record for each part of the expression.

        A set: expression, member, and by what it is: path (of a concept's extent: the edges that lead up to it, None if there
        are none; of a navigation: from or to the least seed that has one), edges (of a projection), fact (of a property state),
        record_id (of exact), operands (of set operations). Anything else: expression, kind, value, operands. Memberships and
        evidence are found for the one concept alone."""
        e = self.compile(source)
        domain = self.domain(within)
        nodes = [x for x in _nodes(e) if type_of(x) == "set"]
        df, cs = self.flags(nodes, domain, concept)
        row = df.select("id", *[c.alias(f"n{k}") for k, c in enumerate(cs)]).collect()
        held = {id(x): bool(row and row[0][f"n{k}"]) for k, x in enumerate(nodes)}
        return self._trace(e, concept, domain, held, bool(row)) | {"concept": concept, "in_domain": bool(row)}

    def _trace(self, e: Expr, concept: int, domain: DataFrame, held: dict[int, bool], inside: bool) -> dict:
        below = lambda: [self._trace(x, concept, domain, held, inside) for x in parts(e)]
        if id(e) not in held:
            value = e.value if isinstance(e, Number) else self._scalar(e, domain).first()["value"]
            out = {"expression": written(e), "kind": "bool" if isinstance(value, bool) else "int", "value": value}
            return out | ({"operands": below()} if parts(e) else {})
        out = {"expression": written(e), "member": held[id(e)]}
        match e:
            case Concept():
                return out | {"path": self._path(concept, e.id, coextension=True) if inside else None}
            case Complement() | Combined():
                return out | {"operands": below()}
            case Applied(name="exact"):
                return out | {"record_id": e.operands[0].id}
            case Applied() if e.name in STATES:
                return out | {"fact": inherit.explained(self.graph, concept, e.relation.found, e.operands[0].id, self.context)}
            case Applied() if e.relation:
                own, other = ("target", "subject") if e.name == "related" else ("subject", "target")
                found = ops.visible(self.graph, self.context).filter((F.col("code") == e.relation.found) & (F.col(own) == concept))
                found = found.join(self.ids(e.operands[0], domain).withColumnRenamed("id", other), other, "left_semi")
                return out | {"edges": ops.edge_records(self.graph, [r["id"] for r in found.select("id").distinct().collect()])}
            case Applied():
                return out | {"path": self._way(e, concept, domain)}
        return out

    def _path(self, low: int, high: int, coextension: bool = False) -> list[dict] | None:
        """The edges of the path from one concept up to another; None if there is none."""
        if (low, coextension) not in self.ways:
            self.ways[low, coextension] = ops.witness_paths(self.graph, self.context, self._one(low), coextension)
        found = self.ways[low, coextension].filter(F.col("ancestor") == high).select("edges").collect()
        return ops.edge_records(self.graph, list(found[0]["edges"]), (GENUS, COEXTENSION)) if found else None

    def _way(self, e: Applied, concept: int, domain: DataFrame) -> list[dict] | None:
        """Of a navigation the genus path between the concept and the least seed that has one; of one step for parents and children."""
        up, one_step = e.name in ("parents", "ancestors"), e.name in ("parents", "children")
        seeds = self.ids(e.operands[0], domain).select(F.col("id").alias("seed"))
        if one_step:
            links = ops.genus_step(self.graph, self.context).toDF("low", "high")
        else:
            links = ops.closure(self.graph, self.context).toDF("low", "high")
        near, far = ("high", "low") if up else ("low", "high")
        found = links.filter((F.col(near) == concept) & (F.col("low") != F.col("high"))).join(seeds, F.col(far) == F.col("seed")).agg(F.min("seed").alias("seed")).first()["seed"]
        if found is None:
            return None
        low, high = (found, concept) if up else (concept, found)
        return self._path(low, high)


def _nodes(e: Expr) -> list[Expr]:
    return [e, *(n for p in parts(e) for n in _nodes(p))]


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<=": a <= b, "<": a < b, ">=": a >= b, ">": a > b}[op]


def sampled(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, id) to (key, members, sample): how many, and the first ids in order as text. Each task keeps its least ids of a key."""
    least = F.slice(F.array_sort(F.collect_list("id")), 1, size)
    # two steps, so that no key's ids are gathered whole: first by hash parts, then of what each part keeps
    part = df.groupBy(key, F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), least.alias("ids"))
    return part.groupBy(key).agg(F.sum("n").alias("members"), ops.joined_ids(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, size)).alias("sample"))


def page(ids: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of ids in order with the total: (id, total, has_more, truncated); truncated: there are rows that the page does not hold."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are not negative")
    total = ids.agg(F.count("*").alias("total"))
    rows = ids.orderBy("id").offset(offset).limit(limit)
    held = F.least(F.greatest(F.col("total") - offset, F.lit(0)), F.lit(limit))
    paged = rows.crossJoin(F.broadcast(total))  # total is one row
    return paged.withColumn("has_more", F.col("total") > offset + limit).withColumn("truncated", held < F.col("total"))
