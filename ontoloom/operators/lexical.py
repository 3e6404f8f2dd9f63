"""Lexical work over many forms: groups of verbs, pairs of verbs and nouns, frequencies of lemmas, batches of facts.

Forms meet under keys that the rules imply (a beginning, a stem, a candidate form), never pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import batch as changes
from ontoloom.operators import graph as ops
from ontoloom.operators import terms
from ontoloom.plans.tables import materialized
from ontoloom.sources.model import GENUS, Graph

# Fixed values of the Russian word rules: reflexive endings, endings of infinitives, suffixes of verbal nouns.
REFLEXIVE = "(ся|сь)$"
NO_INFINITIVE = ("ость", "есть", "ность", "тость")
INFINITIVE = ("ться", "тись", "чься", "ить", "ать", "ять", "еть", "уть", "ти", "чь", "ть")
STEM_ENDS = ("ивать", "ывать", "овать", "евать", "ать", "ять", "еть", "ить", "уть", "ти", "чь", "ть")
NOUN_ENDS = ("ование", "евание", "ирование", "ение", "ание", "тие", "ство")
LONG_ENDS = ("ироваться", "оваться", "еваться", "ировать", "ивать", "ывать", "овать", "евать", "аться", "иться", "еться", "уться", "яться", "ать", "ять", "ить", "еть", "уть", "ти", "чь")
DEVERBAL = ("ирование", "ование", "евание", "ствование", "ение", "ание", "тие", "ствие", "ация", "яция", "истика", "ство", "ьба", "ость", "ие")
HIGH = ("сущее", "предмет", "вещь", "свойство", "явление", "действие", "процесс", "отношение", "состояние", "событие")
CONCRETE = ("вещь", "предмет", "часть тела", "организм", "вещество", "артефакт", "деталь", "природный объект")


def _ends(c: Column, ends: tuple[str, ...]) -> Column:
    return c.rlike(f"(?:{'|'.join(ends)})$")


def is_infinitive(c: Column) -> Column:
    """By its ending alone; names of several words or with a hyphen are none."""
    return ~c.rlike("[ -]") & ~_ends(c, NO_INFINITIVE) & _ends(c, INFINITIVE)


def _cut(c: Column, ends: tuple[str, ...], least: int) -> Column:
    """Without the first of the endings that leaves at least so many letters."""
    out = F.when(F.lit(False), c)
    for e in ends:
        out = out.when(c.endswith(e) & (F.length(c) - len(e) >= least), F.left(c, F.length(c) - len(e)))
    return out.otherwise(c)


def verb_stem(c: Column) -> Column:
    return _cut(F.regexp_replace(c, REFLEXIVE, ""), STEM_ENDS, 3)


def noun_stem(c: Column) -> Column:
    return _cut(c, NOUN_ENDS, 3)


def verb_groups(forms: DataFrame, hints: DataFrame, excluded: DataFrame, least: int = 5) -> DataFrame:
    """forms (form), hints (form, canon), excluded (form) to (form, grp): forms in order of their stems are one group as long as neighbours
    share at least so many first letters; hints tie forms to a canonical name, and so groups to each other. grp is the least member of
    the group; canonical names count as members and are written with a leading @.

    Of forms in order all that share a beginning stand together, so the chains are the sets of forms of one beginning: a group by it, with
    no order over all forms and no window. Shorter stems chain with nothing. Excluded forms take part by their hints alone; forms in no
    chain and without hint stand alone."""
    f = forms.select("form").distinct().withColumn("stem", F.regexp_replace("form", REFLEXIVE, ""))
    chain = f.join(excluded.select("form").distinct(), "form", "left_anti").filter(F.length("stem") >= least).withColumn("k", F.left("stem", F.lit(least)))
    first = chain.groupBy("k").agg(F.min("form").alias("first"))
    links = chain.join(first, "k").select(F.col("form").alias("a"), F.col("first").alias("b"))
    tied = hints.join(f.select("form"), "form", "left_semi").select(F.col("form").alias("a"), F.concat(F.lit("@"), "canon").alias("b"))
    group = ops.components(links.union(tied)).withColumnsRenamed({"id": "form", "component": "grp"})
    return f.select("form").join(group, "form", "left").select("form", F.coalesce("grp", "form").alias("grp"))


def verb_noun_pairs(g: Graph, manual: DataFrame | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(verb, noun, source): for concepts named by an infinitive the concept named by a noun of the same stem. source: manual (verb, noun
    are names that a table gives), sibling (the only such child of a common parent), stem (the only such verbal noun of all); with a null
    noun: ambiguous (several), children (a verb that is itself a genus). A verb that has a better source is not looked up in a worse one."""
    c = g.concept.select("id", "name")
    ok = g.edge.filter((F.col("status") == "ok") & (F.col("code") == GENUS)).select(F.col("subject").alias("id"), F.col("target").alias("parent")).distinct()
    v = materialized(c.filter(is_infinitive(F.col("name")) & ~F.col("name").isin(*excluded)).select(F.col("id").alias("verb"), verb_stem(F.col("name")).alias("stem")).filter(F.length("stem") >= 3))
    n = materialized(c.filter(~is_infinitive(F.col("name"))).select(F.col("id").alias("noun"), noun_stem(F.col("name")).alias("stem"), _ends(F.col("name"), NOUN_ENDS).alias("verbal")).filter(F.length("stem") >= 3))
    by = lambda df, source, *key: df.groupBy("verb", *key).agg(F.count("*").alias("n"), F.min("noun").alias("noun")).select("verb", F.when(F.col("n") == 1, F.col("noun")).alias("noun"), F.when(F.col("n") == 1, source).otherwise("ambiguous").alias("source")).distinct()
    named = None
    if manual is not None:
        least = c.groupBy("name").agg(F.min("id").alias("id"))
        named = manual.join(least.toDF("verb", "v"), "verb").join(least.toDF("noun", "n"), "noun").filter("v <> n").select(F.col("v").alias("verb"), F.col("n").alias("noun"), F.lit("manual").alias("source"))
    kin = v.join(ok.toDF("verb", "parent"), "verb").join(n.join(ok.toDF("noun", "parent"), "noun"), ["parent", "stem"])
    kin = by(kin, "sibling", "parent")
    found = materialized(kin if named is None else named.union(kin))
    rest = v.join(found.filter("noun is not null").select("verb").distinct(), "verb", "left_anti")
    wide = by(rest.join(n.filter("verbal"), "stem"), "stem")
    genus = ok.select(F.col("parent").alias("verb")).distinct().withColumn("above", F.lit(True))
    wide = wide.join(genus, "verb", "left").withColumn("above", F.coalesce("above", F.lit(False)) & (F.col("source") == "stem"))
    return found.union(wide.select("verb", F.when(~F.col("above"), F.col("noun")), F.when(F.col("above"), "children").otherwise(F.col("source")))).distinct()


def noun_forms(name: Column) -> Column:
    """An array of the noun forms that an infinitive can have: its stems with the deverbal suffixes and with short endings."""
    bare = F.regexp_replace(name, REFLEXIVE, "")
    stems = [bare]
    for e in LONG_ENDS:
        least = 4 if len(e) >= 4 else 3
        stems.append(F.when(bare.endswith(e) & (F.length(bare) - len(e) >= least), F.left(bare, F.length(bare) - len(e))))
    stems.append(F.when(bare.endswith("вести"), F.concat(F.left(bare, F.length(bare) - 3), F.lit("д"))))
    known = F.filter(F.array_distinct(F.array_compact(F.array(*stems))), lambda s: F.length(s) >= 3)
    short = lambda s: F.when(F.length(s) >= 4, F.array(*[F.concat(s, F.lit(x)) for x in ("а", "я", "ка", "ь")])).otherwise(F.array().cast("array<string>"))
    forms = lambda s: F.concat(F.array(*[F.concat(s, F.lit(x)) for x in DEVERBAL]), short(s), F.when(F.length(s) >= 5, F.array(s)).otherwise(F.array().cast("array<string>")))
    loan = F.when(bare.endswith("ировать") & (F.length(bare) > 9), F.left(bare, F.length(bare) - 8))
    borrowed = F.when(loan.isNotNull(), F.array(loan, F.concat(loan, F.lit("ация")), F.concat(loan, F.lit("ирование")))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.flatten(F.transform(known, forms)), borrowed)), lambda s: F.length(s) >= 3)


def deverbal_rank(name: Column) -> Column:
    """Above 0 for names with a deverbal suffix, most for the first of the list."""
    out = F.when(F.lit(False), 0)
    for i, s in enumerate(DEVERBAL):
        out = out.when(name.endswith(s), 100 - i)
    return out.otherwise(0)


def attested_nouns(g: Graph, excluded: DataFrame | None = None, special: DataFrame | None = None) -> DataFrame:
    """(verb, noun, names, verdict): for each concept named by an infinitive the concepts that bear one of its noun forms: names counts the
    forms that name exactly one concept. verdict: special (a table (verb, noun) of names decides), only (one name), ranked (of several one
    alone is deverbal), ambiguous or none (noun is null). Categories, concrete things without a deverbal suffix and excluded pairs (verb,
    noun: names) are no candidates."""
    c = materialized(g.concept.select("id", "name"))
    up = ops.merged_closure(g, 16).select(F.col("descendant").alias("noun"), F.col("ancestor").alias("a"))
    roots = c.filter(F.col("name").isin(*CONCRETE)).select(F.col("id").alias("a"), F.col("name").alias("root"))
    thing = up.join(roots, "a").select("noun").union(roots.select("a")).distinct().withColumn("thing", F.lit(True))
    v = materialized(c.filter(is_infinitive(F.col("name"))).select(F.col("id").alias("verb"), F.col("name").alias("v")))
    n = c.filter(~is_infinitive(F.col("name")) & ~F.col("name").isin(*HIGH)).select(F.col("id").alias("noun"), F.col("name").alias("n"), deverbal_rank(F.col("name")).alias("rank"))
    n = n.join(thing, "noun", "left").filter("thing is null or rank > 0")
    met = v.select("verb", "v", F.explode(noun_forms(F.col("v"))).alias("n"))
    if special is not None:
        met = met.union(v.join(special.toDF("v", "n"), "v").select("verb", "v", "n")).distinct()
    met = met.join(n.hint("merge"), "n").filter("verb <> noun")  # dozens of forms a verb, which an estimate before the explode leaves out
    if excluded is not None:
        met = met.join(excluded.toDF("v", "n"), ["v", "n"], "left_anti")
    one = met.groupBy("verb", "v", "n").agg(F.countDistinct("noun").alias("k"), F.min("noun").alias("noun"), F.max("rank").alias("rank")).filter("k = 1")
    if special is not None:
        one = one.join(special.toDF("v", "n").distinct().withColumn("told", F.lit(True)), ["v", "n"], "left")
    else:
        one = one.withColumn("told", F.lit(None).cast("boolean"))
    s = one.groupBy("verb").agg(F.count("*").alias("names"), F.min(F.when(F.col("told"), F.col("noun"))).alias("told"), F.count_if(F.col("rank") > 0).alias("deverbal"), F.min("noun").alias("first"), F.min(F.when(F.col("rank") > 0, F.col("noun"))).alias("best"))
    out = v.select("verb").join(s, "verb", "left")
    verdict = F.when(F.col("names").isNull(), "none").when(F.col("told").isNotNull(), "special").when(F.col("names") == 1, "only").when(F.col("deverbal") == 1, "ranked").otherwise("ambiguous")
    out = out.withColumn("verdict", verdict)
    noun = F.when(F.col("verdict") == "special", F.col("told")).when(F.col("verdict") == "only", F.col("first")).when(F.col("verdict") == "ranked", F.col("best"))
    return out.select("verb", noun.alias("noun"), F.coalesce("names", F.lit(0)).cast("long").alias("names"), "verdict")


#: Endings that tell a part of speech where there is no morphology, by language.
TAGS = {
    "NOUN": ("tion", "ness", "ment", "heit", "keit", "ung", "schaft"),
    "ADJF": ("ous", "ful", "able", "ible", "lich", "isch", "eux"),
    "VERB": ("ing", "ize", "ieren", "ern", "ent", "er"),
}


def tagged_words(texts: DataFrame, column: str = "text") -> DataFrame:
    """(lemma, pos, n): the words of all texts that an ending of TAGS gives a part of speech, in lower case, counted by task first."""
    word = F.explode(F.regexp_extract_all(F.lower(column), F.lit("(\\p{L}+)"), F.lit(1)))
    pos = reduce(lambda c, p: c.when(_ends(F.col("lemma"), TAGS[p]), p), TAGS, F)
    return texts.select(word.alias("lemma")).groupBy("lemma").agg(F.count("*").alias("n")).withColumn("pos", pos).filter("pos is not null").select("lemma", "pos", "n")


def lemma_frequencies(words: DataFrame, known: DataFrame, stop: tuple[str, ...] = (), least: int = 4, short: tuple[str, ...] = ()) -> DataFrame:
    """words (lemma, pos, n), known (lemma) to (lemma, pos, n): how often lemmas occur that are not known yet. Where taggings differ, any
    other part of speech comes before VERB (of several the first by name). Stop words are left out, and lemmas of fewer letters, but for
    the short ones that are named. Frequent words are added up by task before they meet."""
    w = words.filter((F.length("lemma") >= least) | F.col("lemma").isin(*short)).filter(~F.col("lemma").isin(*stop))
    w = w.groupBy("lemma").agg(F.sum("n").alias("n"), F.min(F.when(F.col("pos") != "VERB", F.col("pos"))).alias("other")).join(known.select("lemma").distinct(), "lemma", "left_anti")
    return w.select("lemma", F.coalesce("other", F.lit("VERB")).alias("pos"), "n")


def fact_edges(g: Graph, facts: DataFrame, lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """facts (subject, code, target, strength; subject and target are names) to (edges as proposed, reasons (reason, facts)). A name stands
    for the least concept that it names. A fact is accepted, or has one reason: unresolved subject, unresolved target, the first rule that
    it breaks, or repeated (the same edge as another fact of the batch, of which the first by strength stays). The reasons add up to the
    number of facts."""
    numbered = materialized(facts.withColumn("fact", F.monotonically_increasing_id()))
    keys = numbered.select(F.col("subject").alias("word")).union(numbered.select("target")).distinct()
    ids = materialized(terms.first_match(g, keys, lang))
    met = numbered.join(ids.toDF("subject", "s"), "subject", "left").join(ids.toDF("target", "t"), "target", "left")
    home = g.concept.select(F.col("id").alias("s"), "context")
    met = met.join(home, "s", "left").withColumn("unresolved", F.when(F.col("s").isNull(), "unresolved subject").when(F.col("t").isNull(), "unresolved target"))
    asked = met.filter("unresolved is null").select("fact", F.col("s").alias("subject"), "code", F.col("t").alias("target"), "context", F.col("strength").cast("long").alias("strength"))
    asked = materialized(changes.oriented(g, asked).select("fact", *changes.KEY, "strength"))
    first = asked.groupBy(*changes.KEY).agg(F.min(F.struct("strength", "fact")).alias("m")).select(*changes.KEY, F.col("m.strength").alias("strength"), F.col("m.fact").alias("fact"))
    first = materialized(first)
    judged = materialized(changes.validated(g, first.select(*changes.KEY, "strength")))
    verdict = asked.select("fact", *changes.KEY).join(judged.select(*changes.KEY, "verdict"), list(changes.KEY)).join(first.select("fact", F.lit(True).alias("kept")), "fact", "left")
    reason = F.when(F.col("kept") | (F.col("verdict") != "ok"), F.when(F.col("verdict") == "ok", "accepted").otherwise(F.col("verdict"))).otherwise("repeated")
    reasons = met.filter("unresolved is not null").select(F.col("unresolved").alias("reason")).union(verdict.select(reason)).groupBy("reason").agg(F.count("*").alias("facts"))
    new = judged.filter("verdict = 'ok'").select(changes.edge_id().alias("id"), *changes.KEY, "strength", F.lit("ok").alias("status"))
    return new, reasons


# Rules for the parent of a term whose article names none: a pattern over the term and the parent's name, in order (fixed values).
PARENTS = (
    ("compiler", "compiler"), ("interpreter", "program"), ("language", "programming language"), ("framework|library", "software"),
    (r"editor|tool|utility|application|\bide\b|debugger|generator|analyzer|manager|browser", "program"), ("array|list|tree|stack|queue|matrix|table|record|field|structure", "data structure"),
    (r"data type|\btype\b|integer|string|boolean|float|byte|word|number", "data type"), ("error|bug|exception|warning|crash|fault", "error"), ("operator", "operator"),
    ("statement|keyword|directive|instruction", "statement"), ("variable|constant|parameter|argument|identifier|flag|counter", "variable"), ("expression", "expression"),
    ("character|symbol|delimiter|bracket|parenthesis|brace|slash|quote|hyphen|dash|asterisk|tilde|caret", "character"), ("algorithm|sort|search|hash|heuristic", "algorithm"),
    ("function|method|procedure|routine|callback|recursion|macro|subroutine", "method"), ("code|syntax|notation|comment", "source code"), ("database|sql|query|index", "database"),
    ("process|thread|execution|runtime|compile|build", "computing process"), ("memory|address|pointer|buffer|register|cache", "data structure"), ("program|script", "program"),
    ("paradigm|programming|coding|development", "development"),
)


def dictionary(g: Graph, facts: DataFrame, default: str, rules: tuple[tuple[str, str], ...] = PARENTS, context: int = 3, most: int = 60) -> dict[str, DataFrame]:
    """facts (term, genus, synonyms: array, expansion) to what a dictionary adds: concepts (name, parent: a name, by: genus, rule or default),
    genera (term, genus: ids of concepts that are there already and get a further genus), terms (term, synonym) and report (what, rows).

    A term that the graph knows, loosely (without a plural ending), is not made again. A new one hangs below its genus, which is made
    below the default if it is not known; without a genus below the first rule that fits the term and whose parent is known; else below the
    default. Synonyms and expansions that name another concept, repeat the term or are longer than so many letters are left out."""
    f = facts.select(F.trim("term").alias("term"), F.nullif(F.trim("genus"), F.lit("")).alias("genus"), "synonyms", "expansion").filter("term <> ''").dropDuplicates(["term"])
    rule_names = [p for _, p in rules]
    words = f.select(F.col("term").alias("word")).union(f.select("genus").filter("genus is not null")).distinct()
    fixed = g.spark.createDataFrame([(p,) for p in {*rule_names, default}], "word string")
    known = materialized(terms.by_singular(g, words.union(fixed).distinct(), None).groupBy("word").agg(F.min("id").alias("id")))
    there = [r["word"] for r in known.join(fixed, "word", "left_semi").collect()]  # a few dozen parents of rules
    by_rule = reduce(lambda c, r: c.when(F.lower("term").rlike(r[0]), r[1]), [r for r in rules if r[1] in there], F.when(F.lit(False), ""))
    f = f.join(known.toDF("term", "id"), "term", "left").join(known.toDF("genus", "genus_id"), "genus", "left")
    f = materialized(f.withColumn("rule", by_rule))
    parent = F.coalesce("genus", "rule", F.lit(default))
    by = F.when(F.col("genus").isNotNull(), "genus").when(F.col("rule").isNotNull(), "rule").otherwise("default")
    new = f.filter("id is null").select(F.col("term").alias("name"), parent.alias("parent"), by.alias("by"))
    made = f.filter("genus is not null and genus_id is null").join(f.filter("id is null").select(F.col("term").alias("genus")), "genus", "left_anti").select(F.col("genus").alias("name")).distinct()
    concepts = materialized(new.union(made.select("name", F.lit(default), F.lit("default"))))
    direct = g.edge.filter((F.col("code") == GENUS) & (F.col("context") == context)).select(F.col("subject").alias("id"), F.col("target").alias("genus_id"))
    genera = materialized(f.filter("id is not null and genus_id is not null and id <> genus_id").select("id", "genus_id").distinct().join(direct, ["id", "genus_id"], "left_anti"))
    spoken = f.select("term", "id", F.explode(F.array_compact(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.array("expansion")))).alias("s")).withColumn("s", F.trim("s"))
    spoken = spoken.filter((F.col("s") != "") & (F.lower("s") != F.lower("term")) & (F.length("s") <= most)).distinct()
    taken = terms.first_match(g, spoken.select(F.col("s").alias("word")).distinct()).toDF("s", "other")
    said = materialized(spoken.join(taken, "s", "left").filter("other is null").select("term", F.col("s").alias("synonym")))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("rows"))
    report = [count(concepts, "concepts"), count(genera, "genera"), count(said, "terms"), count(f.filter("id is not null"), "known"), *(count(concepts.filter(F.col("by") == x), f"by {x}") for x in ("genus", "rule", "default"))]
    return {"concepts": concepts, "genera": genera, "terms": said, "report": reduce(DataFrame.union, report)}
