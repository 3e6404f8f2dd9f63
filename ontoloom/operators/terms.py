"""Terms: exact and approximate lookup, homonyms, search, labels and generated definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions import text
from ontoloom.sources.model import GENUS, Graph, is_positive


def labels(g: Graph, lang: str | None = None) -> DataFrame:
    """(id, key): the names by which a concept is found; without a language its canonical name and all terms."""
    t = g.term if lang is None else g.term.filter(F.col("lang") == lang)
    own = t.select(F.col("concept_id").alias("id"), text.key(F.col("term")).alias("key"))
    return (own if lang else own.union(g.concept.select("id", text.key(F.col("name"))))).distinct()


def resolved(g: Graph, term: str, lang: str | None = None) -> DataFrame:
    """The ids that a term names; by the Unicode key, so composed and decomposed spellings meet."""
    import unicodedata

    want = " ".join(unicodedata.normalize("NFC", term).casefold().split())
    t = g.term if lang is None else g.term.filter(F.col("lang") == lang)
    own = t.select(F.col("concept_id").alias("id"), "term")
    if lang is None:
        own = own.union(g.concept.select("id", F.col("name")))
    return own.filter(text.canonical_key(F.col("term")) == want).select("id").distinct()


def resolve_all(g: Graph, terms: DataFrame, lang: str | None = None) -> DataFrame:
    """terms (term) to (term, id, candidates): exact hits with the number of concepts that a term names."""
    hit = terms.select("term", text.key(F.col("term")).alias("key")).distinct().join(labels(g, lang), "key")
    n = hit.groupBy("term").agg(F.countDistinct("id").alias("candidates"))
    return hit.select("term", "id").distinct().join(n, "term")


def named(g: Graph, terms: DataFrame) -> DataFrame:
    """terms (term) to (term, id, lang): exact hits in every language at once; canonical names have none."""
    t = g.term.select(F.col("concept_id").alias("id"), "lang", text.key(F.col("term")).alias("key"))
    t = t.union(g.concept.select("id", F.lit(None).cast("string"), text.key(F.col("name"))))
    return terms.select("term", text.key(F.col("term")).alias("key")).distinct().join(t, "key").select("term", "id", "lang").distinct()


def homonyms(g: Graph, lang: str = "en") -> DataFrame:
    """(key, concepts, least): keys that name several concepts."""
    return labels(g, lang).groupBy("key").agg(F.count("*").alias("concepts"), F.min("id").alias("least")).filter("concepts > 1")


def search(g: Graph, query: str, limit: int = 100) -> DataFrame:
    """(id, name, rank): exact name 0, exact term 1, name prefix 2, anything that contains the query 3; each concept once."""
    q = query.lower()
    names = g.concept.select("id", "name", "context", F.lower("name").alias("n"))
    by_name = names.filter(F.col("n").contains(q)).select("id", "name", "context", F.when(F.col("n") == q, 0).when(F.col("n").startswith(q), 2).otherwise(3).alias("rank"))
    t = g.term.select(F.col("concept_id").alias("id"), F.lower("term").alias("t")).filter(F.col("t").contains(q))
    by_term = t.join(names, "id").select("id", "name", "context", F.when(F.col("t") == q, 1).otherwise(3).alias("rank"))
    best = by_name.union(by_term).groupBy("id", "name", "context").agg(F.min("rank").cast("long").alias("rank"))
    return best.orderBy("rank", "context", "name", "id").limit(limit).select("id", "name", "rank")


def fuzzy(g: Graph, words: DataFrame, lang: str | None = "en") -> DataFrame:
    """words (word) to (word, id, tier): exact one-word terms (1), else near ones (2); of a language, or of any. Words meet under keys
    that near words share, so blocks hold little but matches; a text that many concepts bear is matched once."""
    t = (g.term if lang is None else g.term.filter(F.col("lang") == lang)).select(F.col("concept_id").alias("id"), text.loose_key(F.col("term")).alias("t")).filter(~F.col("t").contains(" ")).distinct()
    hit = _met_words(t, words).join(t, "t").select("word", "id", F.when(F.col("w") == F.col("t"), 1).otherwise(2).alias("tier"))
    best = hit.groupBy("word", "id").agg(F.min("tier").alias("tier"))
    least = best.groupBy("word").agg(F.min("tier").alias("least"))
    return best.join(least, "word").filter("tier = least").select("word", "id", F.col("tier").cast("long").alias("tier"))


def _met_words(t: DataFrame, words: DataFrame) -> DataFrame:
    """words (word) and loose keys (t) of one word to (word, w, t): those that are near, w the word's own loose key."""
    keyed = t.select("t").distinct().withColumn("key", F.explode(text.match_keys(F.col("t"), False)))
    w = words.select("word", text.loose_key(F.col("word")).alias("w")).distinct().withColumn("key", F.explode(text.match_keys(F.col("w"), True)))
    return w.join(keyed.hint("merge"), "key").filter(text.near(F.col("w"), F.col("t"))).select("word", "w", "t").distinct()


def near_words(g: Graph, words: DataFrame) -> DataFrame:
    """words (word) to (word, id, lang, exact): one-word terms of every language that are near, or the same."""
    t = g.term.select(F.col("concept_id").alias("id"), "lang", text.loose_key(F.col("term")).alias("t")).filter(~F.col("t").contains(" ")).distinct()
    return _met_words(t, words).join(t, "t").select("word", "id", "lang", (F.col("w") == F.col("t")).alias("exact"))


def fuzzy_phrases(g: Graph, phrases: DataFrame, lang: str | None = "en") -> DataFrame:
    """phrases (phrase) to (phrase, id): terms of as many words that match word by word. They meet under the number of words and keys
    that their first and their last words share."""
    t = (g.term if lang is None else g.term.filter(F.col("lang") == lang)).select(F.col("concept_id").alias("id"), "lang", text.loose_key(F.col("term")).alias("t")).distinct()
    return _near_phrases(t, phrases).select("phrase", "id").distinct()


def near_phrases(g: Graph, phrases: DataFrame) -> DataFrame:
    """phrases (phrase) to (phrase, id, lang): as ``fuzzy_phrases`` finds them in every language at once."""
    return _near_phrases(g.term.select(F.col("concept_id").alias("id"), "lang", text.loose_key(F.col("term")).alias("t")).distinct(), phrases)


def _near_phrases(t: DataFrame, phrases: DataFrame) -> DataFrame:
    p = phrases.select("phrase", text.loose_key(F.col("phrase")).alias("p")).distinct()

    def keyed(df: DataFrame, c: str, side: bool) -> DataFrame:
        words = F.split(c, " ")
        df = df.withColumn("n", F.size(words)).withColumn("head", F.explode(text.match_keys(F.element_at(words, 1), side)))
        return df.withColumn("tail", F.explode(text.match_keys(F.element_at(words, -1), side)))

    both = keyed(p, "p", True).join(keyed(t.select("t").distinct(), "t", False).hint("merge"), ["n", "head", "tail"])
    met = both.filter(text.near_phrase(F.col("p"), F.col("t"))).select("phrase", "t").distinct()
    return met.join(t, "t").select("phrase", "id", "lang")


def display(g: Graph, lang: str = "en") -> DataFrame:
    """(id, label): the shortest term of the language, ties by lower case, then text; else the canonical name."""
    t = g.term.filter(F.col("lang") == lang).groupBy(F.col("concept_id").alias("id")).agg(F.min(F.struct(F.length("term"), F.lower("term"), "term"))["term"].alias("term"))
    return g.concept.join(t, "id", "left").select("id", F.coalesce("term", "name").alias("label"))


def infinitive_display(g: Graph, lang: str = "en") -> DataFrame:
    """(id, label): a term that is no infinitive and no infinitive's stem, else any that is no infinitive, else the bare stem."""
    t = g.term.filter(F.col("lang") == lang).select(F.col("concept_id").alias("id"), "term", F.col("term").startswith("to ").alias("inf"), text.bare_infinitive(F.col("term")).alias("bare"))
    stems = t.filter("inf").select("id", F.col("bare").alias("term"), F.lit(True).alias("stem")).distinct()
    r = t.join(stems, ["id", "term"], "left").withColumn("tier", F.when(~F.col("inf") & F.col("stem").isNull(), 0).when(~F.col("inf"), 1).otherwise(2))
    k = F.row_number().over(Window.partitionBy("id").orderBy("tier", F.length("term"), "term"))
    return r.withColumn("k", k).filter("k = 1").select("id", F.when(F.col("inf"), F.col("bare")).otherwise(F.col("term")).alias("label"))


# Labels of relations in definitions, outgoing and incoming, and of degrees, by language (fixed values).
LABELS_OUT = {
    "en": {
        "15": "essential attribute", "20": "attribute", "21": "purpose", "22": "capable of", "23": "made of", "24": "holds", "25": "acts upon", "26": "intended for", "27": "directed at", "30": "coextensive with",
        "40": "overlaps", "61": "coordinate with", "62": "mutual with", "63": "opposite", "70": "produces", "71": "hinders", "72": "precedes", "73": "accompanies", "74": "depends on",
    },
    "ru": {
        "15": "существенный признак", "20": "признак", "21": "назначение", "22": "способен к", "23": "сделан из", "24": "содержит", "25": "действует на", "26": "предназначен для", "27": "направлен на", "30": "равнообъёмно с",
        "40": "пересекается с", "61": "соподчинено с", "62": "взаимно с", "63": "противоположно", "70": "порождает", "71": "препятствует", "72": "предшествует", "73": "сопутствует", "74": "зависит от",
    },
}
LABELS_IN = {
    "en": {"22": "bearer", "23": "material of", "24": "contained in", "25": "handled by", "26": "used by", "27": "object of", "70": "produced by", "72": "follows", "74": "needed for"},
    "ru": {"22": "носитель", "23": "материал для", "24": "содержится в", "25": "обрабатывается", "26": "используется", "27": "объект", "70": "порождается", "72": "следует за", "74": "нужен для"},
}
DEGREES_RU = {"attribute": "признак", "no": "нет", "inherent": "неотъемлемый", "typical": "типичный", "sometimes": "иногда", "rarely": "редко"}
WORDS = {"en": ("not ", "universe (no genus)", ". Species: "), "ru": ("не ", "универсум (без рода)", ". Виды: ")}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def spoken_relations(g: Graph, names: DataFrame, lang: str = "en") -> DataFrame:
    """(id, incoming, code, other, strength, edge, text): each relation but genus as a definition puts it, from both of its ends. Outgoing ones
    by their label with ``not`` for a negation and the degree in percents (attributes by how strongly they hold); incoming ones, never
    negations, by the same label for symmetric codes, else by the label of the other direction. Codes without a label are silent."""
    e = g.edge.filter((F.col("status") == "ok") & (F.col("code") != GENUS)).select("id", "subject", "code", "target", "strength")
    e = e.join(F.broadcast(g.rule.select("code", "mutual")), "code", "left")  # a few dozen codes
    other = names.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    no, *_ = WORDS[lang]
    negative = F.coalesce(F.col("strength") == 0, F.lit(False))
    degree = text.band(F.col("strength"))
    degree = _mapped(DEGREES_RU, degree) if lang == "ru" else degree
    label = F.when(F.col("code") == "20", degree).otherwise(F.concat(F.when(negative, no).otherwise(""), _mapped(LABELS_OUT[lang], F.col("code"))))
    share = F.when(F.col("strength") > 0, F.concat(F.lit(" ("), F.col("strength").cast("string"), F.lit("%)"))).otherwise("")
    out = e.select(F.col("subject").alias("id"), F.lit(0).alias("incoming"), "code", F.col("target").alias("other"), "strength", F.col("id").alias("edge"), label.alias("label"), share.alias("share"))
    back = F.when(F.coalesce("mutual", F.lit(False)), F.coalesce(_mapped(LABELS_OUT[lang], F.col("code")), _mapped(LABELS_IN[lang], F.col("code")))).otherwise(_mapped(LABELS_IN[lang], F.col("code")))
    into = e.filter(~negative).select(F.col("target").alias("id"), F.lit(1).alias("incoming"), "code", F.col("subject").alias("other"), "strength", F.col("id").alias("edge"), back.alias("label"), F.lit("").alias("share"))
    told = out.union(into).filter("label is not null").join(other, "other", "left")
    return told.select("id", "incoming", "code", "other", "strength", "edge", F.concat("label", F.lit(": "), F.coalesce("other_name", F.lit("?")), "share").alias("text"))


def definitions(g: Graph, most: int | None = 1000, lang: str = "en", names: DataFrame | None = None, by_text: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """(id, definition, weak): name, genera, relations and species of every concept, cut at most characters (None: whole).

    Of several genera each is named with the context of its edge, in the order of edges. Relations are those of ``spoken_relations``, first
    outgoing, then incoming ones, by code, other end and degree (by_text: all by their text). Species are in order of their names, each
    once. names (id, name): other names than the canonical ones. weak: nothing but genera is known. ids (id): of these concepts only.

    No more links can come before the cut than it has characters, so of a concept's links no more are gathered; whole definitions gather
    all links of a concept."""
    name = (g.concept if names is None else names).select("id", "name")
    e = g.edge.filter("status = 'ok'")
    keep = lambda df: df if most is None else df.filter(F.col("k") <= most)
    mine = lambda df: df if ids is None else df.join(ids, "id", "left_semi")
    said = lambda df, by, alias: df.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), by).alias(alias))
    up = e.filter(F.col("code") == GENUS).select("id", "subject", "target", "context").join(name.toDF("target", "name"), "target", "left").join(F.broadcast(g.context.toDF("context", "place")), "context", "left")  # five contexts
    up = mine(up.select(F.col("subject").alias("id"), F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("place", F.col("context").cast("string")).alias("place"), F.col("id").alias("edge")))
    up = keep(up.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("edge"))))
    single = up.groupBy("id").agg(F.max("k").alias("parents"), F.min(F.when(F.col("k") == 1, F.col("name"))).alias("one"))
    genera = said(up.withColumn("text", F.concat("name", F.lit(" ["), "place", F.lit("]"))), "; ", "genera").join(single, "id").select("id", F.when(F.col("parents") == 1, F.col("one")).otherwise(F.col("genera")).alias("genera"))
    down = mine(e.filter(F.col("code") == GENUS).select(F.col("target").alias("id"), F.col("subject").alias("other"))).distinct().join(name.toDF("other", "text"), "other", "left").withColumn("text", F.coalesce("text", F.lit("?")))
    species_ = said(keep(down.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("text", "other")))), ", ", "species")
    order = ("text", "edge") if by_text else ("incoming", "code", "other", F.col("strength").asc_nulls_first(), "edge")
    related = said(keep(mine(spoken_relations(g, name, lang)).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(*order)))), "; ", "related")
    all_ = mine(g.concept.select("id")).join(name, "id", "left").join(genera, "id", "left").join(related, "id", "left").join(species_, "id", "left")
    _, no_genus, species_word = WORDS[lang]
    parts = F.concat(F.coalesce("name", F.lit("?")), F.lit(" — "), F.coalesce("genera", F.lit(no_genus)), F.coalesce(F.concat(F.lit("; "), "related"), F.lit("")), F.coalesce(F.concat(F.lit(species_word), "species"), F.lit("")))
    weak = F.col("related").isNull() & F.col("species").isNull() & F.col("genera").isNotNull()
    return all_.select("id", (parts if most is None else F.left(parts, F.lit(most))).alias("definition"), weak.alias("weak"))


def card_rows(g: Graph, names: DataFrame | None = None) -> DataFrame:
    """(id, part, other, name, code, context, strength, lang): everything that a concept's card shows, a row each, so that a concept with any
    number of links is no large row: parent and child (with the context of the link), out and in (relations but genus, with code and
    degree; a relation with itself is out), term (name is the term). Names of concepts are canonical, or those of names (id, name)."""
    name = (g.concept if names is None else names).select(F.col("id").alias("other"), "name")
    e = g.edge.filter("status = 'ok'").select("subject", "code", "target", "context", "strength")
    genus, none = F.col("code") == GENUS, F.lit(None).cast("string").alias("lang")
    out = e.select(F.col("subject").alias("id"), F.when(genus, "parent").otherwise("out").alias("part"), F.col("target").alias("other"), "code", "context", "strength")
    into = e.filter(genus | (F.col("subject") != F.col("target"))).select(F.col("target").alias("id"), F.when(genus, "child").otherwise("in").alias("part"), F.col("subject").alias("other"), "code", "context", "strength")
    links = out.union(into).join(name, "other").select("id", "part", "other", "name", "code", "context", "strength", none)
    null = lambda t: F.lit(None).cast(t)
    said = g.term.select(F.col("concept_id").alias("id"), F.lit("term").alias("part"), null("long").alias("other"), F.col("term").alias("name"), null("string").alias("code"), null("long").alias("context"), null("long").alias("strength"), "lang")
    return links.union(said)


def cards(g: Graph, ids: DataFrame, most: int = 200, lang: str = "en", names: DataFrame | None = None) -> DataFrame:
    """ids (id) to one row a concept: id, name, context, processed, definition, and parents, children, relations and terms as arrays of structs,
    each with its total (n_parents, ...). Parents are in order of context and name, children of name, relations of code, then other end,
    terms of language and text; of each the first ``most`` are nested, as a card can show them, while card_rows has all."""
    wanted = ids.select("id").distinct()
    rows = card_rows(g, names).join(wanted, "id", "left_semi")
    kind = F.when(F.col("part").isin("out", "in"), "relation").otherwise(F.col("part"))
    order = [F.when(F.col("part") == "parent", F.col("context")), F.when(F.col("part").isin("out", "in"), F.col("code")), F.when(F.col("part").isin("out", "in"), F.col("other")), F.col("lang"), F.col("name"), F.col("other"), F.col("part"), F.col("context"), F.col("strength")]
    rows = rows.withColumn("kind", kind).withColumn("k", F.row_number().over(Window.partitionBy("id", "kind").orderBy(*order)))
    fields = {"parent": ("other", "name", "context"), "child": ("other", "name"), "relation": ("code", "part", "other", "name", "strength"), "term": ("name", "lang")}
    nested = []
    for one, cols in fields.items():
        there = (F.col("kind") == one) & (F.col("k") <= most)
        nested += [F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("k", F.struct(*cols).alias("x"))))), lambda y: y["x"]).alias(f"{one}s" if one != "child" else "children"), F.count_if(F.col("kind") == one).alias("n_children" if one == "child" else f"n_{one}s")]
    made = rows.groupBy("id").agg(*nested)
    own = (g.concept if names is None else g.concept.drop("name").join(names, "id", "left")).select("id", "name", "context", "processed")
    d = definitions(g, None if most is None else 1000, lang, names, by_text=True).select("id", "definition")
    return own.join(wanted, "id", "left_semi").join(d, "id").join(made, "id", "left")


def banded(g: Graph, context: int = 1) -> DataFrame:
    """(band, edges): assertions by how strongly they hold."""
    e = g.scope(context, positive=False).filter(F.col("code").isin("22", "70"))
    return e.groupBy(text.band(F.col("strength")).alias("band")).agg(F.count("*").alias("edges"), F.count_if(is_positive()).alias("positive"))


def script_flags(g: Graph) -> DataFrame:
    """(id, cyrillic_only, any_latin) of concepts with English terms."""
    t = g.term.filter("lang = 'en'").groupBy(F.col("concept_id").alias("id"))
    c, l = text.has_cyrillic(F.col("term")), text.has_latin(F.col("term"))  # noqa: E741
    return t.agg(F.bool_and(c & ~l).alias("cyrillic_only"), F.bool_or(l).alias("any_latin"))


def first_match(g: Graph, words: DataFrame, lang: str | None = None) -> DataFrame:
    """words (word) to (word, id): the least concept that a term of the language, or any term or name, names."""
    hit = words.select("word", text.key(F.col("word")).alias("key")).distinct().join(labels(g, lang), "key")
    return hit.groupBy("word").agg(F.min("id").alias("id"))


def by_singular(g: Graph, words: DataFrame, lang: str | None = "en") -> DataFrame:
    """words (word) to (word, id): the concepts that a word names, else those that it names without its plural ending s, else es."""
    tried = words.select("word", F.posexplode(text.singulars(text.key(F.col("word")))).alias("place", "key")).distinct()
    hit = tried.join(labels(g, lang), "key")
    best = hit.groupBy("word").agg(F.min("place").alias("place"))
    return hit.join(best, ["word", "place"]).select("word", "id").distinct()


def with_bare_forms(g: Graph, lang: str = "en") -> DataFrame:
    """All terms, and for each infinitive of the language its bare form."""
    bare = g.term.filter((F.col("lang") == lang) & F.col("term").startswith("to ")).select("concept_id", text.bare_infinitive(F.col("term")).alias("term"), "lang")
    return g.term.union(bare).distinct()
