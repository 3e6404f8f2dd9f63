"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import ann, chat, clusters, embedding_dups, encoding, jaccard, language, lines, mixing, packing, quality, secrets, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), least=0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    read = chat.parsed(chat.formatted(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"), length=13, with_text=False)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents"), words=5, percent=75)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(*(_table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_nearest_neighbours, op2_quality_classifier, op3_line_dedup, op4_best_fit_packing, op5_chat_formatting, op6_substring_dedup, op7_ngram_jaccard_join, op8_embedding_near_dedup, op9_source_mixing, op10_language_id, op11_target_encoding, op12_secret_scan, op13_centroid_clustering)
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

#: crc32 of a number's digits: bytes are folded in one after another, each by eight steps of the reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({} as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::bigint)"""


def _history(column: str, name: str) -> str:
    """Lines of other folds that share a column's value and were sold earlier, and how many of them were returned."""
    over = "over (partition by {} order by moment range between unbounded preceding and interval 1 microsecond preceding)"
    part = "cast(coalesce(sum({0}) {1}, 0) - coalesce(sum({0}) {2}, 0) as bigint) as {3}_{0}"
    return ", ".join(part.format(c, over.format(column), over.format(f"{column}, fold"), name) for c in ("n", "s"))


def _sql_rate(name: str, prior: str) -> str:
    return f"case when {name}_n < 1 then {prior} else (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) end as {name}_rate"


def _rounds(rounds: int) -> str:
    """Whole rounds of clustering in plain SQL: a0 has the first owners, c1 the centroids after a round, and so on."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = []
    for t in range(rounds + 1):
        parts.append(f"a{t} as (select v.id, v.vec_id, v.x, arg_min(c.c, [{square}, c.c]) as c, min({square}) as d from v, c{t} c group by all)")
        if t < rounds:
            parts.append(f"s{t} as (select c, i, sum(x[i])::bigint as s, count(*) as n from a{t}, (select unnest(range(1, 65)) as i) group by c, i)")
            parts.append(f"m{t} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from s{t} group by c), c{t + 1} as (select o.c, coalesce(m.x, o.x) as x from c{t} o left join m{t} m on m.c = o.c)")
    return ", ".join(parts)


ORACLE_SQL: dict[str, str] = {
    "op5_chat_formatting": f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        b as (select *, lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as opens from t)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(length({_ESC.format('text')}) + case when opens then length({_ESC.format('role')}) + 15 else 6 end) as bigint) as formatted_chars
        from b group by conv_id""",
    "op11_target_encoding": f"""
        with own as (
            select l.sale_id, coalesce(l.item_id, -1) as item_id, l.vendor_id, coalesce(s.client_id, -1) as client_id, s.sold_at as moment, count(*) as n, count(*) filter (l.flag = 'returned') as s,
                {_CRC.format('l.sale_id')} % 5 as fold
            from sale_lines l join sales s on s.sale_id = l.sale_id where s.sold_at is not null group by all),
        e as (select own.*, 0 as whole, i.kind, v.nation_id, c.segment from own left join items i on i.item_id = own.item_id left join vendors v on v.vendor_id = own.vendor_id left join clients c on c.client_id = own.client_id),
        h as (select *, {', '.join(_history(x, y) for x, y in (('whole', 'all'), ('kind', 'kind'), ('nation_id', 'nation'), ('segment', 'segment'), ('item_id', 'item'), ('vendor_id', 'vendor'), ('client_id', 'client')))} from e),
        a as (select *, {_sql_rate('all', '500000')} from h),
        b as (select *, {', '.join(_sql_rate(x, 'all_rate') for x in ('kind', 'nation', 'segment'))} from a)
        select sale_id, item_id, vendor_id, n as n_lines, s as n_returned, item_n, {_sql_rate('item', 'kind_rate')}, vendor_n, {_sql_rate('vendor', 'nation_rate')}, client_n, {_sql_rate('client', 'segment_rate')} from b""",
    "op13_centroid_clustering": f"""
        with v as (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as (select row_number() over (order by sha256('1:' || vec_id), x) - 1 as c, x from v qualify row_number() over (order by sha256('1:' || vec_id), x) <= 16),
        {_rounds(3)}
        select vec_id, a3.c::int as cluster, d::bigint as distance, (sum(d) over (partition by a3.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c3.x, ',')) as centroid_sha256
        from a3 join c3 on c3.c = a3.c""",
}
