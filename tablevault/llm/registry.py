"""The registered queries of this package and their SQL. Each query takes a session and a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevault.llm import chat, collocation, jaccard, language, lexical, mixing, packing, quality_hosts, scoring, secret_ledger, sharding, token_files, topk
from tablevault.llm.common import crc_of_id
from tablevault.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


@_register
def op1_mix_sources(spark, folder):
    planned = mixing.mix(documents(spark, folder, "doc_id", "text", "source"), carry=["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


@_register
def op2_language_id(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "lang").withColumn("held_out", F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model)


@_register
def op3_best_fit_packing(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return packing.pack(packing.cut_documents(docs, vocabulary("byte_bpe_50k.json"), 1024, 2), 1024)


@_register
def op4_token_files(spark, folder):
    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, folder, "doc_id", "text"), path, vocabulary("word_bpe_49k.json"))
    return token_files.decode_documents(spark, path)


@_register
def op5_bloom_scores(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return scoring.score(docs.withColumn("held_out", F.pmod(crc_of_id(F.col("doc_id")), F.lit(7)) == 2))


@_register
def op6_host_rules(spark, folder):
    judged = quality_hosts.quality_rules(documents(spark, folder, "doc_id", "text", "source"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_register
def op7_perspective_rotation(spark, folder):
    return chat.rotate(spark.read.parquet(f"{folder}/conversations.parquet"))


@_register
def op8_jaccard_join(spark, folder):
    return jaccard.jaccard_components(documents(spark, folder, "doc_id", "text"), 4, 85)


@_register
def op9_secret_ledger(spark, folder):
    ledger = f"{shared_folder(spark)}/llm-ledger-{uuid.uuid4().hex}"
    docs = documents(spark, folder, "doc_id", "text")
    return secret_ledger.digests(secret_ledger.scan_secrets(docs, ledger, drop_text=True))


@_register
def op10_exact_top_k(spark, folder):
    vectors = topk.to_integers(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


@_register
def op11_feistel_shards(spark, folder):
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"), sharding.text_crc(F.col("text"))
    docs = documents(spark, folder, "doc_id", "text").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    placed = sharding.shard_rows(docs, 24, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "row_number")


@_register
def op12_phrase_collocations(spark, folder):
    return collocation.collocations(documents(spark, folder, "text", "lang"))


@_register
def op13_lexical_search(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return lexical.ranked(documents(spark, folder, "doc_id", "text"), items)


def _network_sql(source: str, value: str) -> str:
    """One pass of column ``value`` of ``source``, which has the sides a and b, through the network of ``sharding``."""
    sql = f"select *, {value} // b as l, {value} % b as r from {source}"
    for i, factor, first, second in sharding.Permutation(1).keys:
        to, by, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"select *, ({by} * {factor} + {first}) % {sharding.PRIME} as t from ({sql})"
        sql = f"select * exclude ({to}, t), ({to} + ((t * t + {second}) % {sharding.PRIME}) % {side}) % {side} as {to} from ({sql})"
    return f"select * exclude (l, r), l * b + r as p from ({sql})"


_SQL: dict[str, str] = {
    "op12_phrase_collocations": r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from piece),
totals as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
f1 as (select lang, word, count(*) as f from (select lang, unnest(ws) as word from w) group by all),
f2 as (select lang, p.a as w1, p.b as w2, count(*) as f from
    (select lang, unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) as p from w) group by all),
f3 as (select lang, p.a as w1, p.b as w2, p.c as w3, count(*) as f from
    (select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]})) as p from w) group by all having count(*) >= 10),
cuts as (select c.lang, c.w1 || ' ' || c.w2 as phrase, c.f as a, 1 as k, l.f as l, r.f as r from f2 c join f1 l on l.lang = c.lang and l.word = c.w1
    join f1 r on r.lang = c.lang and r.word = c.w2 where c.f >= 10
    and not exists (select 1 from f3 t where t.lang = c.lang and 100 * t.f >= 50 * c.f and ((t.w1 = c.w1 and t.w2 = c.w2) or (t.w2 = c.w1 and t.w3 = c.w2)))
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f from f3 c join f1 l on l.lang = c.lang and l.word = c.w1
    join f2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f from f3 c join f2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2
    join f1 r on r.lang = c.lang and r.word = c.w3),
scored as (select lang, phrase, a, l, r, cast((cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * r) as bigint) as score, k from cuts
    qualify row_number() over (partition by lang, phrase order by (cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * r), k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""",
    "op13_lexical_search": r"""
with tok as (select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from (select row_number() over () as rowid, * from documents)),
totals as (select count(*) filter (len(ws) > 0) as n_docs, cast(sum(len(ws)) as bigint) as n_words from tok),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from tok) where term in (select term from asked) group by r, term),
weight as (select term, cast(floor(1000 * ln((2 * cast(n_docs as double) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by term, n_docs),
gains as (select r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n_docs) // n_words))) as gain
    from tf join weight using (term) join tok using (r), totals),
scored as (select item_id, r, cast(sum(gain) as bigint) as score from asked join gains using (term) group by item_id, r having sum(gain) > 0),
ranked as (select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank
    from scored join tok using (r))
select item_id, rank, doc_id, score from ranked where rank <= 50
""",
    "op11_feistel_shards": f"""
with recursive tab as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
hexed as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, cast(length(h) // 2 as bigint) + 8 as size, case when h = '' then 0 else xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) end as text_crc32 from hexed, tab),
numbered as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_number, count(*) over () as n from sized),
sides as (select *, (n + a - 1) // a as b from (select *, cast(ceil(sqrt(n)) as bigint) as a from numbered)),
walk as ({_network_sql("sides", "row_number")} union all {_network_sql("(select * exclude (p), p as x from walk where p >= n)", "x").replace("select * exclude (l, r), l * b", "select * exclude (l, r, x), l * b")})
select doc_id, size, text_crc32, 'rows' as law, cast(p % 24 as integer) as shard, p // 24 as slot, cast(null as integer) as grown_shard, row_number
from walk where p < n
""",
    "op6_host_rules": r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
win as (select doc_id, p, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o
    || ' ' || lead(word, 5) over o || ' ' || lead(word, 6) over o || ' ' || lead(word, 7) over o as g from tok window o as (partition by doc_id order by p)),
again as (select doc_id, p from win where g is not null qualify count(*) over (partition by doc_id, g) > 1),
cover as (select doc_id, count(distinct p + k) as n_repeat_words from again, range(8) as r(k) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
base as (select w.doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    len(l) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w join lines using (doc_id) left join cover using (doc_id)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > 3 * n_words or 100 * n_dup_lines > 35 * n_lines
    or word_chars < 2 * n_words or word_chars > 25 * n_words as fails from base),
hosts as (select source as host, count(*) as docs, count(*) filter (fails) as failed from judged group by source),
moments as (select least(greatest(coalesce(sum(failed) / sum(docs), 0.5), 0.001), 0.999) as m, coalesce(var_pop(failed / docs), 0) as v,
    avg(1.0 / docs) as inverse from hosts),
prior as (select m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * inverse, m * (1 - m) / 1000001) - 1, 1) as worth from moments),
verdicts as (select host, (failed + m * worth) / (docs + worth) > 0.6 as rejected from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not fails and not rejected as kept
from judged join verdicts on source is not distinct from host
""",
    "op7_perspective_rotation": """
with said as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, role as perspective from said where role <> 'system'),
each as (select s.*, p.perspective, '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
    else 'user name=' || role end || chr(10) as head from said s join people p on s.conv_id is not distinct from p.conv_id),
pieces as (select *, head || text || '<|im_end|>' || chr(10) as piece from each),
placed as (select *, length(piece) as length, cast(coalesce(sum(length(piece)) over (partition by conv_id, perspective
    order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) as start from pieces)
select conv_id, perspective, turn, role, piece, start, length, case when role = perspective then start + length(head) end as mask_start,
    case when role = perspective then start + length end as mask_end from placed
""",
    "op10_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
""",
}
