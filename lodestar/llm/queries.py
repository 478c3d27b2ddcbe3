"""The operators as queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, language, packing, pii, quality, repeats, secrets, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rest(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n; a null id counts as remainder -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    known = language.profiles(docs.where(_rest(4) != 2))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_rest(4) == 2).alias("held_out"), "text")
    return language.predict(marked, known, keep=["doc_id", "held_out"])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(_read(spark, sf_dir, "documents"), window=35)


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels").where(_rest(3) != 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (_rest(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integers(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP3_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as h from documents
), b as (
  select row_number() over () as i, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as item from benchmark
), mine as (
  select r, unnest(h) as w, generate_subscripts(h, 1) as p from d
), theirs as (
  select i, unnest(item) as w, generate_subscripts(item, 1) as q from b
), diagonals as (
  select r, i, d from (select r, i, p - q as d, count(*) as k from mine join theirs using (w) group by all) join b using (i) where k >= ceil(0.8 * least(15, len(item)))
), laid as (
  select doc_id, item_id, len(item) as n, least(15, len(item)) as stretch,
    list_transform(range(greatest(g.d, 0), least(len(h), g.d + len(item))), lambda p: case when h[p + 1] = item[p - g.d + 1] then 1 else 0 end) as same
  from diagonals g join d using (r) join b using (i)
), measured as (
  select doc_id, item_id, n, stretch, list_sum(same) as agree, list_max(list_transform(range(1, len(same) - stretch + 2), lambda i: list_sum(same[i:i + stretch - 1]))) as best from laid where len(same) >= stretch
)
select doc_id, item_id, cast(max(agree) as int) as agree, cast(max(best) as int) as best, cast(max(stretch) as int) as stretch, cast(max(n) as int) as item_tokens
from measured where best >= ceil(0.8 * stretch) group by doc_id, item_id
"""

OP5_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), pieces as (
  select r, 'assign' as kind, unnest(x) as m, generate_subscripts(x, 1) as i from (select r, regexp_extract_all(t, '(?s)(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+|[^pPsStTaA]+|.') as x from docs)
  union all select r, 'access', unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, 'AKIA[A-Z0-9]+|[^A]+|A') as x from docs)
  union all select r, 'hex', unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '[0-9a-f]+|[^0-9a-f]+') as x from docs)
  union all select r, 'url', unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '(?s)[a-zA-Z][a-zA-Z0-9+.-]*://[^\s\x0b:/@]+:[^\s\x0b:/@]+@|[^a-zA-Z]+|.') as x from docs)
  union all select r, 'pem', unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----|[^-]+|-') as x from docs)
), placed as (
  select r, kind, m, cast(sum(length(m)) over (partition by r, kind order by i) as bigint) as e from pieces
), keys as (
  select r, e - length(m) as s, e, coalesce(lead(e - length(m)) over (partition by r order by e), 1000000000000) as "to" from placed where kind = 'pem' and starts_with(m, '-----BEGIN ')
), behind as (
  select r, s, e, substring(t, e + 1, "to" - e) as rest from keys join docs using (r)
), spans as (
  select r, kind, 0 as k, e - length(m) as s, e from placed where kind = 'assign' and regexp_matches(m, '^.{5}') and length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
  union all select r, kind, 1, e - length(m), e from placed where kind = 'access' and starts_with(m, 'AKIA') and length(m) >= 20
  union all select r, kind, 2, e - length(m), e from placed where kind = 'hex' and regexp_matches(m, '^[0-9a-f]') and length(m) >= 24
  union all select r, 'pem', 3, s, e + case when regexp_matches(rest, '-----END [A-Z ]*PRIVATE KEY-----') then length(regexp_extract(rest, '(?s)^.*?-----END [A-Z ]*PRIVATE KEY-----'))
    else length(regexp_extract(rest, '^(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})+(?:(?:[\x20\t\r]*\n|\\[nr])+[\x20\t]*[A-Za-z0-9+/]+={0,2}$)?')) end from behind
  union all select r, kind, 4, e - 1 - length(regexp_extract(m, ':([^:]+)@$', 1)), e - 1 from placed where kind = 'url' and ends_with(m, '@') and contains(m, '://') and length(m) > 1
), joined as (
  select r, string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (where k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as every,
    count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as b, count(*) filter (where k = 2) as c from spans group by r
)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans from docs left join joined using (r)
"""

OP6_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end as s from words
), distinct_sets as (
  select list_sort(s) as s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by all
), tokens as (
  select rep, n, unnest(s) as t from distinct_sets
), often as (
  select t from tokens group by t having count(*) > 1
), common as (
  select tokens.* from tokens join often using (t)
), able as (
  select rep from common group by rep, n having 100 * count(*) >= 85 * n
), pairs as (
  select a.rep as x, b.rep as y from common a join common b on a.t = b.t and a.rep < b.rep
  where a.rep in (select rep from able) and b.rep in (select rep from able) and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges as (
  select x, y from pairs union select y, x from pairs
), reach(node, root) as (
  select rep, rep from distinct_sets union select e.y, r.root from reach r join edges e on e.x = r.node
), least as (
  select node, min(root) as root from reach group by node
)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(least.root, sets.doc_id) as component_id
from sets left join distinct_sets d on d.s = list_sort(sets.s) and len(sets.s) > 0 left join least on least.node = d.rep
"""

OP7_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select doc_id, unnest(range(1, len(w) - 33)) as s, w from words where len(w) >= 35
), windows as (
  select doc_id, s, md5(array_to_string(w[s:s+34], ' ')) as h from starts
), repeated as (
  select doc_id, s from windows where h in (select h from windows group by h having count(*) > 1)
), gone as (
  select distinct doc_id, unnest(range(s, s + 35)) as i from repeated
), lists as (
  select doc_id, list(i) as gone from gone group by doc_id
), runs as (
  select doc_id, max(s) - min(s) + 35 as n from (select doc_id, s, s - row_number() over (partition by doc_id order by s) as run from repeated) group by doc_id, run
), maximal as (
  select doc_id, count(*) as passages, cast(max(n) as bigint) as longest from runs group by doc_id
), kept as (
  select words.doc_id, len(w) as n, len(gone) as g, list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)) as k from words left join lists using (doc_id)
)
select doc_id, cast(n as bigint) as n_words, cast(coalesce(g, 0) as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256,
  coalesce(passages, 0) as n_repeats, coalesce(longest, 0) as longest_repeat from kept left join maximal using (doc_id)
"""

OP8_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), pieces as (
  select r, 0 as k, unnest(x) as m, generate_subscripts(x, 1) as i from (select r, regexp_extract_all(t, '(?s)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z0-9._%+-]+|[^A-Za-z0-9._%+-]+') as x from docs)
  union all select r, 1, unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '(?s)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|[0-9]+|[^0-9]+') as x from docs)
  union all select r, 2, unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '(?s)[0-9](?:[\x20-]?[0-9])+|[0-9]|[^0-9]+') as x from docs)
  union all select r, 3, unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '(?s)\+[0-9][\x20().0-9-]+[0-9]|\+|[^+]+') as x from docs)
  union all select r, 4, unnest(x), generate_subscripts(x, 1) from (select r, regexp_extract_all(t, '(?s)[^\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+') as x from docs)
), placed as (
  select r, k, m, cast(sum(length(m)) over (partition by r, k order by i) as bigint) as e from pieces
), base as (
  select r, k, ['email', 'ip', 'card', 'phone'][k + 1] as kind, m, e - length(m) as s, e from placed
  where (k = 0 and contains(m, '@') and regexp_matches(m, '^[A-Za-z0-9._%+-]+@'))
    or (k = 1 and regexp_full_match(m, '(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))
    or (k = 2 and regexp_matches(m, '^[0-9]') and length(regexp_replace(m, '[^0-9]', '', 'g')) between 14 and 19 and
      list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: case when i % 2 = 1 then cast(c as int) when cast(c as int) > 4 then 2 * cast(c as int) - 9 else 2 * cast(c as int) end)) % 10 = 0)
    or (k = 3 and starts_with(m, '+') and length(regexp_replace(m, '[^0-9]', '', 'g')) between 10 and 15)
), tokens as (
  select r, m, e - length(m) + length(m) - length(ltrim(m, E' \t\r\n.,;:!?()[]{}<>"''')) as s, e - length(m) + length(rtrim(m, E' \t\r\n.,;:!?()[]{}<>"''')) as e
  from placed where k = 4 and (contains(m, '@') or length(regexp_replace(m, '[^0-9]', '', 'g')) >= 4)
), free as (
  select r, s, e from tokens where e - s >= 5 and not exists (select 1 from base b where b.r = tokens.r and tokens.s < b.e and b.s < tokens.e)
), spots as (
  select r, s, e, kind from base union all select r, s, e, '?' from free
), around as (
  select r, s, e, kind, substring(t, s + 1, e - s) as instance, substring(t, greatest(s - 60, 0) + 1, least(s, 60)) as front, substring(t, s - 60, 1) as cut from spots join docs using (r)
), contexts as (
  select r, s, e, kind, instance, list_reverse(list_reverse(w)[1:2]) as w from (select *, case when s > 60 and regexp_matches(cut, '^\p{L}') and regexp_matches(front, '^\p{L}') then regexp_extract_all(front, '\p{L}+')[2:] else regexp_extract_all(front, '\p{L}+') end as w from around)
), found as (
  select r, s, e, kind, instance, lower(w[1] || ' ' || w[2]) as pattern from contexts where len(w) = 2
), edges as (
  select distinct pattern, instance, kind from found
), labels as (
  select pattern, kind as label, count(*) as support from edges where kind <> '?' group by all
), g0 as (
  select e.pattern, l.label, l.support, e.instance, case when e.kind = l.label then 1.0::double else 0.0::double end as conf, e.kind = '?' as free from edges e join labels l using (pattern)
), p0 as (select pattern, label, avg(conf) as p from g0 group by all),
b0 as (select instance, label, 1 - exp(sum(ln(1 - 0.5 * p))) as q from g0 join p0 using (pattern, label) where free group by all),
g1 as (select pattern, label, support, instance, case when free then coalesce(q, conf) else conf end as conf, free from g0 left join b0 using (instance, label)),
p1 as (select pattern, label, avg(conf) as p from g1 group by all),
b1 as (select instance, label, 1 - exp(sum(ln(1 - 0.5 * p))) as q from g1 join p1 using (pattern, label) where free group by all),
g2 as (select pattern, label, support, instance, case when free then coalesce(q, conf) else conf end as conf, free from g1 left join b1 using (instance, label)),
p2 as (select pattern, label, avg(conf) as p from g2 group by all),
b2 as (select instance, label, 1 - exp(sum(ln(1 - 0.5 * p))) as q from g2 join p2 using (pattern, label) where free group by all),
g3 as (select pattern, label, support, instance, case when free then coalesce(q, conf) else conf end as conf, free from g2 left join b2 using (instance, label)),
good as (
  select pattern, label from g3 group by all having avg(conf) >= 0.8 and max(support) >= 5
), added as (
  select r, s, e, min(label) as kind from found join good using (pattern) where kind = '?' group by all
), spans as (
  select r, s, e, kind, true as own from base union all select r, s, e, kind, false from added
), ordered as (
  select r, kind || ':' || s || ':' || e as x, s, e, list_position(['email', 'ip', 'card', 'phone'], kind) as k, own from spans
), joined as (
  select r, string_agg(x, ',' order by s, k, e) filter (where own) as base, string_agg(x, ',' order by s, k, e) as every, count(*) as n,
    count(*) filter (where own and k = 1) as a, count(*) filter (where own and k = 2) as b, count(*) filter (where own and k = 3) as c, count(*) filter (where own and k = 4) as d from ordered group by r
)
select doc_id, coalesce(a, 0) as n_email, coalesce(b, 0) as n_ip, coalesce(c, 0) as n_card, coalesce(d, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans, coalesce(n, 0) as n_all from docs left join joined using (r)
"""

OP10_SQL = """
with v as (
  select vec_id, list_resize(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)), (select max(len(embedding)) from embeddings), 0) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pack, op2_main_text, op3_decontaminate, op4_language, op5_secrets, op6_jaccard, op7_repeats, op8_personal, op9_quality, op10_top_k)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op5_secrets": OP5_SQL, "op6_jaccard": OP6_SQL, "op7_repeats": OP7_SQL, "op8_personal": OP8_SQL, "op10_top_k": OP10_SQL}
