"""Cleaning, quality, hashing and field extraction over whole tables."""

from pyspark.sql import functions as F

from lodewell.catalog import query
from lodewell.functions import text as X
from lodewell.functions import tokens as T
from lodewell.lexicon import MODULES
from lodewell.plans.storage import table
from lodewell.query_sets.shared import documents

_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("text_whitespace", f"select doc_id, md5({_WS}) as digest, length({_WS}) as n from documents")
def _(spark, d):
    t = X.normalize_whitespace(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).alias("n"))


@query("text_html_strip", "select page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) as digest, length(regexp_replace(html, '<[^>]+>', '', 'g')) as n from pages")
def _(spark, d):
    t = X.remove_html_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).alias("n"))


@query("text_sanitize", r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x{feff}\x{fffe}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as digest from documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.sanitize(F.col("text")).cast("binary")).alias("digest"))


@query("text_headers_footers", r"""
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
m as (select doc_id, text, lines, list_transform(lines, lambda x: regexp_matches(trim(x, E' \t\n\r'), '^.{1,30}[页Pageg|]\s*[0-9]+.{0,10}$') or regexp_matches(trim(x, E' \t\n\r'), '^\s*[\x{4e00}-\x{9fa5}]{1,10}\s*$') or regexp_matches(trim(x, E' \t\n\r'), '^[0-9\-\s]+$')) as odd from l)
select doc_id, case when len(lines) <= 2 then md5(text) else
  md5(array_to_string(lines[(case when odd[1] then 2 else 1 end):(case when odd[len(odd)] then len(lines) - 1 else len(lines) end)], chr(10))) end as digest from m""")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.remove_headers_footers(F.col("text")).cast("binary")).alias("digest"))


@query("text_metadata", r"""
select doc_id, length(text) as char_count, len(string_split(text, chr(10))) as line_count,
  case when length(trim(string_split(text, chr(10))[1])) between 5 and 50 then trim(string_split(text, chr(10))[1]) end as title from documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", X.metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


_COUNT = "len(regexp_extract_all(text, '{0}'))"
_GOOD = _COUNT.format(r"[\x{4e00}-\x{9fff}\x20-\x7e，。！？、；：“”‘’【】（）《》]")

_ASCII = _COUNT.format(r"[\x20-\x7e]")


_QUALITY = rf"""
with a as (select doc_id, length(text) as n, (length(text) - {_GOOD}) / length(text) as g,
  {_ASCII} / length(text) as asc_,
  string_split(text, chr(10)) as lines from documents),
b as (select *, (case when len(list_filter(lines, lambda x: length(trim(x, E' \t\r')) = 0)) > len(lines) * 0.5 then 1 else 0 end
  + case when len(list_filter(lines, lambda x: length(trim(x, E' \t\r')) between 1 and 2)) > len(lines) * 0.3 then 1 else 0 end) / 5.0 as s from a)
select doc_id, round(g, 6) as garbage_ratio, round(s, 6) as structure,
  round(greatest(0.0, least(1.0, 1.0 - g * 0.4 - s * 0.2 - case when n < 20 or g > 0.07 or s > 0 or (asc_ < 0.1 and n >= 20) then 0.1 else 0.0 end)), 6) as score from b"""


@query("text_quality", _QUALITY)
def _(spark, d):
    q = documents(spark, d).select("doc_id", X.quality(F.col("text")).alias("q"))
    return q.select("doc_id", F.round("q.garbage_ratio", 6).alias("garbage_ratio"), F.round("q.structure", 6).alias("structure"), F.round("q.score", 6).alias("score"))


@query("text_quality_labels", f"select quality, count(*) as n, round(avg(score), 4) as avg_score from ({_QUALITY}) join labels using (doc_id) group by quality")
def _(spark, d):
    q = documents(spark, d).select("doc_id", X.quality(F.col("text"))["score"].alias("score"))
    return q.join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(F.round("score", 6)), 4).alias("avg_score"))


@query("text_garble_rate", r"""
select doc_id, case when length(text) > 0 then round((len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) + 2 * len(regexp_extract_all(text, '\x{fffd}+')) + len(regexp_extract_all(text, '\?{2,}'))) / length(text) * 100, 2) else 0.0 end as rate,
  len(regexp_extract_all(text, '[\x00-\x1f\x{80}-\x{a0}]')) / length(text) > 0.05 as corrupted from documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", X.garble_rate(F.col("text")).alias("rate"), X.looks_corrupted(F.col("text")).alias("corrupted"))


@query("text_hashes", "select doc_id, md5(text) as md5_hash, sha256(text) as sha256_hash from documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256_hash"))


@query("text_min_shingle_hash", r"""
with t as (select item_id, regexp_replace(lower(trim(text, E' \t\n\r')), '\s+', ' ', 'g') as t from benchmark)
select item_id, case when length(t) <= 50 then substring(md5(t), 1, 12) else list_min(list_transform(range(1, length(t) - 48), lambda i: substring(md5(substring(t, i, 50)), 1, 8))) end as h from t""")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.min_shingle_hash(F.col("text")).alias("h"))


@query("text_edit_ratio", r"""
with l as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn, text) as before from conversations),
p as (select conv_id, turn, lower(substring(text, 1, 500)) as a, lower(substring(before, 1, 500)) as b from l where before is not null)
select conv_id, turn, round(case when length(a) = 0 or length(b) = 0 then 0.0 when a = b then 1.0 when abs(length(a) - length(b)) > greatest(length(a), length(b)) * 0.5 then 0.0
  else 1.0 - editdist_utf.d / greatest(length(a), length(b)) end, 6) as ratio from p, lateral (select levenshtein(a, b) as d) editdist_utf where length(a) = strlen(a) and length(b) = strlen(b)""")
def _(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    p = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("before is not null")
    ascii_ = lambda x: F.length(F.lower(F.substring(x, 1, 500))) == F.octet_length(F.lower(F.substring(x, 1, 500)))
    return p.where(ascii_(F.col("text")) & ascii_(F.col("before"))).select("conv_id", "turn", F.round(X.edit_ratio(F.col("text"), F.col("before")), 6).alias("ratio"))


@query("text_log_levels", r"""
select doc_id, case when regexp_matches(upper(text), 'ERR|FAIL') then 'ERROR' when contains(upper(text), 'WARN') then 'WARN' when regexp_matches(upper(text), 'DEBUG|DBG') then 'DEBUG' else 'INFO' end as level from documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", X.log_level(F.col("text")).alias("level"))


@query("text_hex_bytes", r"""
select doc_id, 4 as byte_count, list_transform([1, 3, 5, 7], lambda i: ('0x' || substring(md5(text), i, 2))::int)::varchar as byte_values from documents""")
def _(spark, d):
    b = X.hex_bytes(F.concat(F.lit("0x"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8)))
    return documents(spark, d).select("doc_id", b.alias("b")).select("doc_id", "b.byte_count", F.concat(F.lit("["), F.array_join("b.byte_values", ", "), F.lit("]")).alias("byte_values"))


MODULE_SQL = "case " + " ".join(f"when regexp_matches(lower(text), '{words}') then '{name}'" for name, words in MODULES) + " else 'General' end"


@query("text_modules", f"select doc_id, {MODULE_SQL} as module from documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", X.module_of(F.lit(""), F.col("text")).alias("module"))


@query("text_key_terms", r"select item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 2))), ' ') as terms from benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.key_terms(F.col("text")), " ").alias("terms"))


@query("text_bigrams", r"""
with c as (select source, regexp_extract_all(translate(lower(text), 'aeio', '天地人和'), '[天地人和]') as c from documents),
b as (select source, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) as bigram from c)
select distinct bigram, source from b""")
def _(spark, d):
    from lodewell.operators import index as I

    rows = documents(spark, d).select(F.col("doc_id").alias("item_id"), F.col("source").alias("scope"), F.translate(F.lower("text"), "aeio", "天地人和").alias("text"))
    return I.bigram_index(rows).select("bigram", F.col("scope").alias("source"))
