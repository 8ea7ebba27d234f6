"""The queries over the operators of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import bpe, flat_graph, importance, language_id, media, ngram_join, packing, periodic, ring, secrets, sentence_pieces, substring_dedup, warc
from lodewell.plans.storage import table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.clusters(table(spark, sf_dir, "documents")).drop("removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, path).drop("url")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.json"), emit_ids=False)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.tiktoken"), digests=True)


def op8_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.media_of(table(spark, sf_dir, "documents")))


def op9_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ring.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")[0], digests=True)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_substring_dedup, op2_language_id, op3_embedding_near_dedup, op4_warc_writer, op5_secret_scan, op6_packing, op7_byte_bpe, op8_signature_sniffing, op9_hash_ring, op10_ngram_jaccard_join, op11_periodic_runs, op12_sentencepiece, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in ops}


ORACLES = {
    "op3_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and list_dot_product(embedding::double[], embedding::double[]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from embeddings
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), comp as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n_links from links group by a)
select c.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept
from comp c left join n using (vec_id)
""",
    "op10_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]) when len(w) > 0 then [array_to_string(w, chr(31))] else [] end)) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)
), reach(a, b) as (select doc_id, doc_id from w union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id from comp left join n using (doc_id)
""",
    "op4_warc_writer": """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as d from pages),
k as (select d, max(page_id) as keeper from p where n >= 1000 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
  case when k.keeper is not null and k.keeper <> p.page_id then 'revisit' else 'response' end as record_type,
  case when k.keeper <> p.page_id then k.keeper end as refers_to
from p left join k on p.d = k.d
""",
}

def _little(n: str) -> str:
    """The four bytes of a number, lowest first, in hex."""
    return " || ".join(f"format('{{:02x}}', ({n}) >> {8 * k} & 255)" for k in range(4))


def _crc_table() -> list[int]:
    """What a byte does to a CRC-32, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


ORACLES["op8_signature_sniffing"] = f"""
with t as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, octet_length(b) as n, greatest(1, (octet_length(b) + {media.UNIT - 1}) // {media.UNIT}) * {media.UNIT} as m, hex(b) as h from t),
q as (select doc_id, n, m, unhex(h || repeat('ff', m - n)) as payload, h || repeat('FF', m - n) as h from p),
r as (select *, unhex('52494646' || {_little("36 + m")} || '57415645666d74201000000001000100' || {_little(str(media.RATE))} || {_little(str(media.RATE))} || '0100080064617461' || {_little("m")} || h) as media,
  list_transform(range(32), lambda i: ('0x' || substring(right(h, 64), 2 * i + 1, 2))::ubigint) as tail from q)
select doc_id, n::bigint as n_bytes, m::bigint as payload_bytes, sha256(payload) as payload_sha256,
  xor(list_reduce(list_concat([4294967295::ubigint], tail), lambda a, b: xor(a >> 8, ({_crc_table()}::ubigint[])[(xor(a, b) & 255)::int + 1])), 4294967295::ubigint)::bigint as tail_crc32,
  (44 + m)::bigint as media_bytes, sha256(media) as media_sha256, 'declared=application/octet-stream|type=audio/wav|corrected=1|samples=' || m || '|carved=' as feature from r
"""

_RING = ring.Ring()
ORACLES["op9_hash_ring"] = f"""
with recursive t as (select doc_id, encode(coalesce(text, '')) as b from documents),
d as (select doc_id, (octet_length(b) + 8)::bigint as size, ('0x' || substring(md5(doc_id::varchar), 1, 15))::bigint as place,
  xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(octet_length(b)), lambda i: ('0x' || substring(hex(b), 2 * i::int + 1, 2))::ubigint)), lambda a, c: xor(a >> 8, ({_crc_table()}::ubigint[])[(xor(a, c) & 255)::int + 1])), 4294967295::ubigint)::bigint as crc from t),
spots as (select ('0x' || substring(md5(s || '/' || v), 1, 15))::bigint as p, s from range({_RING.shards}) x(s), range({_RING.vnodes}) y(v)),
own as (select list(s order by p, s) as o, (select count(*) from d) as n from spots),
r as (select *, (select count(*) from spots where p < place) % {_RING.shards * _RING.vnodes} as arc from d),
r2 as (select *, row_number() over (order by arc, place, doc_id, size, crc) as i from r),
walk as (
  select 0::bigint as i, list_transform(range({_RING.shards}), lambda s: 0::bigint) as loads, null::bigint as shard, null::bigint as slot
  union all
  select i, list_transform(loads, lambda x, k: x + case when k = s + 1 then 1 else 0 end), s, loads[s + 1] from (
    select r2.i, loads, list_filter(list_concat(o[arc + 1:], o[:arc]), lambda s: loads[s + 1] < n // {_RING.shards} + case when s < n % {_RING.shards} then 1 else 0 end)[1] as s from walk join r2 on r2.i = walk.i + 1, own))
select doc_id, size, crc as text_crc32, 'rows' as law, shard::int as shard, slot, null::int as grown_shard from r2 join walk using (i)
"""

_RUN = periodic.Params()
ORACLES["op11_periodic_runs"] = rf"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, encode(doc_id::varchar) as e from documents),
c as (select doc_id, w, len(w) as n, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(octet_length(e)), lambda i: ('0x' || substring(hex(e), 2 * i::int + 1, 2))::ubigint)), lambda x, y: xor(x >> 8, ({_crc_table()}::ubigint[])[(xor(x, y) & 255)::int + 1])), 4294967295::ubigint)::bigint as h from t),
a as (select doc_id, w, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, h // 10 as g from c),
p as (select doc_id, n, case when a is null then w else list_concat(w[:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) end as w from a),
u as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from p),
pairs as (select x.doc_id, x.i, y.i - x.i as q from u x join u y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and {_RUN.min_periods} * (y.i - x.i) <= x.n),
isles as (select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as isle from pairs) group by doc_id, q, isle having count(*) + q >= greatest({_RUN.min_words}, {_RUN.min_periods} * q)),
runs as (select doc_id, s, l, min(q) as q from isles group by all),
best as (select doc_id, count(*) over (partition by doc_id) as n_runs, s, l, q, row_number() over (partition by doc_id order by l / q desc, s, q) as k from runs),
texts as (select doc_id, string_agg(word, ' ' order by i) as kept from u where not exists (select 1 from runs r where r.doc_id = u.doc_id and u.i >= r.s + r.q and u.i < r.s + r.l) group by doc_id),
lists as (select doc_id, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed from runs group by doc_id)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from t left join (select * from best where k = 1) b using (doc_id) left join lists using (doc_id) left join texts using (doc_id)
"""

_SPARSE = importance.Params()
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_importance_resampling"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
a as (select doc_id, w, count(*) as n from (select doc_id, unnest(w) as w from d) group by all),
b as (select w, count(*) as n from (select unnest({_WORDS}) as w from benchmark) group by all),
v as (select w, encode(w) as e from (select w from a union select w from b)),
c as (select w, (xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(octet_length(e)), lambda i: ('0x' || substring(hex(e), 2 * i::int + 1, 2))::ubigint)), lambda x, y: xor(x >> 8, ({_crc_table()}::ubigint[])[(xor(x, y) & 255)::int + 1])), 4294967295::ubigint) % {_SPARSE.buckets})::int as k from v),
s as (select k, sum(n)::double as s from a join c using (w) group by k),
t as (select k, sum(n)::double as t from b join c using (w) group by k),
tot as (select coalesce((select sum(s) from s), 0) as ss, coalesce((select sum(t) from t), 0) as tt),
g as (select k, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {_SPARSE.buckets}) / ((coalesce(s, 0) + 1) * (tt + {_SPARSE.buckets}))))::bigint as g from s full join t using (k), tot),
m as (select doc_id, sum(n * g) as g, sum(n)::bigint as n from a join c using (w) join g using (k) group by doc_id),
f as (select d.doc_id, coalesce(n, 0)::bigint as n, len(d.w) as words, case when n > 0 then floor(m.g::double / n)::bigint else 0 end as weight,
  ('0x' || substring(sha256('{_SPARSE.seed}:' || d.doc_id), 1, 8))::ubigint::double as h from d left join m using (doc_id)),
r as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))))::bigint as score from f),
p as (select doc_id, row_number() over (order by score desc, doc_id) as i, count(*) over () as n from r where words >= {_SPARSE.min_words})
select r.doc_id, r.n as n_features, weight, score, case when i <= p.n * {_SPARSE.share[0]} // {_SPARSE.share[1]} then i end as rank from r left join p using (doc_id)
"""

_KINDS = ((secrets.ASSIGN.replace("\\\"", '"'), 0), (secrets.ACCESS, 1), (secrets.HEX, 2), (secrets.CANDIDATE, 3))
_ASSIGN = _KINDS[0][0].replace("'", "''")
_FOUND = " union all ".join(f"select doc_id, {k} as kind, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gs from t" for p, k in ((p.replace("'", "''"), k) for p, k in _KINDS))
_ALLOWED = " or ".join(f"regexp_matches(m, '{p}')" for p in secrets.ALLOW)
_NAMES = "case kind " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(secrets.KINDS)) + " end || ':' || start || ':' || stop"

ORACLES["op5_secret_scan"] = f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
f as ({_FOUND}),
p as (select doc_id, kind, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'s': list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0), 'm': ms[k]}})) as x from f where len(ms) > 0),
q as (select doc_id, kind, x.s::bigint as start, (x.s + length(x.m))::bigint as stop, x.m as m from p),
r as (select doc_id, kind, start, stop, {_NAMES} as name from q where kind in (1, 2) or (kind = 0 and length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12)
  or (kind = 3 and not ({_ALLOWED}) and list_max(list_transform(range(1, length(m) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(substring(m, i, {secrets.WINDOW}), ''), 'entropy')))
    >= case when regexp_matches(m, '^[0-9a-fA-F]+$') then {secrets.HEX_BITS} else {secrets.MIXED_BITS} end)),
a as (select doc_id, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex,
  string_agg(name, ',' order by start, kind) filter (where kind < 3) as base, string_agg(name, ',' order by start, kind, stop) as spans from r group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join a using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
