"""DuckDB SQL with the rows of the queries that SQL can express.

The URL classifier (op1), the license rules (op6), the quality network (op10)
and the token counts (op12) have none; tests hold them against brute-force versions and held-out labels.
"""

from __future__ import annotations

from .centroids import CLUSTERS, ROUNDS, SCALE, WIDTH
from .centroids import SEED as CLUSTER_SEED
from .mixing import OTHER, SEED, WEIGHTS
from .sharding import PARTS, SHARDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"

_WEIGHT = "case " + " ".join(f"when src = '{s}' then {w!r}" for s, w in WEIGHTS.items()) + f" else {OTHER!r} end"

OP2 = f"""
with rates as (
  select src, w / sum(w) over () * sum(n) over () / n as mean
  from (select coalesce(source, '') src, count(*)::double n, {_WEIGHT}::double w from documents group by 1)),
cdf as (
  with recursive t(src, mean, k, p, s) as (
    select src, mean, 0, exp(-mean), exp(-mean) from rates
    union all
    select src, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) from t where k < 127)
  select * from t),
drawn as (
  select d.doc_id, d.source, d.text, '{SEED}:' || coalesce(d.doc_id::varchar, 'null') as key,
    (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, 'null') || ':0'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents d),
counted as (
  select drawn.*, (select count(*) from cdf where cdf.src = coalesce(drawn.source, '') and cdf.s < drawn.u)::int as copies from drawn)
select doc_id, source, text, copy, copies, md5(key || '#' || copy::varchar) as order_key
from (select *, unnest(range(1, copies + 1))::int as copy from counted where copies > 0)
"""

OP3 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') as words from documents),
sh as (
  select distinct doc_id, array_to_string(case when len(words) < 5 then words else words[i:i+4] end, ' ') as g
  from (select *, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
sizes as (select doc_id, count(*) as n from sh group by 1),
links as (
  select a.doc_id as a, b.doc_id as b
  from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2
  having 100 * count(*) >= 75 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id) - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from w
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a)
select w.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id,
  (select count(*) from links where links.a = w.doc_id)::bigint as n_links
from w join reach r using (doc_id) left join sizes s on s.doc_id = w.doc_id
group by w.doc_id
"""

OP4 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as words from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({_LOWER}, '{_ALNUM}') as words from benchmark),
win as (
  select distinct item, array_to_string(words[i:i+9], ' ') as g, least(len(words), 10) as n
  from (select *, unnest(range(1, greatest(len(words) - 8, 2))) as i from b where len(words) > 0)),
lens as (select distinct n from win),
places as (
  select doc_id, i, n, array_to_string(words[i:i+n-1], ' ') as g
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, lens where len(words) >= n)),
found as (select p.doc_id, p.i, p.n, w.item from places p join win w on p.g = w.g and p.n = w.n),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from found) group by 1)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP5 = """
with t as (
  select coalesce('=' || conv_id::varchar, '-') as c, conv_id, coalesce(turn // 64, 4611686018427387904)::bigint as part, coalesce(turn, 4611686018427387904) as turn,
    translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13) || chr(10), '  ') as role, replace(coalesce(text, ''), '<|', '< |') as txt from conversations),
s as (select distinct c, role as speaker from t),
r as (
  select t.*, s.speaker, t.role = s.speaker as own,
    case when t.role = s.speaker then '<|im_start|>assistant' || chr(10) else '<|im_start|>user name=' || t.role || chr(10) end as head,
    t.txt || '<|im_end|>' as body
  from t join s using (c)),
o as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by c, speaker, part order by turn, role, txt rows between unbounded preceding and 1 preceding), 0) as off from r),
p as (
  select c, any_value(conv_id) as conv_id, speaker, part, count(*)::bigint as n_turns, count(*) filter (own)::bigint as n_own,
    string_agg(head || body || chr(10), '' order by turn, role, txt) as text,
    coalesce(string_agg((off + length(head))::bigint::varchar || '-' || (off + length(head) + length(body))::bigint::varchar, ',' order by turn, role, txt) filter (own), '') as mask_spans
  from o group by c, speaker, part)
select conv_id, speaker, part, n_turns, n_own, text, mask_spans,
  coalesce(sum(length(text)) over (partition by c, speaker order by part rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
from p
"""


def _jump(shards: int) -> str:
    return f"""(
      with recursive t(k, i, b, j) as (
        select k, 0, -1::bigint, 0::bigint from (select distinct coalesce(doc_id::varchar, 'null') as k from documents)
        union all
        select k, i + 1, j, floor((j + 1) / ((('0x' || substr(md5(k || ':' || i::varchar), 1, 13))::bigint + 1) / 4503599627370496.0::double))::bigint from t where j < {shards})
      select k, max(b)::int as shard from t group by k)"""


OP7 = f"""
with bytes as (select doc_id, text, coalesce(doc_id::varchar, 'null') as k, hex(encode(coalesce(text, ''))) as h from documents),
crc_table as (
  with recursive c(n, step, v) as (
    select n, 0, n::bigint from range(256) t(n)
    union all
    select n, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from c where step < 8)
  select list(v order by n) as tab from c where step = 8),
sized as (
  select doc_id, k, (length(h) // 2 + 8)::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda c, b: xor(c >> 8, tab[xor(c, b) & 255 + 1])), 4294967295) as text_crc32
  from bytes, crc_table),
placed as (
  select s.*, a.shard, g.shard as grown_shard,
    ((('0x' || substr(md5(s.k), 1, 8))::bigint + text_crc32) % {PARTS})::int as part
  from sized s join {_jump(SHARDS)} a on a.k = s.k join {_jump(SHARDS + 1)} g on g.k = s.k)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by part, doc_id, text_crc32, size)::bigint - 1 as slot, grown_shard
from placed
""".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")

OP8 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vec from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

OP9 = f"""
with w as (select doc_id, ('0x' || substr(md5(text), 1, 15))::bigint as key, regexp_extract_all({_LOWER}, '{_SPACE}') as words from documents where text is not null),
st as (
  select doc_id, key, i, md5(array_to_string(words[i+1:i+50], ' ')) as g
  from (select doc_id, key, words, unnest(range(0, len(words) - 49)) as i from w where len(words) >= 50)),
again as (select g, min(struct_pack(k := key, p := i)) as first from st group by g having count(*) > 1),
hits as (select st.doc_id, st.i, first.k as copy_key, first.p as copy_word from st join again using (g)),
marked as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from hits),
runs as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from marked),
spans as (select doc_id, min(i)::bigint as start_word, (max(i) + 50)::bigint as end_word, arg_min(copy_key, i) as copy_key, arg_min(copy_word, i)::bigint as copy_word from runs group by doc_id, run)
select s.doc_id, start_word, end_word, end_word - start_word as n_words, (select min(w.doc_id) from w where w.key = s.copy_key) as copy_of, copy_word from spans s
"""

_SHARE = "1 + 1000000000::hugeint * ({n} + 2) // ({all} + 2 * v)"

OP11 = f"""
with t as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
occ as (select d, lang, source, unnest(w) as term from t),
kept as (select lang, term from occ group by all having count(distinct d) >= 10),
n as (select lang, source, term, count(*) as n from occ join kept using (lang, term) group by all),
terms as (select lang, source, coalesce(n, 0) as n, term from (select distinct lang, source from t) join kept using (lang) left join n using (lang, source, term)),
counted as (
  select *, sum(n) over (partition by lang, source) as own, sum(n) over (partition by lang) as whole, sum(n) over (partition by lang, term) as total,
    count(*) over (partition by lang, source) as v
  from terms),
p as (select lang, source, term, n, ({_SHARE.format(n="n", all="own")})::bigint as p, ({_SHARE.format(n="total", all="whole")})::bigint as q from counted),
g as (select distinct lang, source from t),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
above as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from above qualify rank <= 10
"""


def _clusters_sql(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """Every round is two more tables: the nearest centroid of every vector, and the centroids' new components."""
    near = "near{i} as materialized (select r, arg_min(c, (away, c)) as c, min(away) as away from (select r, c, sum((v.x - m.x) * (v.x - m.x)) as away from v join c{i} m using (place) group by r, c) group by r)"
    mean = "c{j} as materialized (select c, place, coalesce(new.x, old.x) as x from c{i} old left join (select n.c, v.place, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as x from near{i} n join v using (r) group by n.c, v.place) new using (c, place))"
    steps = ",\n".join(f"{near.format(i=i)},\n{mean.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select r, unnest(q)::hugeint as x, unnest(range({width})) as place from kept),
first as (select q, row_number() over (order by sha256('{seed}:' || vec_id::varchar), q) - 1 as c from kept where vec_id is not null qualify c < {k}),
c0 as materialized (select c, unnest(q)::hugeint as x, unnest(range({width})) as place from first),
{steps},
{near.format(i=rounds)},
named as (select c, sha256(string_agg(x::varchar, ',' order by place)) as centroid_sha256 from c{rounds} group by c),
spent as (select c, sum(away) as spent from near{rounds} group by c)
select vec_id, c::int as cluster, away::bigint as distance, spent::bigint as cluster_inertia, (select sum(spent) from spent)::bigint as inertia, centroid_sha256
from kept join near{rounds} using (r) join named using (c) join spent using (c)
"""


OP13 = _clusters_sql(CLUSTERS, ROUNDS, WIDTH, SCALE, CLUSTER_SEED)

ORACLES = {
    "op2_mix_sources": OP2,
    "op3_ngram_jaccard_join": OP3,
    "op4_decontaminate": OP4,
    "op5_chat_perspectives": OP5,
    "op7_jump_sharding": OP7,
    "op8_exact_top_k": OP8,
    "op9_repeated_passages": OP9,
    "op11_divergence_audit": OP11,
    "op13_centroid_clusters": OP13,
}
