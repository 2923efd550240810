"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from . import fixtures as X
from . import round_trip_sql
from .layer_sql import ORACLES as LAYER_ORACLES
from .registry import BLOOM, GENOME, K, K_PAIRS, SETS

READS = X.reads_sql(X.DUCKDB)
INPUTS = X.compat_inputs_sql(X.DUCKDB)
SAM = X.SAM.format(text="varchar")
TRACE = X.TRACE.format(text="varchar")


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def digits(x: str) -> str:
    return f"translate({x}, 'ACTG', '0123')"


def words(name: str, k: int, source: str = "reads") -> str:
    """name(kmer): every occurrence of a k-mer without N."""
    return f"{name} as (select kmer from (select substring(seq, i, {k}) as kmer from {source} cross join lateral (select unnest(range(1, length(seq) - {k} + 2))) t(i) where length(seq) >= {k}) where not contains(kmer, 'N'))"


def counts(name: str, k: int, source: str = "reads") -> str:
    return f"{words(name + '_w', k, source)},\n{name} as (select kmer, count(*) as cnt from {name}_w group by kmer)"


ONE = "one as (select seq from reads where mate = 1)"
TWO = "two as (select seq from reads where mate = 2)"
MATES = f"{READS}, {ONE}, {TWO}, {counts('a', K, 'one')}, {counts('b', K, 'two')}"


def edges(threshold: int = 0) -> str:
    """edges(u, v) from the distinct (k+1)-mers."""
    return f"""{counts('k0', K)}, {words('k1', K + 1)},
      known as (select kmer from k0 where cnt > {threshold} union select {rc('kmer')} from k0 where cnt > {threshold}),
      fwd as (select distinct kmer[1:{K}] as u, kmer[2:{K + 1}] as v from k1 where kmer[1:{K}] in (select kmer from known) and kmer[2:{K + 1}] in (select kmer from known)),
      edges as (select u, v from fwd union select {rc('v')}, {rc('u')} from fwd)"""


UNITIGS = f"""{READS}, {edges()},
  outs as (select u, count(*) as n, any_value(v) as v from edges group by u having count(*) = 1),
  ins as (select v from edges group by v having count(*) = 1),
  inner_edges as (select u, outs.v from outs join ins on outs.v = ins.v where u <> outs.v),
  nodes as (select u as kmer from edges union select v from edges),
  starts as (select kmer from nodes where kmer not in (select v from inner_edges)),
  walk(root, cur, seq) as (
    select kmer, kmer, kmer from starts
    union all
    select w.root, e.v, w.seq || e.v[{K}:{K}] from walk w join inner_edges e on w.cur = e.u),
  every as (select root, arg_max(seq, length(seq)) as seq from walk group by root),
  every_edge as (select a.root as src, b.root as dst from every a join edges e on right(a.seq, {K}) = e.u join every b on b.root = e.v),
  reach(root) as (
    select root from every where root not in (select dst from every_edge)
    union
    select e.dst from reach r join every_edge e on r.root = e.src),
  unitigs as (select root, seq from every where root in (select root from reach)),
  cond as (select src, dst from every_edge where src in (select root from reach))"""

SMALL = ", ".join(
    (
        X.values_sql("units", "vid, seq", X.UNITIG_ROWS),
        X.values_sql("cedges", "src, dst", X.EDGE_ROWS),
        X.values_sql("compat", "v1, d1, v2, d2, cnt", X.COMPAT_ROWS),
        X.values_sql("steps", "path_id, pos, vid", X.path_steps()),
        X.values_sql("sets", "set_id, path_id", SETS),
    )
)
COVERAGE = "cov as (select l_partkey % 9 as vid, avg(l_quantity) as coverage from lineitem group by 1)"
LOW = f"{COVERAGE}, low as (select vid from cov where coverage < 25.5)"
LOWER = LOW.replace("25.5", "25.3")
ENDS = "ends as (select vid from units where vid not in (select dst from cedges) union select vid from units where vid not in (select src from cedges))"
TIPS = f"{SMALL}, {LOW}, {ENDS}, kept as (select * from units where not (vid in (select vid from low) and vid in (select vid from ends))), kept_edges as (select * from cedges where src in (select vid from kept) and dst in (select vid from kept))"
ALL_LOW = f"{SMALL}, {LOWER}, kept as (select * from units where vid not in (select vid from low)), kept_edges as (select * from cedges where src in (select vid from kept) and dst in (select vid from kept))"

RP = f"""{READS},
  rp2 as (select rid, max(case when mate = 1 then seq end) as r1, {rc("max(case when mate = 2 then seq end)")} as r2 from reads group by rid),
  tall as (select rid, 1 as m, r1 as seq from rp2 union all select rid, 2, r2 from rp2),
  placed as (select rid, m, i, substring(seq, i, {K_PAIRS}) as kmer from tall cross join lateral (select unnest(range(1, length(seq) - {K_PAIRS} + 2))) t(i)),
  fine as (select * from placed where not contains(kmer, 'N')),
  within as (select a.kmer as k1, b.kmer as k2 from fine a join fine b on a.rid = b.rid and a.m = b.m and b.i >= a.i + 5),
  across as (select a.kmer as k1, b.kmer as k2 from fine a join fine b on a.rid = b.rid and a.m = 1 and b.m = 2)"""

KNOWN = f"""{INPUTS},
  known as (select p.k1, p.k2, p.cnt, a.vid as v1, a.depth as d1, b.vid as v2, b.depth as d2 from pairs p join places a on a.kmer = p.k1 join places b on b.kmer = p.k2)"""
COMPAT = f"""{KNOWN},
  compat as (select case when d2 > d1 then v1 else v2 end as v1, case when d2 > d1 then v2 else v1 end as v2, sum(cnt)::bigint as cnt from known group by 1, 2)"""
RING = "ring as (select vid as src, unnest([(vid * 7 + 3) % 97, (vid * 5 + 1) % 97]) as dst from vertices), redges as (select * from ring where dst > src)"
BUBBLES = """bub as (
    select vid from vertices where depth in (select depth from vertices group by depth having count(*) > 1)
    union select vid from vertices where vid not in (select dst from redges)
    union select vid from vertices where vid not in (select src from redges))"""

PAIRS_OF = """pp as (select distinct a.path_id, a.vid as v1, b.vid as v2 from steps a join steps b on a.path_id = b.path_id and b.pos >= a.pos),
  ori as (select c.v1, c.v2, c.cnt, c.d2 - c.d1 + length(u.seq) as span from compat c join units u on u.vid = c.v2 where c.d2 >= c.d1),
  tot as (select sum(cnt) as total from ori)"""


def term(d: str, h: str, penalty: str) -> str:
    q = f"({d}::double / nullif({h} * {GENOME} - {h} * span + 2 * {h}, 0))"
    return f"case when coalesce({d}, 0) > 0 then case when {q} is not null and total - cnt >= 0 and {q} > 0 and {q} < 1 then (total - cnt) * ln(1 - {q}) + cnt * ln({q}) else 0 end else {penalty} end"


def packed(text: str, a: int, n: int) -> str:
    """The number of n letters from place a, two bits each."""
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: substr({digits(f'substr({text}, {a}, {n})')}, i, 1)::bigint * (4 ** ({n} - i))::bigint))::bigint::varchar"


def wide(text: str) -> str:
    return f"{packed(text, 1, 31)} || ',' || {packed(text, 32, 14)}"


# All 16 sets of the four paths by bits, and of each the path whose loss hurts least.
ELIMINATION = f"""with recursive {SMALL}, {PAIRS_OF},
  subsets as (select unnest(range(0, 16))::int as m),
  members as (select m, path_id from subsets join (select distinct path_id from steps) on (m >> path_id) & 1 = 1),
  d as (select m, v1, v2, count(*) as d from members join pp using (path_id) group by all),
  scored as (
    select s.m, sum({term('d.d', 'bit_count(s.m)::bigint', '-1e8 * cnt')}) as loglik, sum(case when d.d is null then cnt else 0 end)::double / any_value(total) as missed
    from subsets s cross join tot cross join ori left join d on d.m = s.m and d.v1 = ori.v1 and d.v2 = ori.v2 group by s.m),
  choice as (
    select a.m, a.path_id as p, b.m as child, b.loglik, b.missed, row_number() over (partition by a.m order by b.loglik desc, a.path_id) as rn
    from members a join scored b on b.m = a.m - (1 << a.path_id)::int where b.loglik <> 0),
  t(step, m) as (select 0, 15 union all select step + 1, child from t join choice using (m) where rn = 1)
  select (step + 1)::int as step, bit_count(child)::int as size, round(loglik, 3) as loglik, p::varchar as removed, round(missed, 9) as missed from t join choice using (m) where rn = 1"""

# In an acyclic graph a depth-first search reaches a vertex on the first of all ways to it, by the order of their vertices.
DEPTHS = f"""with recursive {SMALL},
  walk(vid, depth, root, way) as (
    select vid, 0, vid, seq from units where vid not in (select dst from cedges)
    union all
    select e.dst, w.depth + length(u.seq) - 3, w.root, w.way || '/' || v.seq from walk w join cedges e on e.src = w.vid join units u on u.vid = w.vid join units v on v.vid = e.dst)
  select w.vid::bigint as vid, arg_min(depth, way)::int as depth, (arg_min(depth, way) + any_value(length(seq)) - 4)::int as last_depth, arg_min(root, way)::bigint as root
  from walk w join units u on u.vid = w.vid group by w.vid"""


def set_likelihood(penalty: str) -> str:
    return f"""with {SMALL}, {PAIRS_OF},
      d as (select set_id, v1, v2, count(*) as d from sets join pp using (path_id) group by all),
      sz as (select set_id, count(distinct path_id) as size from sets group by 1)
      select sz.set_id, sz.size::int as size, round(sum({term('d.d', 'size', penalty)}), 3) as loglik, round(sum(case when d.d is null then cnt else 0 end)::double / any_value(total), 9) as missed
      from sz cross join tot cross join ori left join d on d.set_id = sz.set_id and d.v1 = ori.v1 and d.v2 = ori.v2 group by sz.set_id, sz.size"""


BEST_REF = "select qname, arg_min(rname, struct_pack(nm := nm, rname := rname)) as rname, min(nm) as nm from sam group by qname"

def cells(name: str, source: str) -> str:
    """name(kmer, cell): the filter cells of the k-mers of a table."""
    half = lambda at: f"('0x' || substr(md5(kmer), {at}, 15))::bigint % {BLOOM.cells}"
    return f"{name} as (select kmer, unnest([({half(1)} + i * ({half(17)})) % {BLOOM.cells} for i in range({BLOOM.hashes})]) as cell from {source})"


#: A bit is the place from the low end of its byte, bytes from the first on.
_BITS = "string_agg(lpad(lower(to_hex(coalesce(b.v, 0))), 2, '0'), '' order by i)"

ORACLES = LAYER_ORACLES | round_trip_sql.oracles(READS, counts, rc) | {
    "kmer_bloom": f"with {MATES}, {cells('in_cells', 'a')}, turned as (select {rc('kmer')} as kmer from b), {cells('asked', 'turned')}, one_cell as (select distinct cell from in_cells) select kmer, count(*) = count(o.cell) as held from asked left join one_cell o using (cell) group by kmer",
    "kmer_bloom_merged": f"""with {READS}, {counts('c', K)}, {cells('every', 'c')}, one_cell as (select distinct cell from every),
      bytes as (select cell // 32768 as bucket, cell % 32768 // 8 as at, sum(1 << (cell % 8))::int as v from one_cell group by all),
      n as (select cell // 32768 as bucket, count(*) as n_bits from one_cell group by 1)
      select n.bucket::int as bucket, n_bits, {_BITS} as bits from n cross join (select unnest(range(4096)) as i) left join bytes b on b.bucket = n.bucket and b.at = i group by n.bucket, n_bits""",
    "kmer_counter_levels": f"with {READS}, {counts('c', K)}, {cells('every', 'c')}, filled as (select cell, sum(cnt) as n from every join c using (kmer) group by cell) select kmer, least(15, min(n))::int as level from every join filled using (cell) group by kmer",
    "kmer_gated_counts": f"with {READS}, {counts('c', K)} select kmer, cnt from c where cnt >= 3",
    "customer_distinct_sketches": "select o_orderstatus as part, count(distinct o_custkey) as n_distinct, true as within from orders group by 1 union all select 'all', count(distinct o_custkey), true from orders",
    "kmer_count": f"with {READS}, {counts('c', K)} select {K} as k, kmer, cnt from c",
    "kmer_count_multi": f"with {READS}, {counts('c1', 31)}, {counts('c2', 21)}, {counts('c3', 15)} select 31 as k, kmer, cnt from c1 union all select 21, kmer, cnt from c2 union all select 15, kmer, cnt from c3",
    "kmer_count_canonical": f"""with {READS}, {counts('c', 12)}, both_strands as (select kmer, cnt from c union all select {rc('kmer')}, cnt from c)
      select 12 as k, kmer, sum(cnt)::bigint as cnt from both_strands where {digits('kmer')} < {digits(rc('kmer'))} group by kmer""",
    "kmer_merge_canonical": f"with {READS}, {counts('c', K)} select least(kmer, {rc('kmer')}) as kmer, sum(cnt)::bigint as cnt from c group by 1",
    "kmer_solid": f"with {READS}, {counts('c', K)} select {K} as k, kmer, cnt from c where cnt between 10 and 5000",
    "kmer_complements": f"with {READS}, {ONE}, {counts('a', K, 'one')}, t as (select * from a where cnt > 2) select kmer, cnt from t union all select {rc('kmer')}, cnt from t where {rc('kmer')} not in (select kmer from t)",
    "kmer_histogram": f"with {READS}, {counts('c1', 31)}, {counts('c2', 21)} select 31 as k, least(cnt, 10000) as abundance, count(*) as n from c1 group by 2 union all select 21, least(cnt, 10000), count(*) from c2 group by 2",
    "kmer_partition_volumes": f"with {READS}, {words('w', K)} select right(kmer, 3) as bin, count(*) as volume from w group by 1",
    "kmer_diff": f"with {MATES} select a.kmer, a.cnt as cnt_a, coalesce(b.cnt, 0) as cnt_b from a left join b using (kmer) where a.cnt <> coalesce(b.cnt, 0)",
    "kmer_linear_count": f"with {READS}, {words('w', K)}, u as (select count(distinct ('0x' || substr(md5(kmer), 1, 15))::bigint % 65536) as used from w) select 65536::bigint as cells, used, round(-65536.0::double * ln((65536 - used) / 65536.0::double), 4) as estimate, used / 65536.0::double < 0.99 as reliable from u",
    "read_saturating_counts": f"with {READS} select seq, least(count(*), 15) as level from reads group by seq",
    "read_statistics": f"with {READS} select count(*) as n_reads, max(length(seq)) as longest, sum(greatest(length(seq) - {K} + 1, 0))::bigint as volume from reads",
    "read_frequencies": f"with {READS} select seq, count(*) as n from reads group by seq",
    "kmer_merge_partial": f"with {MATES} select kmer, sum(cnt)::bigint as cnt from (select * from a union all select * from b) group by kmer having sum(cnt) >= 50",
    "kmer_later_wins": f"with {MATES} select kmer, coalesce(b.cnt, a.cnt) as cnt from a full join b using (kmer)",
    "sequence_functions": f"""with {READS}, s as (select *, replace(seq[1:12], 'N', 'A') as h from reads), e as (select *, h[2:12] || 'G' as f from s)
      select rid, mate, {rc('seq')} as rc, translate(reverse(seq), 'ACGTN', 'TGCAC') as rc_c, translate(reverse(lower(seq)), 'ACGT', 'TGCA') as rc_keep, left(seq, 5) as pre, right(seq, 5) as suf, right(seq, 1) as last,
        substring(seq, 3, 7) as part, case when {digits(rc('h'))} < {digits('h')} then {rc('h')} else h end as canon, least(h, {rc('h')}) as canon_text,
        list_sum(list_transform(range(1, 13), lambda i: substr({digits('h')}, i, 1)::bigint * (4 ** (12 - i))::bigint))::bigint as packed, h as unpacked,
        case when {digits(rc('f'))} < {digits('f')} then {rc('f')} else f end as extended, case when {digits(rc('f'))} < {digits('f')} then 1 else 0 end as strand, 31 as k_fit, not contains(seq, 'N') as clean from e""",
    "read_segments": f"with {READS}, p as (select rid, mate, list_filter(regexp_split_to_array(seq, 'N+'), lambda x: x <> '') as l from reads) select rid, mate, (i - 1)::int as part, l[i] as segment from p cross join lateral (select unnest(range(1, len(l) + 1))) t(i)",
    "read_length_filter": f"with {READS}, p as (select rid, mate, list_filter(regexp_split_to_array(seq, 'N+'), lambda x: x <> '') as l from reads) select * from (select rid, mate, (i - 1)::int as part, l[i] as seq from p cross join lateral (select unnest(range(1, len(l) + 1))) t(i)) where length(seq) > 29",
    "read_numbers": f"with {READS} select row_number() over (order by rid, mate)::varchar || '_' || length(seq)::varchar as header, seq from reads",
    "read_reversed": f"with {READS} select rid::varchar || '.' || mate::varchar || '_rev' as id, {rc('seq')} as seq from reads",
    "read_fasta_lines": f"with {READS} select '>' || rid::varchar || '/' || mate::varchar || chr(10) || seq as value from reads",
    "read_equal_slices": f"with {READS}, t as (select rid::varchar || '/' || mate::varchar as id, substring(seq, 11, 30) as slice from reads) select slice, string_agg(id, ' ' order by id) as ids from t group by slice",
    "dbg_edges_reads": f"with {READS}, {edges(5)} select u, v from edges",
    "dbg_edges_k1mers": f"with {READS}, {edges()} select u, v from edges",
    "dbg_filtered": f"with {READS}, {edges()}, {ONE}, {counts('a', K, 'one')}, t as (select kmer from a where cnt > 5) select u, v from edges where u in (select kmer from t) and v in (select kmer from t)",
    "dbg_filtered_tolerant": f"with {READS}, {edges()}, {ONE}, {counts('a', K, 'one')}, t as (select kmer from a where cnt > 5 union select {rc('kmer')} from a where cnt > 5) select u, v from edges where u in (select kmer from t) and v in (select kmer from t)",
    "dbg_degrees": f"with {READS}, {edges()} select kmer, count(*) filter (side = 1) as n_in, count(*) filter (side = 0) as n_out from (select u as kmer, 0 as side from edges union all select v, 1 from edges) group by kmer",
    "dbg_sources": f"with {READS}, {edges()} select distinct u as kmer from edges where u not in (select v from edges)",
    "dbg_sinks": f"with {READS}, {edges()} select distinct v as kmer from edges where v not in (select u from edges)",
    "unitig_starts": f"with recursive {UNITIGS} select kmer from starts",
    "unitigs": f"with recursive {UNITIGS} select seq, length(seq)::int as len, left(seq, {K}) as prefix, right(seq, {K}) as suffix from unitigs",
    "cond_edges": f"with recursive {UNITIGS} select a.seq as src_seq, b.seq as dst_seq from cond join unitigs a on a.root = src join unitigs b on b.root = dst",
    "unitig_coverage": f"with recursive {UNITIGS}, m as (select seq, substring(seq, i, {K}) as kmer from unitigs cross join lateral (select unnest(range(1, length(seq) - {K} + 2))) t(i)) select seq, count(*) as n_kmers, round(sum(coalesce(cnt, 0))::double / count(*), 6) as coverage from m left join k0 using (kmer) group by seq",
    "strand_twins": f"with recursive {UNITIGS} select a.seq, b.seq as twin_seq from unitigs a join unitigs b on b.seq = {rc('a.seq')}",
    "tip_removal": f"with {TIPS} select vid::bigint as vid, seq from kept",
    "lowcov_removal": f"with {ALL_LOW} select src::bigint as src, dst::bigint as dst from kept_edges",
    "graph_summary": f"with {TIPS} select (select count(*) from kept) as n_vertices, (select count(*) from kept_edges) as n_edges, (select count(*) from kept where vid not in (select dst from kept_edges)) as n_sources, (select count(*) from kept where vid not in (select src from kept_edges)) as n_sinks",
    "fastg_lines": f"""with {ALL_LOW}, name as (select vid, 'NODE_' || vid::varchar || '_length_' || length(seq)::varchar || '_cov_1.0' as n from kept),
      nxt as (select src as vid, string_agg(name.n, ',' order by dst) as l from kept_edges join name on name.vid = dst group by src)
      select k.vid::bigint as vid, '>' || name.n || coalesce(':' || nxt.l, '') || ';' as header, case when k.vid in (select dst from kept_edges) then substring(seq, 4) else seq end as seq from kept k join name using (vid) left join nxt on nxt.vid = k.vid""",
    "pair_within": f"with {RP} select k1, k2, count(*) as cnt from within group by all",
    "pair_across": f"with {RP} select k1, k2, count(*) as cnt from across group by all",
    "pair_support": f"""with {RP}, {counts('c', K_PAIRS)}, known as (select kmer from c where cnt > 3 union select {rc('kmer')} from c where cnt > 3),
      fwd as (select k1, k2, count(*) as cnt from (select * from within union all select * from across) where k1 in (select kmer from known) and k2 in (select kmer from known) group by all)
      select k1, k2, sum(cnt)::bigint as cnt from (select * from fwd union all select {rc('k2')}, {rc('k1')}, cnt from fwd) group by all having sum(cnt) > 1""",
    "mean_gap": f"with {KNOWN} select count(*) as n_pairs, round(avg(d2 - d1), 6) as mean_gap from known where d2 >= d1",
    "compatible_set": f"with {COMPAT} select v1, v2, cnt from compat",
    "bubble_vertices": f"with {INPUTS}, {RING}, {BUBBLES} select vid from bub",
    "bubble_set": f"""with {KNOWN}, {RING}, {BUBBLES}, summed as (select v1, v2, sum(cnt)::bigint as cnt from known where v1 in (select vid from bub) and v2 in (select vid from bub) group by 1, 2)
      select v1, v2, cnt from summed union all select distinct src, dst, 1::bigint from redges where not exists (select 1 from summed where v1 = src and v2 = dst)""",
    "membership": f"with {COMPAT} select v1, v2, cnt, round(cnt::double / count(*) over (partition by v1), 9) as weight from compat",
    "membership_normalized": f"with {COMPAT} select v1, v2, cnt, round(cnt::double / sum(cnt) over (partition by v1), 9) as weight from compat",
    "compatible_filter": f"with {COMPAT} select v1, v2, cnt from compat where cnt > 20",
    "edges_with_support": f"""with {COMPAT}, alive as (select v1 as vid from compat where cnt > 20 union select v2 from compat where cnt > 20), lost as (select kmer from places where vid not in (select vid from alive))
      select k1 as u, k2 as v from pairs where k1 not in (select kmer from lost) and k2 not in (select kmer from lost)""",
    "support_lists": f"""with {COMPAT} select v1, v1::varchar || ':' || any_value(a.depth)::varchar || ' ' || string_agg(v2::varchar || ':' || b.depth::varchar || ':' || cnt::varchar, ' ' order by b.depth, v2, cnt) as line
      from compat join vertices a on a.vid = v1 join vertices b on b.vid = v2 group by v1""",
    "path_counts": f"with recursive {SMALL}, walk(vid) as (select vid from units where vid not in (select dst from cedges) union all select dst from walk join cedges on src = vid) select count(*)::bigint as n_paths from walk where vid not in (select src from cedges)",
    "path_stitch": f"with {SMALL}, s as (select path_id, string_agg(case when pos = 0 then seq else substring(seq, 4) end, '' order by pos) as seq from steps join units using (vid) group by path_id) select path_id, seq, length(seq)::int as len from s",
    "pair_multiplicity": f"with {SMALL}, {PAIRS_OF} select set_id, v1::bigint as v1, v2::bigint as v2, count(*) as d from sets join pp using (path_id) group by all",
    "set_likelihood": set_likelihood("-1e8 * cnt"),
    "set_likelihood_flat": set_likelihood("-1e10"),
    "leave_one_out": f"""with {SMALL}, {PAIRS_OF}, ps as (select distinct path_id from steps), d as (select r.path_id as gone, p.v1, p.v2, count(*) as d from ps r join pp p on p.path_id <> r.path_id group by all), h as (select count(*) - 1 as h from ps)
      select ps.path_id as removed, any_value(h)::int as size, round(sum({term('d.d', 'h', '-1e8 * cnt')}), 3) as loglik, round(sum(case when d.d is null then cnt else 0 end)::double / any_value(total), 9) as missed
      from ps cross join h cross join tot cross join ori left join d on d.gone = ps.path_id and d.v1 = ori.v1 and d.v2 = ori.v2 group by ps.path_id""",
    "trace_best": f"with {TRACE} select size, loglik, missed from trace order by loglik desc, size desc limit 1",
    "final_set": f"with {TRACE}, best as (select size as b from trace order by loglik desc, size desc limit 1) select o_orderkey as path_id, o_orderpriority as seq from orders where o_orderkey::varchar not in (select removed from trace, best where size > b)",
    "final_set_strict": f"with {TRACE}, best as (select size as b from trace order by loglik desc, size desc limit 1) select o_orderkey as path_id, o_orderpriority as seq from orders where o_orderkey::varchar not in (select removed from trace, best where size >= b)",
    "containment_search": f"""with {READS}, k as (select string_agg('hap_' || h::varchar, ',' order by h) as ids, g from genome group by g)
      select ids, rid::varchar || '/' || mate::varchar as found_id, case when contains(g, seq) then '+' else '-' end as strand from reads join k on contains(g, seq) or contains({rc('g')}, seq)""",
    "unmatched_truths": f"""with {READS}, t as (select 'hap_' || h::varchar as id, g as seq from genome union all select r_name, r_name from region), k as (select string_agg(id, ',' order by id) as ids, seq from t group by seq)
      select ids from k where not exists (select 1 from reads where contains(k.seq, reads.seq) or contains(reverse(translate(k.seq, 'ACGT', 'TGCA')), reads.seq))""",
    "best_per_reference": f"with {SAM} select rname, arg_min(qname, struct_pack(nm := nm, q := qname)) as qname, min(nm) as nm from sam group by rname",
    "best_per_sequence": f"with {SAM} {BEST_REF}",
    "sequences_by_reference": f"with {SAM}, b as ({BEST_REF}) select rname, row_number() over (partition by rname order by nm, qname)::int as rank, qname, nm from b",
    "distance_histogram": f"with {SAM}, b as ({BEST_REF}) select nm, count(*) as n from b group by nm",
    "length_histogram": f"with {SAM} select split_part(qname, '__', 2)::int as len, count(distinct qname) as n from sam group by 1",
    "mean_distance": f"with {SAM}, b as ({BEST_REF}) select rname, count(*) as n, round(avg(nm), 9) as mean_nm from b group by rname",
    "strand_choice": f"with {SAM} select qname, pos, bool_and(flag = 16) as turned from sam group by qname, pos",
    "small_vertex_depths": DEPTHS,
    "small_elimination_trace": ELIMINATION,
    "kmer_packed_wide": f"with {READS}, {counts('c', 45)} select kmer, cnt, {wide('kmer')} as packed, {wide(rc('kmer'))} as packed_rc, kmer as unpacked from c",
    "strand_pairs": f"""with {READS}, {X.MATE_SAM.format(text='varchar')},
      ends as (
        select split_part(qname, '/', 1) as read_id, max(split_part(qname, '/', 2)::int) filter (flag = 0) as plus, max(split_part(qname, '/', 2)::int) filter (flag = 16) as minus
        from mate_sam where flag in (0, 16) group by 1),
      both_ends as (
        select read_id, plus, minus, max(case when mate = plus then seq end) as p, max(case when mate = minus then seq end) as m
        from ends join reads on rid::varchar = read_id group by all)
      select read_id, coalesce(p, {rc('m')}) as plus_seq, coalesce(plus, 3 - minus) as r1_mate, coalesce(p, {rc('m')}) as r1, coalesce(minus, 3 - plus) as r2_mate, coalesce(m, {rc('p')}) as r2
      from both_ends where p is not null or m is not null""",
    "strand_fix": f"with {READS} select rid as read_id, case when o_orderstatus = 'F' then {rc('seq')} else seq end as seq from reads join orders on o_orderkey = rid where mate = 1",
    "subpaths": "select 'p' || p_partkey::varchar || ' ' || p_brand as header, p_name as seq, s_suppkey as ord from part join supplier on p_partkey = s_suppkey",
}
