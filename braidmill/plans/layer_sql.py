"""DuckDB SQL of the queries over the graph of line items.

An edge leads from one line number to the next, so a table for each line number
is as good as a recursion.
"""

from __future__ import annotations

from . import fixtures as X
from .registry import ITEM_BEAM, ITEM_GENOME, ITEM_INSERT

ROWS = range(1, X.LINES + 1)
INPUTS = ",\n".join(x.format(text="varchar").replace(" as (", " as materialized (", 1) for x in (X.ITEMS, X.ITEM_VERTICES, X.ITEM_EDGES, X.ITEM_SUPPORT))
SOURCES = "sources as materialized (select vid from item_vertices where vid not in (select dst from item_edges))"


def _by_line(name: str, first: str, later: str, backward: bool = False) -> str:
    """Tables name1, name2, ... of the vertices of each line, from the one before; ``name`` has them all."""
    order = list(reversed(ROWS)) if backward else list(ROWS)
    tables = [f"{name}{n} as materialized ({(first if i == 0 else later).format(line=n, before=f'{name}{order[i - 1]}')})" for i, n in enumerate(order)]
    return ",\n".join([*tables, f"{name} as materialized ({' union all '.join(f'select * from {name}{n}' for n in ROWS)})"])


LAYERS = _by_line(
    "lay",
    "select vid, 0 as layer from item_vertices where vid % 8 = {line}",
    "select v.vid, coalesce(max(p.layer) + 1, 0)::int as layer from item_vertices v left join item_edges e on e.dst = v.vid left join {before} p on p.vid = e.src where v.vid % 8 = {line} group by v.vid",
)

WAYS = _by_line(
    "way",
    "select vid, 1::hugeint as n from item_vertices where vid % 8 = {line}",
    "select v.vid, coalesce(sum(p.n), 1)::hugeint as n from item_vertices v left join item_edges e on e.dst = v.vid left join {before} p on p.vid = e.src where v.vid % 8 = {line} group by v.vid",
)

DEPTHS = f"""{SOURCES},
begin as materialized (select vid, row_number() over (order by cnt desc, kmer) as place from item_vertices join sources using (vid)),
child as materialized (select src, dst, row_number() over (partition by src order by cnt desc, kmer) as place from item_edges join item_vertices on vid = dst),
""" + _by_line(
    "dep",
    "select vid, [place] as path, 0 as depth, vid as root from begin where vid % 8 = {line}",
    f"""select vid, [place] as path, 0 as depth, vid as root from begin where vid % 8 = {{line}}
      union all
      select dst, path, depth, root from (
        select c.dst, list_append(p.path, c.place) as path, (p.depth + v.len - {X.LINE_K} + 1)::int as depth, p.root
        from child c join {{before}} p on p.vid = c.src join item_vertices v on v.vid = c.src where c.dst % 8 = {{line}})
      qualify row_number() over (partition by dst order by path) = 1""",
)


def sub_paths(name: str, backward: bool, normalized: bool) -> str:
    """Tables of the kept sub-paths of every vertex."""
    partners = "sum(cnt) over (partition by v1)" if normalized else "count(*) over (partition by v1)"
    near_single = "s.share" if backward and not normalized else "1.0::double"
    away = "q.depths[i] - d.depth" if backward else "d.depth - q.depths[i]"
    both = "s.v1 = q.vid and s.v2 = q.nodes[i]" if backward else "s.v2 = q.vid and s.v1 = q.nodes[i]"
    held = f"case when {away} < {ITEM_INSERT} then case when s.bubble = 1 then 2.0::double else {near_single} end else case when s.bubble = 1 then 1.0::double else 0.5::double end end"
    gain = f"case when s.share is null then case when {away} < {ITEM_INSERT} then -c::double else 0.01::double end else ({held}){' * s.share' if normalized else ''} end"
    begin = "case when c = 1 then score else score * c * (c - 1) / 2 end" if backward else "score * c * (c - 1) / 2"
    total = f"list_reduce(list_prepend({begin}, gains), lambda a, b: a + b)"
    value = f"case when c > 1 then 2 * {total} / (c * (c + 1)) else {total} end" if backward else f"least(1.0::double, 2 * {total} / (c * (c + 1)))"
    side, end = ("src", "dst") if backward else ("dst", "src")
    join = (lambda a, b: f"list_prepend({a}, {b})") if backward else (lambda a, b: f"list_append({b}, {a})")
    alone = "select vid, 0 as rank, [vid] as nodes, [depth] as depths, 0.0::double as score from dep where vid % 8 = {line}"
    # of candidates that are all worth 0, those that support something new, one after the other
    takes = f"len(a.kept) < {ITEM_BEAM} and (len(list_filter(x.held, lambda n: not list_contains(a.held, n))) > 0 or len(x.kept[1].nodes) < 2)"
    folded = f"list_reduce(list_prepend({{{{'held': []::bigint[], 'kept': []::struct(nodes bigint[], depths int[])[]}}}}, list({{{{'held': held, 'kept': [{{{{'nodes': nodes, 'depths': depths}}}}]}}}} order by nodes)), lambda a, x: case when {takes} then {{{{'held': list_concat(a.held, x.held), 'kept': list_concat(a.kept, x.kept)}}}} else a end).kept"
    zeros = f"""
      zero as (select vid, unnest(kept) as p, generate_subscripts(kept, 1) - 1 as rank from (select vid, {folded} as kept from b where best = 0 and value = 0 group by vid)),
      more as (select zero.vid, rank::int as rank, {join('zero.vid', 'p.nodes')} as nodes, {join('depth', 'p.depths')} as depths, 0.0::double as score from zero join dep on dep.vid = zero.vid)"""
    later = f"""with
      q as (select e.{side} as vid, p.vid as via, p.rank as r, p.nodes, p.depths, p.score, len(p.nodes) + {0 if backward else 1} as c from item_edges e join {{before}} p on p.vid = e.{end} where e.{side} % 8 = {{line}}),
      x as (select *, unnest(range(1, len(nodes) + 1)) as i from q),
      g as (select q.vid, q.via, q.r, list({gain} order by i) as gains, coalesce(list(q.nodes[i] order by i) filter (s.share is not null), []) as held from x q join dep d on d.vid = q.vid left join {name}_s s on {both} group by all),
      v as (select vid, nodes, depths, held, {value} as value from q join g using (vid, via, r)),
      b as (select *, max(value) over (partition by vid) as best, (row_number() over (partition by vid order by value desc, nodes) - 1)::int as rank from v),
      kept as (select b.vid, rank, {join('b.vid', 'nodes')} as nodes, {join('depth', 'depths')} as depths, case when best = 0 then value else value / best end as score
        from b join dep on dep.vid = b.vid where value >= 0.25 * best and rank < {ITEM_BEAM} {'and best <> 0' if backward else ''}){f",{zeros}" if backward else ""}
      select * from kept
      {'union all select * from more' if backward else ''}
      union all
      {alone} and vid not in (select vid from {'kept union select vid from more' if backward else '(select dst as vid from item_edges)'})"""
    shares = f"{name}_s as materialized (select v1, v2, cnt::double / ({partners})::double as share, bubble from item_support)"
    return f"{shares},\n{_by_line(name, alone, later, backward)}"


_TABLES = [(f"{side}{n}", side == "back", bool(n)) for n in (0, 1) for side in ("back", "ahead")]
_EVERY = " union all ".join(f"select '{name[:-1]}' as side, {name[-1]}::int as normalized, vid, rank, array_to_string(nodes, ',') as nodes, round(score, 6) as score from {name}" for name, _, _ in _TABLES)

COVER = f"""
first as materialized (select vid, 0 as head, rank as tail, nodes, score from back0 where vid in (select vid from sources)),
used as materialized (select distinct unnest(nodes) as vid from first),
out_ as materialized (select vid, depth, row_number() over (order by depth desc, vid) as turn from dep where vid not in (select vid from used)),
ways_ as materialized (
  select h.vid, h.rank as head, t.rank as tail, h.nodes as up, t.nodes as down, list_concat(h.nodes, t.nodes[2:]) as nodes, h.score + t.score as score
  from ahead0 h join back0 t using (vid) where h.rank < 10 and t.rank < 10 and vid in (select vid from out_)),
own as materialized (
  select * from ways_ w where len(nodes) > 1 and not exists (
    select 1 from ways_ e where e.vid = w.vid and (e.head < w.head or (e.head = w.head and e.tail < w.tail))
      and len(e.up) >= len(w.up) and e.up[len(e.up) - len(w.up) + 1:] = w.up and len(e.down) >= len(w.down) and e.down[1:len(w.down)] = w.down)),
through as materialized (select turn, out_.vid, coalesce(list_distinct(flatten(list(nodes))), []) as members from out_ left join own using (vid) group by turn, out_.vid),
walk(turn, taken, seen) as (
  select 0::bigint, true, []::bigint[]
  union all
  select t.turn, not list_contains(w.seen, t.vid), case when list_contains(w.seen, t.vid) then w.seen else list_concat(w.seen, t.members) end
  from walk w join through t on t.turn = w.turn + 1),
chosen as (select out_.vid from walk join out_ using (turn) where taken)
select vid::varchar || '.' || head::varchar || '.' || tail::varchar as path_id, round(score, 6) as score, array_to_string(nodes, ',') as nodes
from (select vid, head, tail, nodes, score from first union all select vid, head, tail, nodes, score from own where vid in (select vid from chosen))
where score >= -10
"""

PATHS = f"{INPUTS},\n{X.ITEM_PLACE.format(text='varchar')},\n{X.ITEM_PATHS['duckdb']}"
ORIENTED = """ori as materialized (
  select v1, v2, cnt, b.depth - a.depth + length(b.seq) as span from item_support join item_places a on a.vid = v1 join item_places b on b.vid = v2 where b.depth >= a.depth),
tot as (select sum(cnt) as total, count(*) as n_pairs from ori)"""
HELD = """steps as (select path_id, unnest(nodes) as v, unnest(range(len(nodes))) as i from item_paths),
held as materialized (select distinct a.path_id, a.v as v1, b.v as v2 from steps a join steps b on a.path_id = b.path_id and a.i <= b.i)"""


def _term(d: str, h: str) -> str:
    q = f"({d})::double / ({h} * {ITEM_GENOME} - {h} * span + 2 * {h})"
    return f"case when {q} > 0 and {q} < 1 and total >= cnt then (total - cnt) * ln(1 - {q}) + cnt * ln({q}) else 0 end"


def _sets(penalty: str) -> str:
    lost = "1e8::double * (total - coalesce(held_cnt, 0))" if penalty == "weighted" else "1e10::double * (n_pairs - coalesce(n_held, 0))"
    return f"""with {PATHS},\n{ORIENTED},\n{HELD},
      s as (select o_orderpriority as set_id, o_orderkey as path_id from orders),
      size as (select set_id, count(distinct path_id) as h from s group by 1),
      d as (select set_id, v1, v2, count(*) as d from (select distinct * from s) join held using (path_id) group by all),
      part as (select set_id, sum({_term('d', 'h')}) as part, sum(cnt) as held_cnt, count(*) as n_held from d join ori using (v1, v2) join size using (set_id) cross join tot group by 1)
      select set_id, h::int as size, round(coalesce(part, 0) - {lost}, 0) as loglik, round((total - coalesce(held_cnt, 0))::double / total, 9) as missed from size left join part using (set_id) cross join tot"""


ELIMINATION = f"""with recursive {X.ITEMS}, {X.CLASS_ITEMS}, {X.CLASS_SUPPORT}, {X.CLASS_STEPS},
  ori as materialized (select v1, v2, cnt, d2 - d1 + len as span from class_support where d2 >= d1),
  tot as (select sum(cnt) as total from ori),
  held as (select distinct a.path_id, a.vid as v1, b.vid as v2 from class_steps a join class_steps b on a.path_id = b.path_id and a.line <= b.line),
  paths as (select distinct path_id from class_steps),
  subsets as (select unnest(range(0, 32))::int as m),
  members as (select m, path_id from subsets join paths on (m >> path_id) & 1 = 1),
  d as (select m, v1, v2, count(*) as d from members join held using (path_id) group by all),
  part as (select m, sum({_term('d', 'bit_count(m)::bigint')}) as part, sum(cnt) as held_cnt from d join ori using (v1, v2) cross join tot group by m),
  scored as (select m, coalesce(part, 0) - 1e8::double * (total - coalesce(held_cnt, 0)) as loglik, (total - coalesce(held_cnt, 0))::double / total as missed from subsets left join part using (m) cross join tot),
  choice as (
    select a.m, a.path_id as p, b.m as child, b.loglik, b.missed, row_number() over (partition by a.m order by b.loglik desc, a.path_id) as rn
    from members a join scored b on b.m = a.m - (1 << a.path_id)::int where b.loglik <> 0),
  t(step, m) as (select 0, (select sum(1 << path_id) from paths)::int union all select step + 1, child from t join choice using (m) where rn = 1)
  select (step + 1)::int as step, bit_count(child)::int as size, round(loglik, 0) as loglik, p::varchar as removed, round(missed, 9) as missed from t join choice using (m) where rn = 1"""

WITHOUT = f"""with {PATHS},
  ends as (select vid from item_vertices where vid not in (select src from item_edges) or vid not in (select dst from item_edges)),
  kept as (select vid from item_vertices where cnt >= 3 or ({{tips}} and vid not in (select vid from ends))),
  kept_edges as (select src, dst from item_edges where src in (select vid from kept) and dst in (select vid from kept))"""
_KEPT = " select vid, null::bigint as dst from kept union all select src, dst from kept_edges"
_NODE = "'NODE_' || {0}::varchar || '_length_' || length({1})::varchar || '_cov_1.0'"

ORACLES = {
    "item_elimination": ELIMINATION,
    "item_tip_removal": WITHOUT.replace("{tips}", "true") + _KEPT,
    "item_lowcov_removal": WITHOUT.replace("{tips}", "false") + _KEPT,
    "item_edit_summary": WITHOUT.replace("{tips}", "true")
    + """ select (select count(*) from kept) as n_vertices, (select count(*) from kept_edges) as n_edges, (select count(*) from kept where vid not in (select dst from kept_edges)) as n_sources,
      (select count(*) from kept where vid not in (select src from kept_edges)) as n_sinks, (select count(*) from item_vertices) - (select count(*) from kept) as n_removed,
      (select count(*) from item_edges) - (select count(*) from kept_edges) as n_lost_edges""",
    "item_fastg_lines": f"""with {PATHS}, tos as (select src, string_agg({_NODE.format('p.vid', 'p.seq')}, ',' order by p.vid) as names from item_edges join item_places p on p.vid = dst group by src)
      select p.vid, '>' || {_NODE.format('p.vid', 'p.seq')} || coalesce(':' || names, '') || ';' as header, case when p.vid in (select dst from item_edges) then p.seq[{X.LINE_K}:] else p.seq end as seq
      from item_places p left join tos on src = p.vid""",
    "item_pair_multiplicity": f"with {PATHS},\n{HELD} select o_orderpriority as set_id, v1, v2, count(*) as d from orders join held on o_orderkey = path_id group by all",
    "item_set_likelihood": _sets("weighted"),
    "item_set_likelihood_flat": _sets("flat"),
    "item_leave_one_out": f"""with {PATHS},\n{ORIENTED},\n{HELD},
      h as (select count(*) - 1 as h from item_paths), d as (select v1, v2, count(*) as d from held group by all),
      t as materialized (select v1, v2, cnt, d, case when d is null then -1e8::double * cnt else {_term('d', 'h')} end as now, case when d = 1 then -1e8::double * cnt else {_term('d - 1', 'h')} end as less from ori left join d using (v1, v2) cross join h cross join tot),
      base as (select sum(now) as base, coalesce(sum(cnt) filter (d is null), 0) as lost from t),
      c as (select path_id, sum(less - now) as change, coalesce(sum(cnt) filter (d = 1), 0) as more from held join t using (v1, v2) group by 1)
      select path_id as removed, h::int as size, round(base + coalesce(change, 0), 2) as loglik, round((lost + coalesce(more, 0))::double / total, 9) as missed from item_paths left join c using (path_id) cross join base cross join h cross join tot""",
    "item_path_stitch": f"""with {PATHS}, steps as (select path_id, unnest(nodes) as vid, unnest(range(len(nodes))) as i from item_paths)
      select path_id, string_agg(case when i = 0 then seq else seq[{X.LINE_K}:] end, '' order by i) as seq, sum(case when i = 0 then length(seq) else length(seq) - {X.LINE_K} + 1 end)::int as len from steps join item_places using (vid) group by 1""",
    "item_layers": f"with {INPUTS},\n{LAYERS}\nselect * from lay",
    "item_path_counts": f"with {INPUTS},\n{WAYS}\nselect vid, n::decimal(38,0) as n from way union all select -1, sum(n)::decimal(38,0) from way where vid not in (select src from item_edges)",
    "item_depths": f"with {INPUTS},\n{DEPTHS}\nselect vid, depth, root from dep",
    "item_sub_paths": f"with {INPUTS},\n{DEPTHS},\n" + ",\n".join(sub_paths(*t) for t in _TABLES) + f"\n{_EVERY}",
    "item_cover": f"with recursive {INPUTS},\n{DEPTHS},\n{sub_paths('back0', True, False)},\n{sub_paths('ahead0', False, False)},\n{COVER}",
}
