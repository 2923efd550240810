"""DuckDB SQL of the queries that write and read files: the rows that went in."""

from __future__ import annotations

from . import fixtures as X
from .layer_sql import INPUTS, ORIENTED, PATHS
from .round_trips import K


def oracles(reads: str, counts, rc) -> dict[str, str]:
    """``reads`` are the CTEs of the reads, ``counts`` and ``rc`` the helpers of the other queries' SQL."""
    named = "rid::varchar || '/' || mate::varchar"
    compat = X.compat_inputs_sql(X.DUCKDB)
    both = f"{reads}, {counts('a', 31)}, {counts('b', K)}, c as (select 31 as k, * from a union all select {K}, * from b)"
    pairs = f"{reads}, p as (select rid as pair_id, max(case when mate = 1 then seq end) as r1, max(case when mate = 2 then seq end) as r2 from reads group by rid)"
    return {
        "file_fasta": f"with {reads} select {named} as id, seq from reads",
        "file_list": f"with {reads} select {named} as id, seq from reads",
        "file_fastq": f"with {reads} select {named} as id, seq, translate(seq, 'ACGTN', '@+IF#') as qual from reads",
        "file_interleaved_pairs": f"with {pairs} select r1, r2, count(*) as n from p group by all",
        "file_paired_reads": f"with {pairs} select row_number() over (order by pair_id) - 1 as pair_id, r1, r2 from p",
        "file_kmer_text": f"with {reads}, one as (select seq from reads where mate = 1), {counts('a', K, 'one')}, t as (select * from a where cnt > 2) select kmer, cnt from t union all select {rc('kmer')}, cnt from t where {rc('kmer')} not in (select kmer from t)",
        "file_kmer_dots": f"with {reads}, {counts('c', K)} select lower(kmer) || ';' as line from c",
        "file_kmer_folders": f"with {both} select * from c",
        "file_histogram": f"with {both} select k, least(cnt, 10000) as abundance, count(*) as n from c group by all",
        "file_kmers_by_count": f"with {reads}, {counts('c', K)} select kmer || ' ' || cnt::varchar as line, row_number() over (order by cnt, kmer) - 1 as ord from c",
        "file_edges": f"with {INPUTS} select src::varchar as u, dst::varchar as v from item_edges",
        "file_pair_support": f"with {compat}, known as (select kmer from places where depth < 200) select k1, k2, cnt from pairs where k1 in (select kmer from known) and k2 in (select kmer from known)",
        "file_depths": f"with {compat} select kmer, depth, vid::varchar as root from places where vid < 50",
        "file_condensed_graph": f"with {PATHS} select vid, seq, length(seq) as n from item_places union all select src, '', dst from item_edges",
        "file_support_lists": f"with {PATHS},\n{ORIENTED} select * from ori",
        "file_paths": f"""with {PATHS}, t as (select path_id, nodes, list_transform(nodes, lambda v: v % 8) as depths, '>' || (len(nodes) / 2)::double::varchar || '>' || path_id::varchar as h from item_paths)
          select h[2:] as path_id, h || '__1' as header, array_to_string(nodes, ',') as nodes, array_to_string(depths, ',') as depths from t""",
        "file_sam": f"with {X.SAM.format(text='varchar')} select * from sam",
        "file_trace": f"with {X.TRACE.format(text='varchar')} select size, loglik, removed, missed from trace",
        "file_candidate_sets": "select dense_rank() over (order by o_custkey) - 1 as set_id, o_orderkey::varchar as path_id from orders",
        "file_start_order": f"with {reads}, {counts('c', K)} select kmer, row_number() over (order by cnt desc, kmer) - 1 as ord from c",
        "file_k_values": "select (row_number() over (order by p_size desc) - 1)::int as ord, p_size as k from (select distinct p_size from part)",
    }
