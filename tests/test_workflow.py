"""The workflow on reads whose mates reach over all sites at which the variants differ."""

import random

from braidmill.operators import evaluate
from braidmill.plans.reconstruct import candidates, reconstruct

COMPLEMENT = str.maketrans("ACGT", "TGCA")
SITES = (90, 128, 166, 204)


def variants_and_pairs(seed, errors):
    """Three variants of 300 bases, and read pairs of 2 x 60 bases that span 160, from every place."""
    rng = random.Random(seed)
    base = [rng.choice("ACGT") for _ in range(300)]
    variants = []
    for kind, sites in (("ACGT", ()), ("CGTA", (SITES[0], SITES[2], SITES[3])), ("TACG", (SITES[1], SITES[3]))):
        variants.append("".join(kind["ACGT".index(b)] if i in sites else b for i, b in enumerate(base)))
    rows = []
    for h, g in enumerate(variants):
        for at in range(141):
            rows += [(g[at : at + 60], g[at + 100 : at + 160])] * (4 + 2 * h)
    for i in rng.sample(range(len(rows)), errors):  # the last base of a first mate is misread
        one, two = rows[i]
        rows[i] = (one[:-1] + "ACGT"["ACGT".index(one[-1]) - 1], two)
    return variants, [(i, one, two.translate(COMPLEMENT)[::-1]) for i, (one, two) in enumerate(rows)]


def test_all_variants_are_found(spark):
    variants, rows = variants_and_pairs(1, 0)
    out = reconstruct(spark.createDataFrame(rows, "pair_id long, r1 string, r2 string"), k=21, genome=300, beam=15, insert=160, edge_threshold=2)
    truths = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(variants)], "hap_id string, seq string")
    found = out["final"].select("path_id", "seq").collect()
    hits = evaluate.containment(truths, out["final"].select("path_id", "seq")).collect()
    assert {r.ids for r in hits} == {"v0", "v1", "v2"}
    assert len({r.found_id for r in hits}) > len(found) / 2
    assert {r.seq for r in found} >= {v for g in variants for v in (g, g.translate(COMPLEMENT)[::-1])}  # whole, on both strands


def test_edited_graphs(spark):
    """Tips of misread bases go, all k-mers of the variants stay, and weak support is not counted."""
    variants, rows = variants_and_pairs(1, 25)
    out = candidates(spark.createDataFrame(rows, "pair_id long, r1 string, r2 string"), k=21, beam=3, insert=160, tip_coverage=3.0, least_support=3)
    words = lambda seqs: {s[i : i + 21] for s in seqs for i in range(len(s) - 20)}
    true = words(v for g in variants for v in (g, g.translate(COMPLEMENT)[::-1]))
    seen = {r.kmer for r in out["own"].where("cnt > 0").collect()}
    left = words(r.seq for r in out["unitigs"].collect())
    assert seen - true and true <= left and len(left - true) < len(seen - true) / 2
    vertices = {r.vid for r in out["unitigs"].collect()}
    assert {v for r in out["cond_edges"].collect() for v in r} <= vertices
    assert vertices == {r.vid for r in out["depth"].collect()} and {v for r in out["paths"].collect() for v in r.nodes} <= vertices
    assert all(r.cnt > 3 for r in out["compat"].collect())
    edges = {tuple(r) for r in out["edges"].collect()}
    kept = {tuple(r) for r in out["supported_edges"].select("u", "v").collect()}
    assert kept <= edges and kept
