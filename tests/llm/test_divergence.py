import random
import re
from collections import Counter, defaultdict

import pytest

from braidmill.llm import divergence as D

from .helpers import LOWER, same

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long, value long, rank int, item int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, 2, 3, 4) for i, (t, lang, source) in enumerate(rows)], COLUMNS)


def plain(rows, least=10, top=10):
    """Dense counts of every group and kept term."""
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER))
        n[lang, source].update(terms)
        held[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, c in held[lang].items() if c >= least)
        sources = [s for la, s in groups if la == lang]
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares(n[lang, source]), shares(sum((n[lang, s] for s in sources), Counter()))
        pairs = []
        for s in sources:
            if s != source:
                other = shares(n[lang, s])
                pairs.append((-sum(f(p[t], other[t]) for t in kept), s.encode()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if n[lang, source][t] > 0 and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return out


def odd_rows(seed=4):
    rng = random.Random(seed)
    words = "alpha Beta GAMMA delta Über naïve ünï straße x東京 don't e-mail a1b The the THE ﬀ ŸÿΣς".split() + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", " ", "!", "7", "\n", "\x00", "\t"]) for _ in range(rng.randrange(60))), rng.choice(["de", "en", None, ""]), rng.choice(["s1", "s2", "s10", None, "S", "ü", "𝒵", "￮"])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "en", "quiet"), ("12 34 ...", "de", "silent"), ("rare words alone", "fr", "only"), ("nothing kept", "fr", "other"), (None, None, None), ("lonely lonely", "xx", "single")]
    rows += [("copy of one text " * 5, "en", "hot")] * 40  # repeated rows, a large group
    rows.append(("tie " * 3 + "knot " * 3 + "very long " * 40_000, "en", "s2"))
    return rows


def test_audit_by_brute_force(spark):
    rows = odd_rows()
    got = D.divergence_audit(table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    same(got.collect(), plain(rows))
    same(D.divergence_audit(table(spark, rows), 2, 3).collect(), plain(rows, 2, 3))


@pytest.mark.parametrize("held, piece", [(3, 8), (1 << 18, 1)])
def test_bounds_of_tasks_change_nothing(spark, monkeypatch, held, piece):
    monkeypatch.setattr(D, "_HELD", held)
    monkeypatch.setattr(D, "_PIECE", piece)
    rows = odd_rows(8)[:-1]
    same(D.divergence_audit(table(spark, rows), 4).collect(), plain(rows, 4))


def test_empty_tables_and_texts(spark):
    assert D.divergence_audit(table(spark, []).limit(0)).collect() == []
    rows = [(None, "en", "a"), ("", "en", "b"), ("x", None, "c")]
    same(D.divergence_audit(table(spark, rows)).collect(), plain(rows))
    same(D.divergence_audit(table(spark, rows), 1).collect(), plain(rows, 1))


def test_shares_of_any_size(spark):
    for count, total, terms in [(0, 0, 1), (5, 17, 3), (10**15, 3 * 10**15, 10**9), (9 * 10**17, 10**18, 7)]:
        row = spark.sql(f"select {D._p(f'{count}L', f'{total}L', f'{terms}L')} as p").first()
        assert row.p == 1 + 10**9 * (count + 2) // (total + 2 * terms)
    for p, q in [(1, 1), (10**9 + 1, 1), (123456789, 987654321)]:
        assert spark.sql(f"select {D._f(f'{p}L', f'{q}L')} as f").first().f == (p - q) ** 2 // (p + q)


def test_equal_columns_are_counted_once(spark):
    rows = [(f"t{chr(97 + k)} u{chr(97 + k)}", "en", "a") for k in range(20)] * 3
    docs = table(spark, rows)
    counts = D.term_counts(docs)
    assert counts.count() == 40 and {(r.n, r.n_docs) for r in counts.collect()} == {(3, 3)}
    same(D.divergence_audit(docs, 3).collect(), plain(rows, 3))
