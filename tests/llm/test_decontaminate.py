import hashlib
import random

from braidmill.llm import decontaminate as D

from .helpers import alnum_words, documents, odd_documents, same, sentence


def brute(rows, items, window=10):
    out, windows = [], {}
    for i, it in items:
        v = alnum_words(it)
        for q in range(max(1, len(v) - window + 1)) if v else []:
            windows.setdefault(tuple(v[q : q + min(len(v), window)]), set()).add("" if i is None else str(i))
    for d, text in rows:
        w = alnum_words(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    names |= found
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def case():
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 40, 0])] + [(None, sentence(rng, 15)), (100, None), (101, "?!")]
    items.append((20, items[0][1]))
    rows = odd_documents(4)
    for k, (_, t) in enumerate(items):
        rows.append((1000 + k, f"{sentence(rng, 20)} {t} {sentence(rng, 5)}"))
        rows.append((2000 + k, f"{sentence(rng, 4)} {' '.join(alnum_words(t)[:9])} nothing"))
    rows.append((3000, " ".join(t or "" for _, t in items)))
    return rows, items


def test_equals_brute_force(spark):
    rows, items = case()
    b = spark.createDataFrame(items, "item_id long, text string")
    same(D.contamination(documents(spark, rows), b).collect(), brute(rows, items))


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    rows, items = case()
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    same(D.contamination(documents(spark, rows), b).collect(), want)
    plan = D.contamination(documents(spark, rows), b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one worker a task, whatever the number of blocks
    kept = D.remove_contaminated(documents(spark, rows), b).collect()
    same([(r.doc_id, r.text) for r in kept], [r for r, w in zip(rows, want, strict=True) if not w[-1]])


def test_matches_are_longest(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"
    docs = documents(spark, [(1, f"zz {item} yy"), (2, "x " + " ".join(item.split()[1:11]) + " q"), (3, "a1 b2")])
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = [tuple(r) for r in D.longest_matches(docs, b).collect()]
    same(got, [(1, "5", 1, 0, 12), (2, "5", 1, 1, 10)])


def plain_matches(rows, items, window=10):
    """Longest runs of equal words, from every pair of first words."""
    out = []
    for d, text in rows:
        w = alnum_words(text)
        for i, it in items:
            v = alnum_words(it)
            for p in range(len(w)):
                for q in range(len(v)):
                    if w[p] == v[q] and (p == 0 or q == 0 or w[p - 1] != v[q - 1]):
                        n = 0
                        while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                            n += 1
                        if n >= min(window, len(v)):
                            out.append((d, "" if i is None else str(i), p, q, n))
    return out


def test_longest_matches_equal_plain_search(spark, monkeypatch):
    """Also where few occurrences are joined at once, and a repeated word gives many."""
    monkeypatch.setattr(D, "EXPANDED", 50)
    rng = random.Random(2)
    items = [(1, sentence(rng, 30)), (2, "same " * 25), (3, "x y z"), (None, sentence(rng, 12))]
    rows = [(k, f"{sentence(rng, 5)} {t} {sentence(rng, 5)} {t[5:]}") for k, (_, t) in enumerate(items)] + [(9, "same " * 40), (10, None), (11, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    same([tuple(r) for r in D.longest_matches(documents(spark, rows), b).collect()], plain_matches(rows, items))
    same(D.contamination(documents(spark, rows), b).collect(), brute(rows, items))


def test_empty_tables(spark):
    rows, items = case()
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    assert D.contamination(docs.limit(0), b).collect() == []
    assert not any(r.contaminated for r in D.contamination(docs, b.limit(0)).collect())
    assert D.remove_contaminated(docs, b.limit(0)).count() == len(rows)
