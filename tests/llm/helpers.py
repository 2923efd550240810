"""Plain versions of the operators' rules, and rows with every odd case."""

import random
import re

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, component_id int, score string, shard string, size string, bm_x int"


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def sentence(rng, n, stock="alpha beta gamma delta Über naïve the of and to 7 x1 don't end. (sic) Ünï — ?".split()):
    return " ".join(rng.choice(stock) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


def odd_documents(seed=3):
    """(doc_id, text): nulls, blanks, ties, copies, near copies, shared passages, one very long text."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 70)
    texts = [None, "", " \t\n ", "one", "One", "one two three four", "one two three four five", "!!! ... ??", "a\x00b c\u00a0d", base, base, base.upper(), base + " tail", base.replace("alpha", "omega"), passage + " " + sentence(rng, 60), sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30), "same " * 300, "same " * 290]
    words = sentence(rng, 150).split()
    for k in range(12):  # a chain of near copies
        w = list(words)
        w[10 * k] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [sentence(rng, rng.randrange(1, 200)) for _ in range(25)]
    texts.append(sentence(rng, 60_000))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base), (None, None)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows):
    """The rows as a table with extra columns, some of them named like results."""
    return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 3}", len(t or ""), "x", 1, "y", "z", None, 0) for i, t in rows], DOCS)


def shingles(text, n=5):
    w = space_words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def linked(a, b, percent=75):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def components(rows):
    """Of each row: (doc_id, n_shingles, component_id, n_links)."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and linked(sets[i], sets[j])] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return out


def key(row):
    return repr(tuple(row))


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))
