"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

1. Tasks count the terms of their documents by language and source, with the
   number of documents that hold them; counts are added up by term.
2. Terms of a language with identical sparse vectors of counts by source are
   grouped.  Everything after runs on distinct vectors and multiplies by their
   multiplicity.
3. For each pair of sources, f over all kept terms is summed from what differs
   from the case of two zero counts: a part for each source alone, by distinct
   count, and a correction for the vectors that both sources are in.  So work
   follows the entries of the sparse vectors and no row is made for a pair of
   zeros.
4. All terms of a vector have one value in a group, and ties go to the smaller
   term, so the ten smallest terms of a vector are all that can rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .textops import release_memory

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Counted terms that a task holds before it sends them on.
_HELD = 1 << 18
#: Bytes of a text that are split into terms at once.
_PIECE = 1 << 20

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, A-Z lower-cased, in lists of bounded size."""
    text, lo = text.translate(_LETTERS), 0
    while len(text) - lo > _PIECE:
        hi = text.find(b" ", lo + _PIECE)
        if hi < 0:
            break
        yield text[lo:hi].split()
        lo = hi
    yield (text[lo:] if lo else text).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of every term in a group, and its documents that hold it."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def sent() -> pa.RecordBatch:
            rows = [(*group, term, n, held[group][term]) for group, counts in total.items() for term, n in counts.items()]
            lang, source, term, n, n_docs = zip(*rows, strict=True) if rows else ([],) * 5
            total.clear()
            held.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip((lang, source, term, n, n_docs), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=["lang", "source", "term", "n", "n_docs"])

        size = 0
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                group, seen = (lang, source), set()
                counts = total.setdefault(group, Counter())
                before = len(counts)
                for part in _terms(text.as_py()):
                    counts.update(part)
                    seen.update(part)
                held.setdefault(group, Counter()).update(seen)
                size += len(counts) - before
                if size > _HELD:
                    yield sent()
                    size = 0
        yield sent()
        release_memory()

    parts = docs.select(*columns).mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _p(count: str, total: str, terms: str) -> str:
    """SQL of a count's share, 1 + floor(UNIT * (count + 2) / (total + 2 * terms)), whatever the size of the count."""
    return f"1 + ({UNIT} * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))"


def _f(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)), for shares from 1 to UNIT + 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, n, all_n, terms, zero): of every group that occurs its terms' occurrences, those of the language, kept terms, and the share of a count of 0."""
    occurring = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = vectors.select("lang", "times", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("times") * F.col("e.n")).alias("n"))
    whole = vectors.groupBy("lang").agg(F.sum(F.col("times") * F.col("total")).alias("all_n"), F.sum("times").alias("terms"))
    rows = occurring.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "all_n", "terms"])
    return rows.selectExpr("*", f"case when terms > 0 then {_p('0', 'n', 'terms')} end as zero")


def _pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f of every ordered pair of sources, summed over the kept terms."""
    side = lambda x: groups.selectExpr("lang", f"source as {x}", f"n as n_{x}", "terms", f"zero as zero_{x}")
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a <> b")  # as many rows as the result has
    nothing = _f("zero_a", "zero_b")
    base = pairs.selectExpr("lang", "a", "b", f"coalesce(terms * ({nothing}), 0L) as value")
    entries = vectors.select("lang", "times", F.explode("vector").alias("e"))
    alone = entries.groupBy("lang", F.col("e.source").alias("a"), F.col("e.n").alias("n")).agg(F.sum("times").alias("times"))
    alone = alone.join(pairs, ["lang", "a"]).selectExpr("lang", "a", "b", "times", "zero_a", "zero_b", f"{_p('n', 'n_a', 'terms')} as p")
    alone = alone.selectExpr("lang", "a", "b", f"times * ({_f('p', 'zero_b')} - {nothing}) as value").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = vectors.select("lang", "times", "vector", F.posexplode("vector").alias("i", "x"))
    both = both.select("lang", "times", "x", F.explode(F.slice("vector", F.col("i") + 2, F.size("vector"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("x.n").alias("x"), F.col("y.source").alias("b"), F.col("y.n").alias("y")).agg(F.sum("times").alias("times"))
    both = both.join(side("a"), ["lang", "a"]).join(side("b").drop("terms"), ["lang", "b"])
    both = both.selectExpr("lang", "a", "b", "times", "zero_a", "zero_b", f"{_p('x', 'n_a', 'terms')} as p", f"{_p('y', 'n_b', 'terms')} as q")
    joint = f"{_f('p', 'q')} - {_f('p', 'zero_b')} - {_f('zero_a', 'q')} + {nothing}"
    both = both.selectExpr("lang", "a", "b", f"times * ({joint}) as value").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = base
    for part in (alone, turned(alone), both, turned(both)):
        parts = parts.unionByName(part)
    return parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs(text, lang, source)``.

    Part ``pair`` has a row for every other source of the language, part
    ``term`` the ``top`` terms that are more frequent in the group than in the
    language.  Null text, language and source count as empty; repeated rows
    are documents of their own.  A group without kept terms has values of 0
    (where the language keeps none) and no terms; a language of one source has
    no pairs; an empty table gives an empty result.  Texts of any length are
    read whole.  Counts may be of any size, values fit longs.  Ties go to the
    item that is smaller as UTF-8.  Other columns are ignored.
    """
    entry = F.struct("source", "n")
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("vector"))
    kept = materialize(kept.where(F.col("n_docs") >= least).select("lang", "term", "total", "vector"))
    same = ["lang", "total", "vector"]
    vectors = materialize(kept.groupBy(*same).agg(F.count("*").alias("times")))
    groups = materialize(_groups(docs, vectors))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("term"))).where(F.col("place") <= top)
    terms = first.groupBy(*same).agg(F.collect_list("term").alias("names")).select("lang", "total", "names", F.explode("vector").alias("e"))
    terms = terms.select("lang", "total", "names", "e.source", F.col("e.n").alias("own")).join(groups, ["lang", "source"])
    terms = terms.selectExpr("lang", "source", "names", f"{_p('own', 'n', 'terms')} as p", f"{_p('total', 'all_n', 'terms')} as q").where("p > q")
    terms = terms.selectExpr("lang", "source", "explode(names) as item", f"{_f('p', 'q')} as value")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(_ranked(_pairs(vectors, groups)), "pair").unionByName(columns(_ranked(terms).where(F.col("rank") <= top), "term"))
