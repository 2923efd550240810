"""License scans with ordered signature rules, with DataFrame functions only.

The text is reduced to its lower-cased words, a blank before each.  A rule is
a regular expression over that line, with a keyword that any match contains, a
priority and a label.  Texts without any keyword are done at once; in the
others only the rules whose keyword occurs are run.  A rule marks its matches
in the line, and their places are the numbers of the marked words, so the work
grows with the length of the text.  A detection is suppressed if its words lie
inside those of another detection with higher priority, or with the same
priority and more words, or the same words and an earlier rule.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import RULES

# Phrases and labels that the contract fixes.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks of a match's begin and end; no line holds these signs.
_OPEN, _CLOSE = "\x01", "\x02"
_DETECTIONS = "array<struct<a:int,nb:int,prio:int,rule:int,label:string>>"


def _coarse() -> list[str]:
    """A few strings, at least one of which is part of every keyword and base phrase."""
    parts = {"licen" if "licen" in k else k for k in {r[0] for r in RULES} | {p for p, _ in BASE}}
    return sorted(k for k in parts if not any(o != k and o in k for o in parts))


COARSE = _coarse()


def _bound(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers(words: Column, wanted) -> Column:
    """Numbers of the words that are wanted; the line's first piece is the empty one before the first word."""
    return F.filter(F.transform(words, lambda w, i: F.when(wanted(w), i - 1)), lambda i: i.isNotNull())


def _marked(line: Column, pattern: Column, use, none: Column) -> Column:
    """use(words), where the words of matches bear marks; ``none`` if there is no match."""
    marked = F.regexp_replace(line, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))
    return _bound(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), _bound(F.split(m, " "), use)).otherwise(none))


def _starts(words: Column) -> Column:
    return _numbers(words, lambda w: F.startswith(w, F.lit(_OPEN)))


def _ends(words: Column) -> Column:
    return _numbers(words, lambda w: F.endswith(w, F.lit(_CLOSE)))


def _rule_groups() -> Column:
    """All rules by keyword, as one constant."""
    groups: dict[str, list] = {}
    for k, (keyword, pattern, priority, label) in enumerate(RULES):
        groups.setdefault(keyword, []).append({"pattern": pattern, "prio": priority, "rule": k, "label": label})
    rows = [{"keyword": k, "rules": r} for k, r in sorted(groups.items())]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,rules:array<struct<pattern:string,prio:int,rule:int,label:string>>>>")


def _detections(line: Column) -> Column:
    """All matches of the rules whose keyword occurs, in order of first word, last word (longest first), priority and rule."""
    none = F.array().cast(_DETECTIONS)

    def run(r: Column) -> Column:
        found = lambda a, b: F.struct(a.alias("a"), (-1 - b).alias("nb"), r["prio"].alias("prio"), r["rule"].alias("rule"), r["label"].alias("label"))
        return _marked(line, r["pattern"], lambda words: F.zip_with(_starts(words), _ends(words), found), none)

    groups = F.filter(_rule_groups(), lambda g: F.contains(line, g["keyword"]))
    return F.array_sort(F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: g["rules"])), run)))


def _reach(detections: Column) -> Column:
    """Words of the longest detection."""
    return F.array_max(F.transform(detections, lambda d: -d["nb"] - d["a"]))


def _too_near(detections: Column, reach: Column, k: int):
    return lambda i: F.get(detections, i - k)["a"] + reach > F.get(detections, i)["a"]


def _near(detections: Column, reach: Column) -> Column:
    """So many detections before each one may contain it: a power of four.

    Both are bound values: they are looked up for every detection.
    """
    size, out = F.size(detections), F.lit(1 << 30)
    for k in reversed([4**e for e in range(1, 12)]):
        fits = F.when(size <= k, True).otherwise(~F.exists(F.sequence(F.lit(k), size - 1), _too_near(detections, reach, k)))
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def _unsuppressed(detections: Column, near: Column) -> Column:
    """Sorted detections that no better one contains; a better container comes before, among the ``near`` last ones."""
    size = lambda x: -x["nb"] - x["a"]

    def keep(d: Column, i: Column) -> Column:
        def worse_than(e: Column) -> Column:
            better = (e["prio"] < d["prio"]) | ((e["prio"] == d["prio"]) & ((size(e) > size(d)) | ((size(e) == size(d)) & (e["rule"] < d["rule"]))))
            return (e["nb"] <= d["nb"]) & better

        before = F.sequence(F.greatest(F.lit(0), i - near), i - 1)
        return (i == 0) | ~F.exists(before, lambda j: worse_than(F.get(detections, j)))

    return F.filter(detections, keep)


def _kept(detections: Column) -> Column:
    chosen = _bound(_reach(detections), lambda r: _bound(_near(detections, r), lambda n: _unsuppressed(detections, n)))
    return F.when(F.size(detections) > 1, chosen).otherwise(detections)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, detections) of every row.

    ``detections`` are structs (first_word, n_words, label, priority), in order
    of place.  Null and empty texts have no words and no detections.  Repeated
    rows are scanned each for itself; other columns are ignored.  A text of any
    length is scanned whole.  An empty table gives an empty result.
    """
    found = F.transform("bm_kept", lambda d: F.struct(d["a"].alias("first_word"), (-d["nb"] - d["a"]).alias("n_words"), d["label"].alias("label"), d["prio"].alias("priority")))
    return _scanned(docs).select("doc_id", "n_words", F.array_sort(found).alias("detections"))


def _scanned(docs: DataFrame) -> DataFrame:
    line = F.rtrim(F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(F.col("text"), F.lit("")))), _SEPARATORS, " "))
    out = docs.select(F.col("doc_id"), line.alias("bm_line"))
    blanks = F.length("bm_line") - F.length(F.replace("bm_line", F.lit(" ")))
    out = out.select("doc_id", blanks.cast("long").alias("n_words"), "bm_line")
    gate = F.lit(False)
    for part in COARSE:
        gate = gate | F.contains("bm_line", F.lit(part))
    out = out.withColumn("bm_gate", gate)
    out = out.withColumn("bm_found", F.when(F.col("bm_gate"), _detections(F.col("bm_line"))).otherwise(F.array().cast(_DETECTIONS)))
    return out.select("doc_id", "n_words", "bm_line", "bm_gate", _bound(F.col("bm_found"), _kept).alias("bm_kept"))


def license_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest starts (words from 0, else
    null).  ``labels`` adds those of the rules to the base labels; both lists
    are distinct, sorted and joined by commas.  ``score`` is 1 - 2 ** -d for d
    unsuppressed detections and base places together.  Edge cases as in
    ``scan_licenses``.
    """
    out = _scanned(docs)
    empty = F.array().cast("array<int>")
    places = []
    for k, (phrase, _) in enumerate(BASE):
        spans = _marked(F.col("bm_line"), F.lit(rf"(?<![^ ]){phrase}(?![^ ])"), _starts, empty)
        places.append(F.when(F.col("bm_gate") & F.contains("bm_line", F.lit(f" {phrase}")), spans).otherwise(empty).alias(f"bm_p{k}"))
    out = out.select("doc_id", "n_words", F.transform("bm_kept", lambda d: d["label"]).alias("bm_labels"), *places)
    starts = F.concat(*[F.col(f"bm_p{k}") for k in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"bm_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    out = out.select("doc_id", "n_words", "bm_labels", starts.alias("bm_starts"), base.alias("bm_base"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    n = F.size("bm_starts") + F.size("bm_labels")
    return out.select(
        "doc_id",
        "n_words",
        F.size("bm_starts").cast("long").alias("n_base"),
        F.array_min("bm_starts").cast("long").alias("first_word"),
        F.array_max("bm_starts").cast("long").alias("last_word"),
        join(F.col("bm_base")).alias("base_labels"),
        join(F.concat("bm_base", "bm_labels")).alias("labels"),
        (1 - F.pow(F.lit(0.5), n)).alias("score"),
    )
