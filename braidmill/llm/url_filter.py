"""URL filters: ordered rules, then logistic regression on hashed character n-grams.

Host and path are parsed by DataFrame functions.  The classifier sees the
character n-grams (3 to 5 bytes, with marks for begin and end) of both, hashed
into one weight table of fixed size, host and path apart.  It is trained on the
driver from a small labelled URL table, which is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, lower_ascii
from .textops import string_buffers

#: (rule, verdict); a rule is a host, then the beginning of the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
WEIGHT_BITS = 16
GRAMS = (3, 4, 5)
#: Most rows of a labelled table that are trained on, those with the smallest digests.
LABELLED_ROWS = 20_000
#: Scores from here on are blocked: rather let a page pass than block a good one.
THRESHOLD = 0.75

_BLOCKED_WORDS = """casino poker bets betting jackpot slots roulette gamble lottery bingo pills pharmacy viagra cialis
    meds cheap discount-drugs weight-loss payday loans quick-cash crypto-profit forex-signals get-rich free-money
    win-prize adult xxx porn escorts webcam nude torrent warez crack keygen serials ads adserver ad-track tracker
    track-click click-bait popunder banner-farm spam seo-links link-farm malware phishing fake-login free-download""".split()
_ALLOWED_WORDS = """news daily-times journal gazette library archive museum gallery university college school
    institute research science nature history geography physics biology health-service hospital council city parish
    government parliament court weather travel railway garden kitchen recipes bakery books reviews music orchestra
    theatre film football cycling chess hiking photo blog notes diary docs manual developer software linux database
    wiki encyclopedia dictionary translate maps energy forest ocean village""".split()
# What such hosts like to put beside the word.
_BLOCKED_SIDES = "best online bonus hot live vip mega king 24h now".split()
_ALLOWED_SIDES = "city national county local my house center association today digital".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in labelled table: every word above, alone and with something beside it, in a few usual kinds of URL; 1 is blocked."""
    ends, prefixes = ["com", "org", "net", "info"], ["www.", "", "m.", "blog."]
    paths = ["/en/4{}", "/de/1{}.html", "/fr/7{}?page=2", "/es/3{}/", "/", ""]
    out = []
    for label, names, sides in ((1, _BLOCKED_WORDS, _BLOCKED_SIDES), (0, _ALLOWED_WORDS, _ALLOWED_SIDES)):
        for k, word in enumerate(names):
            one, two = sides[k % len(sides)], sides[(k // 2 + 3) % len(sides)]
            for j, name in enumerate((word, word, word, word, f"{one}{word}", f"{word}-{two}")):
                host = f"{prefixes[(k + j) % 4]}{name}.{'example.' * ((k + j) % 2)}{ends[(k // 2 + j) % 4]}"
                out.append((f"http{'s' * (j % 2)}://{host}{paths[(k + j) % 6].format(100 + 7 * k)}", label))
    return out


def url_host(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    after = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^?#]*", 0)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.position(F.lit("://"), url) + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal length the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=False):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(strings: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every n-gram."""
    n = len(strings)
    data, offsets = string_buffers(strings)
    marked = np.full(len(data) + 2 * n, 2, dtype=np.uint64)  # one mark before and one after each string
    shift = np.repeat(np.arange(n), np.diff(offsets))
    marked[np.arange(len(data)) + 2 * shift + 1] = data
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    marked[offsets[1:] + 2 * np.arange(n) + 1] = 3
    rows, cells = [], []
    for k in GRAMS:
        m = len(marked) - k + 1
        if m <= 0:
            continue
        h = np.full(m, salt * 31 + k, dtype=np.uint64)
        for i in range(k):
            h = (h ^ marked[i : i + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = row[:m] == row[k - 1 :]
        rows.append(row[:m][inside])
        cells.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)[inside])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, value); each field's grams have length 1 together."""
    out = []
    for salt, strings in ((1, hosts), (2, paths)):
        row, cell = _grams(strings, salt)
        count = np.bincount(row, minlength=len(strings))
        out.append((row, cell, 1 / np.sqrt(count[row])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def train(urls: list[tuple[str, str, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label), by full-batch gradient descent."""
    w, b = np.zeros(1 << WEIGHT_BITS), 0.0
    if not urls:
        return w, b
    row, cell, value = _features(pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()))
    y = np.array([u[2] for u in urls], dtype=float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        z = np.bincount(row, weights=w[cell] * value, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        w -= rate * len(y) ** 0.5 * (np.bincount(cell, weights=g[row] * value, minlength=len(w)) + decay * w)
        b -= rate * g.sum()
    return w, float(b)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages(page_id, url)``.

    The verdict is the rule's where one fits, else ``block`` from a score of
    ``threshold`` on.  ``score`` is the classifier's probability of ``block``,
    for rule hits too; host and path both empty score 0 and are allowed.  Null
    urls and urls without ``://`` have an empty host and path.  Repeated rows
    are judged each for itself; other columns are ignored; urls of any length
    are taken whole.  An empty table gives an empty result.  Of a labelled table
    of more than ``labelled_rows`` rows those with the smallest digests count.
    """
    rules = RULES if rules is None else rules
    labelled = labelled_urls() if labelled is None else labelled
    spark = pages.sparkSession
    if len(labelled) > labelled_rows:
        labelled = sorted(labelled, key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[1]))[:labelled_rows]
    known = spark.createDataFrame(labelled, "url string, label int") if labelled else None
    parsed = known.select(url_host(F.col("url")), url_path(F.col("url")), "label").collect() if labelled else []
    model = spark.sparkContext.broadcast(train([tuple(r) for r in parsed]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            row, cell, value = _features(batch["host"], batch["path"])
            z = np.bincount(row, weights=w[cell] * value, minlength=len(batch)) + b
            empty = np.array([not h and not p for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)], dtype=bool)
            p = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    scored = rows.mapInArrow(score, extended(rows.schema, score="double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
