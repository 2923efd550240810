"""Token counts by a two-tier lookup on the map side.

Byte-level vocabularies split a text into pre-tokens before merging, so a
text's count is the sum of its pre-tokens' counts.

1. Every task counts its pre-tokens into a summary of bounded size; summaries
   are merged in a tree, one row for each, until one is left: the frequent
   pre-tokens of all documents.  No pre-token is shuffled.
2. Their lengths in tokens are broadcast as one compact table.  Every task
   splits its texts and adds up lengths from the table; a pre-token that the
   table lacks is encoded once and kept in the worker's cache of bounded size.

The table and the caches save time only; counts never depend on them.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name
from .textops import release_memory

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Pre-tokens of a summary and of the table; summaries that one task merges.
FREQUENT, _FAN_IN = 1 << 15, 16
#: Pre-tokens that a worker keeps, and characters of the longest one that is counted or kept.
CACHE, LONGEST = 1 << 19, 64
#: Characters from which a text's pre-tokens are read one by one.
_LONG_TEXT = 1 << 20


class Splitter(NamedTuple):
    """How a tokenizer cuts texts: at its added tokens, then by the pattern."""

    added: regex.Pattern | None
    pattern: regex.Pattern


@functools.cache
def _library(name: str):
    """Token counts of a list of texts by the tokenizer of a file, which its suffix names."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


@functools.cache
def _merges(name: str):
    """Token count of one pre-token of a byte-level vocabulary: its merges alone, without splitting once more."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(public_tokenizers.path(name)).model, _byte_letters()
    return lambda piece: len(model.tokenize(piece.encode().decode("latin-1").translate(letters)))


_ASSIGNED: set[str] = set()


def _strange(text: str) -> bool:
    """Whether a character has no meaning in Python's tables: only on these may two libraries' classes differ."""
    if text.isascii():
        return False
    new = set(text) - _ASSIGNED
    odd = {c for c in new if unicodedata.category(c) == "Cn"}
    _ASSIGNED.update(new - odd)
    return bool(odd)


@functools.cache
def splitter(name: str) -> Splitter | None:
    """The splitter of a byte-level tokenizer, or none where texts must be encoded whole."""
    import public_tokenizers

    if not name.endswith(".json"):
        return None
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = made.get("added_tokens") or []
    if not plain or made["model"].get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    names = "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))
    return Splitter(regex.compile(names) if names else None, regex.compile(public_tokenizers.PATTERN))


def _pieces(cut: Splitter, text: str) -> tuple[list[Iterator[str] | list[str]], int]:
    """Pre-tokens of a text, part by part, and the number of added tokens between the parts."""
    parts = cut.added.split(text) if cut.added else [text]
    return [cut.pattern.findall(p) if len(p) < _LONG_TEXT else (m.group() for m in cut.pattern.finditer(p)) for p in parts], len(parts) - 1


def _summary(counts: Counter, size: int) -> bytes:
    top = counts.most_common(size)
    return zlib.compress(json.dumps([[k for k, _ in top], [n for _, n in top]]).encode(), 1)


def frequent_pieces(docs: DataFrame, name: str = TOKENIZER, size: int = FREQUENT) -> list[str]:
    """The ``size`` most frequent pre-tokens of all texts, nearly (rare ones are forgotten when a summary is full)."""

    def bounded(counts: Counter) -> Counter:
        return Counter(dict(counts.most_common(2 * size))) if len(counts) > 4 * size else counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = splitter(name), Counter()
        for b in batches:
            for text in b["text"]:
                text = text.as_py()
                if text and not _strange(text):
                    for part in _pieces(cut, text)[0]:
                        if isinstance(part, list):
                            counts.update(part)
                        else:
                            for p in part:  # a long text is never held in pieces
                                counts[p] += 1
                                if len(counts) > 8 * size:
                                    counts = bounded(counts)
                    counts = bounded(counts)
        for p in [p for p in counts if len(p) > LONGEST]:
            del counts[p]
        yield pa.RecordBatch.from_arrays([pa.array([_summary(counts, size)], pa.binary())], names=["blob"])
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in batches:
            for blob in b["blob"]:
                for p, n in zip(*json.loads(zlib.decompress(blob.as_py())), strict=True):
                    counts[p] += n
        yield pa.RecordBatch.from_arrays([pa.array([_summary(counts, size)], pa.binary())], names=["blob"])

    rows = docs.select("text").mapInArrow(count, "blob binary")
    tasks = docs.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // _FAN_IN)
        rows = rows.repartition(tasks).mapInArrow(merge, "blob binary")
    counts = Counter()
    for r in rows.collect():  # one summary
        counts.update(dict(zip(*json.loads(zlib.decompress(bytes(r["blob"]))), strict=True)))
    return sorted(counts)


class _Lengths(dict):
    """Tokens of pre-tokens: the broadcast table beneath, what was missing encoded once and kept while there is room."""

    def __init__(self, name: str, table: dict[str, int]):
        super().__init__(table)
        self.encode, self.merge = _library(name), _merges(name) if splitter(name) else None
        self.table, self.most = table, len(table) + CACHE

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:  # begin anew from the table
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


_CACHES: dict[tuple, _Lengths] = {}


def _lengths(name: str, shared) -> _Lengths:
    """The worker's cache for a broadcast; it outlives the task."""
    key = (name, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _CACHES:
        _CACHES.clear()
        pieces, sizes = shared.value
        _CACHES[key] = _Lengths(name, dict(zip(pieces, sizes, strict=True)))
    return _CACHES[key]


def _tokens(cut: Splitter, lengths: _Lengths, text: str) -> int:
    if _strange(text):
        return lengths.encode([text])[0]
    parts, n = _pieces(cut, text)
    of = lengths.__getitem__
    return n + sum(sum(map(of, p)) for p in parts)


def with_token_counts(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """``docs`` with two more columns behind its own: bytes and tokens of ``text`` (underscores are put behind taken names).

    ``name`` is a file of the public tokenizers.  A byte-level vocabulary goes
    by the two-tier lookup; what normalises its texts or has no pre-tokens
    (sentence pieces) is encoded text by text in the same pass.
    """
    cut = splitter(name)
    pieces = frequent_pieces(docs, name) if cut else []
    sizes = list(map(_merges(name), pieces)) if cut else []
    shared = docs.sparkSession.sparkContext.broadcast((pieces, sizes))  # FREQUENT pre-tokens of LONGEST characters at most
    keep = list(docs.columns)
    n_bytes = free_name(keep, "n_bytes")
    n_tokens = free_name([*keep, n_bytes], "n_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths = splitter(name), _lengths(name, shared)
        for b in batches:
            size = pc.fill_null(pc.cast(pc.binary_length(b["text"]), pa.int64()), 0)
            found = []
            for text in b["text"]:
                text = text.as_py()
                found.append(0 if not text else _tokens(own, lengths, text) if own else lengths.encode([text])[0])
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(found, pa.int64())], names=[*keep, n_bytes, n_tokens])
            release_memory()

    return docs.mapInArrow(count, extended(docs.schema, **{n_bytes: "long", n_tokens: "long"}))


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs(doc_id, text)``.

    Counts are those of the library without begin and end tokens; the strings
    of added tokens inside a text count as one token, as is its default.  Null
    and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each;
    a null doc_id is a value like any other.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.  Texts of any
    length are counted whole.
    """
    rows = with_token_counts(docs.select("doc_id", "text"), name)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
