import functools
import random
import sys
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidmill.llm import token_counts as T

from .helpers import documents, odd_documents, same

STRINGS = ["<|endoftext|>", "<|endoftext|", "<|startoftext|>", "<s>", "</s>", "'s", "'re", " 's", "  ", "\r\n", "\t", "　", "\xa0", "é", "é", "日本語", "😀", "👩‍👩‍👧", "①", "٣", "Ⅷ", "\x00", "�", "aaaa" * 20, "0" * 90]


@functools.cache
def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def odd_texts(seed=2):
    rng = random.Random(seed)
    out = ["".join(rng.choice([*STRINGS, " ", "word", "Word ", "7", "! "]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    return [*out, *STRINGS, "͸ unassigned \U0002fffe", "a" * 5000, "x y " * 300_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, name):
    rows = odd_documents()[:: 1 if name == T.TOKENIZER else 6] + list(enumerate(odd_texts()[:: 1 if name == T.TOKENIZER else 9], 1000))
    got = T.token_counts(documents(spark, rows), name)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := library(name)(t or ""), n > 512) for i, t in rows]
    same(got.collect(), want)


@pytest.mark.parametrize("frequent, cache, longest, long_text", [(1, 3, 2, 10), (0, 0, 0, 1 << 20), (40, 7, 64, 1)])
def test_table_and_cache_change_nothing(monkeypatch, frequent, cache, longest, long_text):
    """Counts with a table and a cache of any size, by the functions that tasks run."""
    monkeypatch.setattr(T, "CACHE", cache)
    monkeypatch.setattr(T, "LONGEST", longest)
    monkeypatch.setattr(T, "_LONG_TEXT", long_text)
    texts = [t for _, t in odd_documents() if t and len(t) < 50_000] + odd_texts()[:-1]
    cut, merge = T.splitter(T.TOKENIZER), T._merges(T.TOKENIZER)
    pieces = [p for t in texts for part in T._pieces(cut, t)[0] for p in part][:frequent]
    lengths = T._Lengths(T.TOKENIZER, {p: merge(p) for p in pieces})
    for t in texts:
        assert T._tokens(cut, lengths, t) == library(T.TOKENIZER)(t)
        assert len(lengths) <= len(set(pieces)) + max(cache, 1)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(STRINGS)).map("".join))
def test_any_text(text):
    lengths = T._Lengths(T.TOKENIZER, {})
    assert T._tokens(T.splitter(T.TOKENIZER), lengths, text) == library(T.TOKENIZER)(text)


def test_splitter_and_library_agree_on_every_assigned_character():
    from tokenizers import Tokenizer

    model, cut = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER)).pre_tokenizer, T.splitter(T.TOKENIZER)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for lo in range(0, len(chars), 5000):
        text = "".join(f"a{c}a1{c}1!{c}!\n" for c in chars[lo : lo + 5000])
        assert [x[1] for x in model.pre_tokenize_str(text)] == [m.span() for m in cut.pattern.finditer(text)]


def test_frequent_pieces_of_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "_FAN_IN", 2)
    texts = ["common words here"] * 50 + ["".join(chr(97 + int(d)) for d in str(10_000 + 37 * i)) for i in range(200)] + [None, "", "z" * 100]
    found = T.frequent_pieces(documents(spark, list(enumerate(texts))).repartition(9), size=3)
    assert found == sorted(["common", " words", " here"])
    assert T.frequent_pieces(documents(spark, [(1, None)])) == []
    assert "z" * 100 not in T.frequent_pieces(documents(spark, list(enumerate(texts))))


def test_columns_called_like_its_own_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "q"), (None, None, None, None)], "doc_id long, text string, N_TOKENS int, n_bytes string")
    out = T.with_token_counts(docs)
    assert out.columns == [*docs.columns, "n_bytes_", "n_tokens_"]
    same(out.collect(), [(1, "a b", 5, "q", 3, 2), (None, None, None, None, 0, 0)])
    assert T.token_counts(docs.limit(0)).collect() == []
