import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lakejoin.llm import bpe
from lakejoin.llm.queries import tokenizer_json

SPEC = tokenizer_json()


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(SPEC)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(SPEC)


def ids_of(codec, text):
    return [i for part in codec.encode(np.frombuffer(text.encode(), np.uint8)) for i in part]


TRICKY = ["", " ", "a  b", "don't'll 's", "$'s #'re", "x \n\n y", "tab\t\tz ", "<|endoftext|>", "a<|endoftext|> b", "é's “'s”", "\u00a0 a",
          "a\u2029 b", "日本語 テスト", "1a2b", "a\u0085b", "€€€ $$$###", "😀 😀😀", "\x1c a\x1f b", "'" * 5 + "s", "ﬁ ǆ", "a\u3000 b"]


@pytest.mark.parametrize("text", TRICKY)
def test_same_ids_as_the_library(tok, codec, text):
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids_of(codec, text) == want
    assert codec.decode(want) == tok.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab's \n\t.$#19é\u00a0\u2029“”<|>") + ["'ll", "'s", "  ", "日", "<|endoftext|>"]), max_size=40).map("".join))
def test_any_text(text):
    from tokenizers import Tokenizer
    tok, codec = _pair()
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids_of(codec, text) == want
    assert codec.decode(want) == tok.decode(want, skip_special_tokens=False)


_cache = []


def _pair():
    if not _cache:
        from tokenizers import Tokenizer
        _cache.append((Tokenizer.from_str(SPEC), bpe.Codec(SPEC)))
    return _cache[0]


def test_decoding_cut_characters(tok, codec):
    ids = tok.encode("日本語", add_special_tokens=False).ids
    for part in (ids[:1], ids[1:], ids[::-1]):
        assert codec.decode(part) == tok.decode(part, skip_special_tokens=False)


def test_forced_pairs_are_in_no_token(codec):
    alphabet = bpe.byte_alphabet()
    for token in list(json.loads(SPEC)["model"]["vocab"])[::50]:
        raw = bpe.token_bytes(token, alphabet)
        assert not any(codec.forced[a, b] for a, b in zip(raw, raw[1:]))


def test_table_equals_the_library(documents, tok):
    rows = bpe.digests(documents, SPEC).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty):
    both = bpe.decode(bpe.encode(odd, SPEC, ids_col="ids"), SPEC, ids_col="ids_", text_col="decoded")
    rows = both.collect()
    assert len(rows) == odd.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(r["ids_"] == [] for r in rows if not r["text"])
    assert bpe.digests(empty, SPEC).count() == 0
