import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lanternql.llm import common, token_file
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_file.Encoder(PATH)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!?*#sdtrevml0123½éßÑ…—’"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_same_ids_as_the_library(tokenizer, encoder, text):
    assert encoder([text]) == [ids_of(tokenizer, text)]


def test_awkward_texts(tokenizer, encoder):
    texts = ["", " ", "\n", "a  b   c", "x \n y\n\n z ", "don't we'll I'd 'S 'x", "<|endoftext|>", "a <|endoftext|> b", "日本語 text", "12 ½ x² ª º", "!!! *** a.b", "\x1c\x85　x", "end.\nStart"] + [r[1] or "" for r in cases.documents()]
    assert encoder(texts) == [ids_of(tokenizer, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400))
def test_elias_fano(steps):
    ends = np.cumsum(steps)
    b = token_file.Boundaries(ends.size, *token_file.elias_fano(ends))
    assert (b.all() == ends).all()
    assert [b.select(i) for i in range(ends.size)] == ends.tolist()
    bits = 8 * (len(b.low) + len(b.high))
    assert bits <= ends.size * (2 + max(1, int(ends[-1]) // ends.size).bit_length()) + 16
    with pytest.raises(IndexError):
        b.select(ends.size)


@pytest.mark.parametrize("segment", [token_file.SEGMENT_IDS, 500])
def test_round_trip(spark, tokenizer, segment):
    rows = cases.documents()
    path = common.shared_path(spark, "test-tokens")
    token_file.write(cases.clashing(cases.frame(spark, rows)), PATH, path, segment)
    got = sorted(token_file.read(spark, path).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    def counted(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r[0]), *counted(r[1])) for r in rows)


def test_empty(spark):
    path = common.shared_path(spark, "test-tokens")
    token_file.write(cases.empty(spark), PATH, path)
    assert token_file.read(spark, path).collect() == []


def test_export(spark, tmp_path, tokenizer):
    path = common.shared_path(spark, "test-tokens")
    rows = [r for r in cases.documents(10) if r[0] is not None]
    token_file.write(cases.frame(spark, rows), PATH, path)
    token_file.export(spark, path, str(tmp_path))
    raw = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("*.ids")))
    assert sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows) * 2 == len(raw)


@pytest.mark.parametrize("steps", [[0] * 500, [10**6] * 300, [0] * 200 + [5_000_000] + [0, 1] * 200, [1] * 64, [3]])
def test_selects_agree_with_plain_decoding(steps):
    ends = np.cumsum(steps)
    b = token_file.Boundaries(ends.size, *token_file.elias_fano(ends))
    assert (b.selects(np.arange(ends.size)) == ends).all() and (b.all() == ends).all()
    some = np.array([ends.size - 1, 0, ends.size // 2])
    assert (b.selects(some) == ends[some]).all()


def test_other_kinds_of_tokenizers_go_to_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    encoder = token_file.Encoder(path)
    texts = [r[1] or "" for r in cases.documents(20)] + ["Don't  Stop <|endoftext|> here"]
    assert not encoder.by_chunks
    assert encoder(texts) == [np.array(other.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]


def test_forgetting_changes_no_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(token_file, "CACHE_STRINGS", 50)
    encoder = token_file.Encoder(PATH)
    for r in cases.documents(20):
        assert encoder([r[1] or ""]) == [ids_of(tokenizer, r[1] or "")]


def test_runs_of_white_space(tokenizer, encoder):
    texts = ["def f(x):\n    if x:\n        return 1\n\n\nend  ", "  two", " one", "a \n b", "trail\n", "trail ", "x\n\n y", "\n\n", "   ", "a  b c", "tab\there", "nb\u00a0sp \u00a0 x"]
    assert encoder(texts) == [ids_of(tokenizer, t) for t in texts]
    assert encoder(texts[::-1]) == [ids_of(tokenizer, t) for t in texts[::-1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n a.1é'", max_size=12), min_size=1, max_size=6))
def test_runs_of_white_space_in_batches(tokenizer, encoder, texts):
    assert encoder(texts) == [ids_of(tokenizer, t) for t in texts]
