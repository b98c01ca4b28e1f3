"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer
    return bpe.Bpe(bpe.vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(both, texts):
    ours, theirs = both
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.encode_batch(texts)]
    for t, g, e in zip(texts, got, theirs.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert g == e.ids, t
        assert ours.decode(np.array(g, np.int64)) == theirs.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(both, texts):
    same(both, texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abcdehinorst ETA'.,\n\t 0123éñü²½ªʰ\x1c\x85—你<|>" + "".join(map(chr, [0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF])), max_size=80), max_size=6))
def test_near_text(both, texts):
    same(both, texts)


def test_hard_cases(both):
    rng = random.Random(2)
    same(both, ["", None, "<|endoftext|>a<|endoftext|><|endoftext|> b", "a" * 30000, " " * 500 + "x", "\n\n \n x", "don't WE'LL they've'd",
                "aaaa" * 99 + "b", "".join(rng.choice("etaoin ") for _ in range(20000)), "é \U0001f600\U0001f600 ٣٤ ⅷ ǅ"])


def test_real_texts(both, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    same(both, texts)


def test_every_character_is_classed_as_in_the_library(both):
    """After a letter, a digit and a sign each character joins the piece or starts one, whichever Unicode the regex module knows."""
    ours, theirs = both
    kind = theirs.pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000]
    # one text per sort of neighbour, a line break between the characters
    for a in "a1!":
        text = "".join(f"{a}{c}\n" for c in chars)
        assert ours.split(text) == [text[lo:hi] for _, (lo, hi) in kind(text)]
    same(both, ["\U0003291a\u9000", "a\u088f 1\U00011de0!\U0003d000"])


def test_cache_limit(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    same(both, ["one two three four five six", "seven eight one two"])
    same(both, ["nine ten one two"])


def test_query_cases(both, spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello  wörld", 0), (3, "Hello  wörld", 0)], "doc_id long, text string, ids int")
    spec = bpe.vocabulary(PATH)
    rows = sorted(bpe.encode(df, spec, digest=True).collect(), key=lambda r: r.doc_id)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[0].ids_sha256 == rows[1].decoded_sha256 == empty
    assert rows[2] == rows[3] and rows[2].decoded_sha256 == hashlib.sha256("Hello  wörld".encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, spec), spec).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello  wörld", "Hello  wörld"]
    assert bpe.encode(df.limit(0), spec).count() == 0
