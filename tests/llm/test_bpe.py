import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from weftline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Library.from_file(PATH)


def same(text):
    t = bpe.tokenizer(PATH)
    ids = LIB.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(t.encode(text), "<u4").tolist()
    assert mine == ids, text
    assert t.decode(t.encode(text)).decode() == LIB.decode(ids, skip_special_tokens=False)


def test_cases():
    for text in ["", " ", "Hello World's re-entry 1234!!", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul ﬁn Ça̧ é", "\x1c\x1d x y z\x85", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "漢字かな한국어 ١٢٣ ½", "'S 'LL don't", "<|x|>"]:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdehilnorst'", max_size=40))
def test_letters(text):
    same(text)


def test_every_code_point():
    for k in range(0, 0x110000, 64):
        text = " ".join(":" + chr(c) + "a1" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000)
        mine, lib = bpe.tokenizer(PATH).encode(text), LIB.encode(text, add_special_tokens=False).ids
        if np.frombuffer(mine, "<u4").tolist() != lib:
            for part in text.split(" "):
                same(part)
            raise AssertionError(text)


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for r in d.collect():
        same(r.text)
    extra = spark.createDataFrame([(1, None, 2), (None, "", 3), (1, "x", 4), (1, "x", 4)], "doc_id long, text string, ids long")
    got = [tuple(r) for r in bpe.report(extra, PATH).collect()]
    none = hashlib.sha256(b"").hexdigest()
    assert got[:2] == [(1, 0, none, none), (None, 0, none, none)] and got[2] == got[3] and got[2][1] == 1
    assert bpe.report(extra.limit(0), PATH).count() == 0
