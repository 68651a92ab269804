"""BPE with word ends against the tokenizers library."""

import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

from terrasift.llm import word_bpe
from terrasift.llm.queries import QUERIES, tokenizer_file

DATA = Path("/root/testdata/sf0.001")
RNG = random.Random(7)
TEXTS = [None, "", " \t\n", "Hello, World's 12", "\x00 \x1c x\x85 y　 z", "<|endoftext|> x<|startoftext|>Y", "ÀÉ İ é ́x ΑΣ ΑΣ.", "😀 日本語", "</w> a</w>b", "x" * 2049]
LONG = ["é" * 9000, "ab" * 5000, "".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "日本語" * 1000 + "。x" + "テキスト" * 2000 + "<|endoftext|>" + "a" * 8191, "word " * 50 + "a" * 5000 + " more " + "1" * 6000 + " " + "!?" * 4000, "thethethe" * 1500 + "'s don't", "Σ" * 4097 + " İ" * 300]


@pytest.fixture(scope="module")
def definition():
    return tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))

    def coded(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return ids, tokenizer.decode(ids, skip_special_tokens=False)

    return coded


def test_texts(spark, definition, library):
    texts = TEXTS + LONG
    ids = [None if i == 3 else 4 if i == 5 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in zip(ids, texts, strict=True)], "doc_id int, text string, rid int, ids int, part string").repartition(3)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.packed), r.decoded) for r in word_bpe.word_bpe_encode(docs, definition, ("ids", "packed", "decoded")).collect())
    assert got == Counter((i, tuple(x), np.array(x, "<u4").tobytes(), d) for i, (x, d) in zip(ids, map(library, texts), strict=True))


def test_joins(definition, library):
    """Any halves of random words, of few letters so that merges cross the border far."""
    bpe = word_bpe.WordBpe(definition)
    for n in range(3000):
        word = "".join(RNG.choices("etaonhr"[: 1 + n % 7], k=RNG.randint(2, 60)))
        at = RNG.randint(1, len(word) - 1)
        assert bpe.join(bpe.leaf(word[:at], False), bpe.leaf(word[at:], True), True) == library(word)[0]


def test_remembered(definition, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 5)
    bpe = word_bpe.WordBpe(definition)
    for i in range(5):
        text = " ".join(f"w{i}{j} x" for j in range(8))
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.encode([text.encode()])] == [library(text)[0]]


def test_other_vocabularies(definition):
    made = json.loads(definition)
    made["model"]["merges"] = made["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="merged"):
        word_bpe.WordBpe(json.dumps(made))


def test_empty(spark, definition):
    assert word_bpe.word_bpe_encode(spark.createDataFrame([], "doc_id long, text string"), definition).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query(spark, library):
    got = {tuple(r) for r in QUERIES["op13_word_bpe"](spark, str(DATA)).collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    rows = [(r.doc_id, *library(r.text)) for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
    assert got == {(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())) for i, ids, text in rows}
