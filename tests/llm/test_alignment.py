"""Cross-tokenizer alignment against a plain version, on whole documents with every awkward case."""

import hashlib
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasift.llm import alignment
from terrasift.llm.queries import QUERIES, TOKENIZERS, tokenizer_file

DATA = Path("/root/testdata/sf0.001")
AWKWARD = ["é" * 900, "a  b\n\tc  ", "  lead", "x ▁y", "\x00 \x1c x\x85 y　 z  q", "x᠎ y​ z", " ", "", None, "don't I'll  <|endoftext|> <s> </s> ", "日本語" * 30 + "。 x", "\t x \t", "😀😀 a😀b", "a", " a", "a b c a b c a b c", "a b c a b c a b c"]


def plain(texts):
    """All columns of each text, by loops over tokens and pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bytes_a = {i: len(token) for token, i in first.get_vocab().items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text or "")
        if not text or b"".join(bytes_b[i] for i in b) != f" {text}".encode():
            continue
        ends_a, ends_b = np.cumsum([bytes_a[i] for i in a]).tolist(), np.cumsum([len(bytes_b[i]) for i in b]).tolist()
        groups, links, last = [], set(), 0
        for end in sorted(set(ends_a) & set(ends_b)):
            sides = [[i for i, x in enumerate(ends) if last < x <= end] for ends in (ends_a, ends_b)]
            groups.append("|".join(",".join(str(ids[i]) for i in side) for ids, side in zip((a, b), sides, strict=True)))
            links |= {(i, j) for i in sides[0] for j in sides[1] if ends_a[i] - bytes_a[a[i]] < ends_b[j] and ends_b[j] - len(bytes_b[b[j]]) < ends_a[i]}
            last = end
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(set(pairs))
        found[-1] = (len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def models():
    return tokenizer_file("byte_bpe_50k.json"), Path(f"{TOKENIZERS}/piece_bpe_32k.model").read_bytes()


@pytest.mark.parametrize(("block", "pairs"), [(alignment.BLOCK, alignment.BROADCAST_PAIRS), (40, 0)])
def test_awkward(spark, models, monkeypatch, block, pairs):
    """With small blocks, and counts that are too many to broadcast."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    if block != alignment.BLOCK:
        monkeypatch.setattr(alignment, "_blocks", _with_block(block))
    ids = [None if i == 9 else 7 if i == 8 else i for i in range(len(AWKWARD))]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, AWKWARD, strict=True)], "doc_id int, text string, uid int, pairs string, n_a int")
    wanted = Counter(zip(ids, plain(AWKWARD), strict=True))
    got = alignment.cross_alignment(docs, *models)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in got.collect()) == wanted


def _with_block(size):
    """Workers read the module anew, so the size goes with the function."""
    run = alignment._blocks

    def blocks(batches):
        alignment.BLOCK = size
        yield from run(batches)

    return blocks


def test_empty(spark, models):
    assert alignment.cross_alignment(spark.createDataFrame([], "doc_id long, text string"), *models).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(str(DATA / "documents.parquet")).filter(F.length("text") < 4000).select("doc_id", "text").collect()]
    whole = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_cross_alignment"](spark, str(DATA)).collect()}
    wanted = dict(zip([i for i, _ in docs], plain([t for _, t in docs]), strict=True))
    # counts over the corpus need all documents; what a document has by itself doesn't
    assert all(whole[i][:4] == w[:4] and whole[i][6] == w[6] for i, w in wanted.items()) and len(whole) == spark.read.parquet(str(DATA / "documents.parquet")).count()


def test_stretches():
    for text in filter(None, AWKWARD):
        parts = alignment.stretches_of(text)
        assert "".join(f" {p}" for p in parts) == f" {text}"


def test_documents_of_a_block_by_portions():
    """What a block's documents take beside their places and results doesn't grow with the block, and no batch is the whole of it."""
    rng = np.random.default_rng(3)
    n, size, vocabulary = 2000, 1000, 5000
    docs = pa.table({"doc_id": np.arange(n), "words": list(rng.integers(0, vocabulary, (n, size), dtype=np.int32))})
    given = [("n_a", 2), ("n_b", 1), ("n_groups", 1)]
    words = pa.table([np.arange(vocabulary, dtype=np.int32), np.arange(vocabulary) != 7, *(np.full(vocabulary, x, np.int32) for _, x in given), [f"{i},1|2" for i in range(vocabulary)], [[i, i + 1] for i in range(vocabulary)]], schema=alignment.NO_WORDS)
    packs = [pa.table({"pack": pa.array([alignment._pack(x)], pa.binary())}) for x in (docs, words)]
    tracemalloc.start()
    out = alignment._documents(*packs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
    assert max(batch.nbytes for batch in out.to_batches()) < out.nbytes / 10
    rows = out.to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(n))
    for row, own in list(zip(rows, docs["words"].to_pylist(), strict=True))[:50]:
        whole = [] if 7 in own else own
        times = Counter(x for i in whole for x in (i, i + 1))
        assert (row["n_a"], row["n_b"], row["n_links"]) == (2 * len(whole), len(whole), 2 * len(whole))
        assert dict(zip(row["pairs"], row["times"], strict=True)) == times
        assert row["groups_sha256"] == (hashlib.sha256(";".join(f"{i},1|2" for i in whole).encode()).hexdigest() if whole else "")
