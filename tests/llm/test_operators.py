"""The corpus operators against plain versions, on documents with every awkward case."""

import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from terrasift.llm import byte_bpe, content_store, decontamination, katz_lm, language_id, license_scan, minhash_join, token_files, toxicity
from terrasift.llm.common import fold, lower_words, running_total, shared_dir, written
from terrasift.llm.components import connected_components
from terrasift.llm.exact_dedup import exact_dedup
from terrasift.llm.queries import TOKENIZERS, tokenizer_file
from terrasift.llm.shingles import Shingler

RNG = random.Random(5)
WORDS = {"en": "the of and that with this from tion are was".split(), "de": "der und die nicht mit für ung schaft über sch".split(), "fr": "le la et les où être avec tion été ça".split()}


def prose(lang, n, rng=RNG):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "en", ".", ",\n"]) for _ in range(n))


LONG = prose("en", 30_000)
COPY = prose("de", 80)
AWKWARD = [None, "", " ", "\n\t", "!!! ...", "12 34", "²³", "One", "ONE", "a b c d", "a b c d e", "\x00\x1c \x85  x　", "日本語 テキスト", "<|endoftext|> x", "é" * 3000, " lead", "trail ", "two  spaces", LONG, COPY, COPY, COPY + " end", "x\ny z's don't I'll"]


def make(spark, texts, **columns):
    """Documents with ids, one of them null and one repeated, and columns with clashing names."""
    ids = [None if i == 9 else 7 if i == 8 else i for i in range(len(texts))]
    rows = [(i, t, "en", "s", 1, "kept", 5, 0.5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, hash double")


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, AWKWARD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def by_text(rows, *columns):
    return Counter((r.doc_id, *(getattr(r, c) for c in columns)) for r in rows)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [128, 1])
def test_exact_dedup(docs, none, keep, bits):
    """With a hash of one bit all groups collide, and the bytes alone decide."""
    weak = {} if bits == 128 else {"content_hash": lambda text: F.length(text) % 2}
    groups = {}
    for i, t in pairs(docs):
        groups.setdefault(t, []).append(i)
    wanted = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        wanted.update((i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = exact_dedup(docs, keep, **weak).collect()
    assert by_text(got, "keep_id", "group_size", "kept", "text_sha256") == wanted
    assert exact_dedup(none, keep).count() == 0


@pytest.fixture(scope="module")
def definition():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(definition)
    return lambda text: found.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain_library(definition):
    """Special tokens that a text spells out are text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(definition)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_encoder(definition, library):
    rng = random.Random(1)
    alphabet = [*map(chr, [*range(9, 14), *range(28, 33), *range(33, 127), 0x85, 0xA0, 0xE9, 0x1680, 0x2003, 0x3000, 0x3001, 0x4E2D, 0x1F600])]
    texts = [t or "" for t in AWKWARD[:18]] + ["".join(rng.choices(alphabet + [" "] * 20 + list("abc"), k=rng.randint(0, 40))) for _ in range(500)]
    encoder = content_store.Encoder(definition)
    for _ in range(2):  # new words, then known ones
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [library(t) for t in texts]


def test_forgetting(definition, library, monkeypatch):
    monkeypatch.setattr(content_store, "REMEMBERED", 10)
    encoder = content_store.Encoder(definition)
    for i in range(6):
        texts = [f"w{i} x{i} common y{j}" for j in range(8)]
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [library(t) for t in texts]


def test_cuts_and_crc():
    ids = np.random.default_rng(1).integers(0, 50000, 60_000).astype("<u2")
    ends = content_store.cuts(ids, [50_000, 10_000])
    assert [e[-1] for e in ends] == [50_000, 10_000]
    sizes = np.diff([0, *ends[0]])
    assert sizes[:-1].min() >= content_store.LEAST and sizes.max() <= content_store.MOST and 1000 < sizes.mean() < 1700
    moved = content_store.cuts(np.concatenate([ids[:777], ids[:50_000]]), [50_777])[0]
    assert len({e - 777 for e in moved} & set(ends[0])) > len(ends[0]) * 0.8  # the same passage gives the same chunks
    data = np.random.default_rng(2).bytes(5000)
    share = content_store.shift_crc(np.array([zlib.crc32(data[:1234])]), np.array([5000 - 1234]))[0]
    assert share ^ zlib.crc32(data[1234:]) == zlib.crc32(data)


def test_content_store(spark, docs, none, definition, library):
    content_store.write_store(docs, definition, path := shared_dir(spark))
    rows = content_store.read_digests(spark, path).collect()
    wanted = [(i, [*library(t), 0]) for i, t in pairs(docs)]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in wanted)
    assert all(r.verified for r in rows)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    again = Counter((r.doc_id, tuple(np.frombuffer(r.data, "<u2").tolist())) for r in content_store.reconstruct(spark, path).collect())
    assert again == Counter((i, tuple(x)) for i, x in wanted)
    log = spark.read.parquet(f"{path}/log").filter("data IS NOT NULL")
    assert {r.node for r in spark.read.parquet(f"{path}/manifest").filter("part IS NULL").collect()} == {r.node for r in content_store.merkle_nodes(spark, path).filter("part IS NULL").collect()}
    assert log.count() == log.select("hash").distinct().count() == log.select("data").distinct().count()
    content_store.write_store(none, definition, empty := shared_dir(spark))
    assert content_store.read_digests(spark, empty).count() == 0


def test_store_tells_changed_recipes(spark, docs, definition, monkeypatch):
    """A recipe with a fitting node is still not the manifest's; a lost chunk or recipe shows as well."""
    monkeypatch.setattr(content_store, "BLOCK", 4)
    content_store.write_store(docs.filter("doc_id < 8").coalesce(1), definition, path := shared_dir(spark))
    assert all(r.verified for r in content_store.read_digests(spark, path).collect())
    recipes = written(spark.read.parquet(f"{path}/recipes"))
    first = F.col("rank") == 0
    chunks = F.when(first, F.slice("chunks", 1, 1)).otherwise(F.col("chunks"))
    other = F.transform(chunks, lambda c: F.when(first, c.withField("hash", F.unhex(F.lit("00" * 16)))).otherwise(c))
    node = F.sha2(F.array_join(F.transform(other, lambda c: F.hex(c["hash"])), ","), 256)
    recipes.withColumn("chunks", other).withColumn("node", node).write.mode("overwrite").parquet(f"{path}/recipes")
    rows = content_store.read_digests(spark, path).collect()
    assert len(rows) == recipes.count() and 0 < sum(r.verified for r in rows) < len(rows)
    recipes.filter(~first).write.mode("overwrite").parquet(f"{path}/recipes")
    lost = content_store.read_digests(spark, path).collect()
    assert len(lost) == len(rows) - recipes.filter(first).count() and not all(r.verified for r in lost)


def test_large_vocabularies_take_wide_ids():
    known = {"model": {"vocab": {str(i): i for i in range(1 << 16)}}, "added_tokens": []}
    assert content_store.width_of(json.dumps(known)).str == "<u2"
    assert content_store.width_of(json.dumps(known | {"added_tokens": [{"id": 1 << 16}]})).str == "<u4"


def test_store_tells_damage(spark, docs, definition):
    content_store.write_store(docs.filter("doc_id < 6"), definition, path := shared_dir(spark))
    log = written(spark.read.parquet(f"{path}/log"))
    spoiled = F.when(F.col("data").isNotNull(), F.overlay("data", F.unhex(F.lit("FFFF")), F.lit(1)))
    log.withColumn("data", spoiled).write.mode("overwrite").parquet(f"{path}/log")
    assert not any(r.verified for r in content_store.read_digests(spark, path).collect())


def test_token_files(spark, docs, none, definition, plain_library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    found = token_files.token_counts(docs, definition, 50256, shared_dir(spark)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len(plain_library(t))) for i, t in pairs(docs))
    assert token_files.token_counts(none, definition, 50256, shared_dir(spark)).count() == 0


def test_scan_of_foreign_files(spark, tmp_path, monkeypatch):
    """Empty documents, an open end, an empty file, separators at the borders of blocks."""
    monkeypatch.setattr(token_files, "BLOCK", 8)
    streams = {"a": [9, 9, 1, 2, 3, 9, 4], "b": [], "c": [1] * 20, "d": [1, 1, 1, 9, 1, 1, 1, 9], "e": [9]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in streams], "path string")
    got = {(r.path[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in token_files.scan_token_files(paths, str(tmp_path), 9).collect()}
    assert got == {("a", 0, 0, 0, True), ("a", 1, 1, 0, True), ("a", 2, 2, 3, True), ("a", 3, 6, 1, False), ("c", 0, 0, 20, False), ("d", 0, 0, 3, True), ("d", 1, 4, 3, True), ("e", 0, 0, 0, True)}


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def test_bpe(spark, docs, none, ranks):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tables = byte_bpe.broadcast_tables(spark, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", P.PATTERN)
    for rows in (byte_bpe.bpe_encode(docs, tables, decode=True), byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, tables), tables)):
        got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows.collect())
        assert got == Counter((i, tuple(plain.encode_ordinary(t)), t.encode()) for i, t in pairs(docs))
    assert byte_bpe.bpe_encode(none, tables).count() == 0
    bpe, rng = byte_bpe.ByteBpe(ranks, P.PATTERN), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choices("aeinrst hoTH'.\n1é中", k=rng.randint(0, 50)))
        assert np.frombuffer(bpe.encode(text), "<i4").tolist() == plain.encode_ordinary(text)


def test_bpe_of_small_vocabularies():
    """Merges that the longest match alone gets wrong."""
    base = {bytes([b]): b for b in range(256)}
    for merges in ([b"ab", b"bc", b"abc"], [b"bc", b"ab", b"aab"], [b"aa", b"aaa", b"aab"], [b"ab", b"cd", b"bcd", b"abcd"]):
        ranks = base | {m: 256 + i for i, m in enumerate(merges)}
        bpe = byte_bpe.ByteBpe(ranks, r"(?s).+")
        for n in range(1, 8):
            for _ in range(60):
                piece = bytes(RNG.choices(b"abcd", k=n))
                assert bpe.encode_piece(piece) == [ranks[t] for t in byte_bpe.merge_by_rank(piece, ranks, 1 << 40)]


def test_license_scan(docs, none):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in license_scan.license_scan(docs).collect():
        assert r.n_words in {len(pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for i, t in pairs(docs) if i == r.doc_id}
        assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, None, None, [], [], 0.0)
    assert license_scan.license_scan(none).count() == 0


def test_templates():
    m = license_scan.Matcher("licensed <<optional>>under the<<end>> <<one of: mit | apache two>> <<words: 2>> end")
    accepted = ["licensed mit end", "licensed under the mit x end", "licensed apache two x y end"]
    refused = ["licensed under mit end", "licensed apache end", "licensed mit x y z end", "licensed mit"]
    assert all(m.end(t.encode().split(), 0) == len(t.split()) for t in accepted)
    assert all(m.end(t.encode().split(), 0) < 0 for t in refused)
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES, license_scan.REFERENCES)
    text = "x CC-BY 4.0! Copyright (c) 2020 A B. All rights reserved, all rights reserved; GNU General Public License, version 3"
    n, base, first, last, base_labels, labels, score, spans = scanner.scan(text)
    assert (n, base, first, last, base_labels, score) == (22, 4, 1, 17, ["cc-by", "gpl", "reserved"], 1.0)
    assert labels == ["cc-by", "cc-by-4.0-ref", "gpl", "gpl-3.0-ref", "reserved", "reserved-notice"] and ("cc-by-4.0-ref", 1, 5) in spans
    with pytest.raises(ValueError):
        license_scan.compile_template("a <<optional>> b")


def notice(markup, name="Ann Example and others"):
    """A text of a template: names for free words, every region left out that may be, the first of each choice."""
    text = re.sub(r"<<optional>>(?:<<one of:[^>]*>>|[^<])*<<end>>", " ", markup)
    text = re.sub(r"<<one of:([^>]*)>>", lambda m: m[1].split("|")[0], text)
    return re.sub(r"<<words: \d+>>", name, text)


def test_notices_need_their_whole_wording():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES, license_scan.REFERENCES)
    rng = random.Random(15)
    for label, markup in license_scan.TEMPLATES.items():
        words = notice(markup).split()
        found = scanner.scan("# (c) 2020 Ann\n" + " ".join(words).upper() + "\nint main")
        assert label in found[5] and found[6] == license_scan.NOTICE, label
        for _ in range(5 if len(words) > 20 else 0):  # one mandatory word is another one, or is missing
            at = rng.choice([i for i, w in enumerate(words) if w not in "Ann Example and others".split() and re.search("[a-z]", w)])
            for changed in ([*words[:at], "zebra", *words[at + 1 :]], [*words[:at], *words[at + 1 :]]):
                if label == "bsd-3-clause" or at < len(words) - 12:
                    assert label not in scanner.scan(" ".join(changed))[5], (label, words[at])
    assert "bsd-2-clause" not in scanner.scan(notice(license_scan.TEMPLATES["bsd-3-clause"]))[5]
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert scanner.scan(header)[5] == ["gpl", "gpl-3.0"]


def test_license_phrases_against_plain_search(spark):
    """Base columns on texts full of phrases, parts of them, and other words between."""
    rng = random.Random(16)
    pool = "CC BY cc-by General public license GENERAL-PUBLIC general license All rights reserved. all rights é x1 by,by".split()
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(300)]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hits = [(at, label) for phrase, label in license_scan.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        starts = [at for at, _ in hits]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(hits), min(starts, default=None), max(starts, default=None))
        assert got[i].base_labels == sorted({label for _, label in hits}) and set(got[i].base_labels) <= set(got[i].labels)


def test_language_id(spark, none):
    rng = random.Random(2)
    rows = [(i, prose(lang, rng.randint(5, 60), rng), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", "12 !", "² ³ ¹ ½", "der", LONG])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.language_id(docs, fold(F.col("doc_id"), 4) != 2).collect()}
    assert len(found) == len(rows)
    held = [(i, lang) for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and [found[i].score for i in (900, 903)] == [0, 0]
    assert (found[904].lang_pred, found[905].lang_pred) == ("de", "en") and all(0 <= r.score <= 1 for r in found.values())
    assert language_id.language_id(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs, F.lit(False)).collect()} == {"und"}


def test_code_switching():
    rng = random.Random(3)
    model = language_id.fit([(lang, prose(lang, 60, rng)) for lang in WORDS for _ in range(40)])
    text = prose("en", 20, rng) + " " + prose("de", 20, rng)
    runs = language_id.runs(language_id.Labeller(model).label([text])[0], model.languages)
    n = len(language_id.words_of(text))
    right = sum(min(r["end"], s + k) - max(r["start"], s) for r in runs for lang, s, k in (("en", 0, n // 2), ("de", n // 2, n - n // 2)) if r["lang"] == lang and min(r["end"], s + k) > max(r["start"], s))
    assert right >= 0.85 * n


def test_forward_backward():
    """Against the sum over all label sequences."""
    rng = np.random.default_rng(0)
    moves, start = rng.random((3, 3)).astype(np.float32), rng.random(3).astype(np.float32)
    emission = [rng.random((n, 3)).astype(np.float32) + 0.1 for n in (4, 0, 1, 3)]
    for e, p in zip(emission, language_id.forward_backward(emission, moves, start), strict=True):
        total = np.zeros((len(e), 3))
        for labels in np.ndindex(*[3] * len(e)):
            w = np.prod([e[i, y] for i, y in enumerate(labels)]) * (start[labels[0]] if labels else 0) * np.prod([moves[a, b] for a, b in zip(labels, labels[1:], strict=False)])
            for i, y in enumerate(labels):
                total[i, y] += w
        if len(e):
            assert np.allclose(p, total / total.sum(1, keepdims=True), atol=1e-5)


def ruzzo_tompa(s):
    """By definition: the best segment, the shortest of several, then the same left and right of it."""
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            key = (round(sum(s[i:j]), 9), i - j)
            if best is None or key > best[0]:
                best = (key, i, j)
    if best is None or best[0][0] <= 0:
        return []
    _, i, j = best
    return ruzzo_tompa(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in ruzzo_tompa(s[j:])]


def test_segments():
    rng = np.random.default_rng(4)
    for _ in range(150):
        s = np.round(rng.normal(-0.3, 2, rng.integers(0, 14)), 3)
        assert [x[:2] for x in toxicity.segments(s)] == ruzzo_tompa(s.tolist())


def test_toxicity(spark, none):
    rng = random.Random(6)
    bad = ["vilewort", "grimtrash", "foulmuck"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose("en", 40, rng).split()
        if toxic:
            for w in bad:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, LONG), (1003, "calm " * 50 + " ".join(bad) + " calm" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks, lambda c: fold(c, 4) != 2).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert all(found[i].predicted == t for i, _, t in labels)
    assert [found[i].predicted for i in (1000, 1001, 1002, 1003)] == [0, 0, 0, 1]
    passage = found[1003].passages[0]
    assert 48 <= passage.start <= 50 and 53 <= passage.end <= 55
    assert toxicity.toxicity(none, marks, lambda c: F.lit(True)).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0), lambda c: F.lit(True)).collect()} == {0.0}


@pytest.mark.parametrize("size", [10_000, 60_000])
def test_toxicity_of_many_documents(spark, size):
    """Documents of uneven length, toxic if they hold one of ten words: long ones are so more often, with all that they hold."""
    rng = np.random.default_rng(size)
    vocabulary = np.array([f"w{i}" for i in range(4000)] + [f"vile{c}" for c in "abcdefghij"])
    chance = np.append(1 / np.arange(5, 4005), np.full(10, 1e-3))
    drawn = rng.choice(len(vocabulary), int(size * 60), p=chance / chance.sum())
    ends = np.cumsum(np.clip(rng.lognormal(3, 1.2, size), 2, 600).astype(int))
    parts = np.split(drawn[: ends[-1]], ends[:-1])
    docs = spark.createDataFrame([(i, " ".join(vocabulary[p])) for i, p in enumerate(parts)], "doc_id long, text string")
    labels = [(i, int((p >= 4000).any())) for i, p in enumerate(parts)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    training = lambda c: fold(c, 4) != 2
    model = toxicity.fit(docs, marks, training)
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    text = [model.of(toxicity.words_of(" ".join(vocabulary[parts[i]]))) for i, t in held if not t]
    assert np.concatenate(text).mean() <= -0.9 * toxicity.MARGIN and model.rate > 0.1
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks, training).select("doc_id", "predicted").collect()}
    toxic = [found[i] for i, t in held if t]
    assert sum(toxic) >= 0.9 * len(toxic) > 50
    assert sum(found[i] for i, t in held if not t) <= 0.005 * len(held)


def test_inflected_toxic_words(spark):
    """A stem with many endings stands for endings that training has not met, a single word for itself alone."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        words = prose("en", 40, rng).split()
        if i % 5 == 0:
            words[3:3] = [f"vequ{i % 60}x", "grimtrash", f"vequ{i % 70}y"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs, lambda c: F.lit(True))
    assert model.of([b"vequnew", b"grimtrashy", b"grimtrash", b"the"])[[0, 2]].min() > 1
    assert model.of([b"grimtrashy", b"the"]).max() < 0


def smith_waterman(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = decontamination.MATCH if a[i - 1] == b[j - 1] else decontamination.OTHER
            h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + decontamination.GAP, h[i][j - 1] + decontamination.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 15))
        score, first, last = decontamination.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        if score:
            assert smith_waterman(a.tolist(), b[first : last + 1].tolist()) == score


def test_leaks(spark, none, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    rng = random.Random(8)
    items = [(i, " ".join(f"q{i}w{rng.randrange(400)}" for _ in range(25))) for i in range(6)] + [(90, None), (91, "too short"), (92, "")]
    edited = [w if i % 6 else "other" for i, w in enumerate(items[1][1].split())]
    texts = [prose("en", 200, rng) + " " + items[0][1].upper() + "! " + prose("en", 50, rng), " ".join(edited), items[2][1][:40], None, "", LONG, items[0][1], items[3][1] + " " + items[4][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (6, 0), (7, 3), (7, 4)}
    assert found[0, 0].score == found[6, 0].score == 1 and 0.5 <= found[1, 1].score < 1
    assert (found[7, 4].first_word, found[7, 4].last_word) == (25, 49)
    assert decontamination.find_leaks(none, bench).count() == 0 == decontamination.find_leaks(docs, bench.limit(0)).count()
    many = spark.createDataFrame([(i, prose("en", 30, rng) + " " + items[5][1]) for i in range(300)], "doc_id long, text string")
    assert decontamination.find_leaks(many, bench).count() == 300  # a frequent item has no rare seeds


def test_edited_copies_of_a_frequent_item(spark):
    rng = random.Random(11)
    item = [f"q{i}" for i in range(15)]
    copies = [[w if rng.random() > 0.25 else "other" for w in item] for _ in range(2000)]
    runs = lambda c: any("other" not in c[i : i + decontamination.SEED] for i in range(len(c) - decontamination.SEED + 1))
    wanted = {i for i, c in enumerate(copies) if runs(c) and smith_waterman(item, c) >= decontamination.LEAK * decontamination.MATCH * len(item)}
    docs = spark.createDataFrame([(i, prose("en", 20, rng) + " " + " ".join(c)) for i, c in enumerate(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} == wanted and len(wanted) > 1000


def test_excerpts_leak(spark):
    item = [f"q{i}" for i in range(400)]
    texts = ["x " + " ".join(item[100:125]) + " y", " ".join(item[7:20]), " ".join(item[7:19]), " ".join(item[:180]), " ".join([*item[:9], "z", *item[9:18]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.first_word, r.last_word) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {0: (1, 25), 1: (0, 12), 3: (0, 179)}


def plain_katz(texts, training, vocabulary):
    """Every definition written out."""
    tokens = [[*lower_words(t), None] for t in texts]
    learned = [w for w, on in zip(tokens, training, strict=True) if on]
    c = Counter(w for words in learned for w in words)
    n, v = sum(c.values()), len(c)
    by_count, own = Counter(k for w, k in c.items() if w is not None), None
    room = 0
    for k in sorted(by_count, reverse=True):
        room += by_count[k]
        own = k if room <= vocabulary else own
    cls = lambda w: w if w is None or (own and c[w] >= own) else "?"
    mass = sum(k + 1 for w, k in c.items() if cls(w) == "?") + 1
    uni = lambda w: (mass if w == "?" else c[w] + 1) / (n + v + 1)
    pairs_, total = Counter(), Counter()
    for words in learned:
        chain = [None, *map(cls, words)]
        pairs_.update(zip(chain, chain[1:], strict=False))
        total.update(chain[:-1])
    d = katz_lm.discounts(Counter(pairs_.values()))
    kept, seen = Counter(), Counter()
    for (a, w), k in pairs_.items():
        kept[a] += k * d[min(k, katz_lm.DISCOUNTED + 1)]
        seen[a] += uni(w)

    def p(a, w):
        if not total[a]:
            return uni(w)
        size = total[a] + (total[a] - kept[a] < 1e-9)
        if 1 - seen[a] < 1e-12:  # every class was seen: nothing is left to back off to
            size = kept[a]
        if k := pairs_[a, w]:
            return k * d[min(k, katz_lm.DISCOUNTED + 1)] / size
        return (1 - kept[a] / size) / (1 - seen[a]) * uni(w)

    out = []
    for words in tokens:
        score, a = 0.0, None
        for w in words:
            score += math.log10(p(a, cls(w))) + (math.log10((c[w] + 1) / mass) if cls(w) == "?" else 0)
            a = cls(w)
        out.append((len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), score))
    classes = {cls(w) for w in c} | {"?"}
    return out, [sum(p(a, w) for w in classes) for a in classes]


@pytest.mark.parametrize("vocabulary", [65_000, 12, 0])
def test_katz(spark, docs, none, monkeypatch, vocabulary):
    monkeypatch.setattr(katz_lm, "VOCABULARY", vocabulary)
    training = F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 0
    rows = [(r.doc_id, r.text or "", r.on) for r in docs.select("doc_id", "text", training.alias("on")).collect()]
    wanted, sums = plain_katz([t for _, t, _ in rows], [on for *_, on in rows], vocabulary)
    assert np.allclose(sums, 1)
    got = katz_lm.katz_scores(docs, training).collect()
    key = lambda i, n, k: (-1 if i is None else i, n, k)
    got = sorted(((key(r.doc_id, r.n_tokens, r.n_known), r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: (x[0], x[2]))
    wanted = sorted(((key(i, n, k), total, base, score) for (i, _, _), (n, k, total, base, score) in zip(rows, wanted, strict=True)), key=lambda x: (x[0], x[2]))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in wanted], rtol=1e-9)
    assert katz_lm.katz_scores(none, F.lit(True)).count() == 0


def test_katz_counts_every_word(spark):
    """Over 65,000 words that occur once: each is a context, and predicted, by itself."""
    texts = [*(" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(70)), "w1x1 w1x2", "w1x2 w1x1"]
    docs = spark.createDataFrame([(i, t, i < 70) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in katz_lm.katz_scores(docs, F.col("learn")).collect()}
    mass = 70_070 + 70_001 + 1  # N + V + 1
    half = lambda seen: 0.5 / (1 - seen / mass)  # noqa: E731  all pairs occur once, so half of each context is left
    wanted = [half(140) * 2 / mass * 0.5 * half(2) * 71 / mass, half(140) * 2 / mass * half(2) * 2 / mass * half(2) * 71 / mass]
    assert np.allclose([got[70].score, got[71].score], np.log10(wanted), rtol=1e-9)
    assert (got[70].n_tokens, got[70].n_known, got[70].train_tokens) == (3, 3, 70_070)


@pytest.mark.parametrize("vocabulary", [None, 6])
def test_katz_of_frequent_pairs(spark, monkeypatch, vocabulary):
    """Pairs in more documents than a slice sends places for, some several times in a text."""
    monkeypatch.setattr(katz_lm, "VOCABULARY", vocabulary)
    rng = random.Random(8)
    texts = ["all rights " * rng.choice([1, 1, 3]) + " ".join(f"w{rng.randrange(40)}" for _ in range(i % 7)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = sorted(katz_lm.katz_scores(docs, F.col("doc_id") % 4 != 1).collect(), key=lambda r: r.doc_id)
    wanted, _ = plain_katz(texts, [i % 4 != 1 for i in range(300)], 65_000 if vocabulary is None else vocabulary)
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:3] for w in wanted]
    assert np.allclose([(r.base_score, r.score) for r in got], [w[3:] for w in wanted], rtol=1e-9)


def test_slices(monkeypatch):
    monkeypatch.setattr(katz_lm, "SLICE", 3)
    monkeypatch.setattr(katz_lm, "SLICE_BYTES", 10)
    cut = lambda texts: [x.column("text").to_pylist() for x in katz_lm.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))]
    assert cut([]) == [] and cut(["", "", "", ""]) == [["", "", ""], [""]]
    assert cut(["x" * 20, "a", "b" * 9, "é" * 5, "c"]) == [["x" * 20], ["a", "b" * 9], ["é" * 5], ["c"]]


def test_memory_of_a_slice():
    """A slice takes little more than its tokens' posts, and what a worker remembers of words doesn't grow."""
    texts, slicer = [" ".join(f"w{(i * 31 + k * k) % 50_000}" for k in range(400)) for i in range(500)], katz_lm.Slicer(None, 64)
    tracemalloc.start()
    try:
        packed = sum(len(a) + len(b) for _, _, a, b in slicer.slice(texts, [True] * len(texts)))
        assert (tracemalloc.get_traced_memory()[1] - packed) / (401 * len(texts)) < 140
    finally:
        tracemalloc.stop()
    for i in range(4):
        list(slicer.slice([" ".join(f"{i}-{k}" for k in range(60_000))], [True]))
    assert len(slicer.hashes) <= katz_lm.REMEMBERED + 60_000


def test_katz_without_training(docs):
    rows = katz_lm.katz_scores(docs, F.lit(False)).collect()
    assert len(rows) == len(AWKWARD) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0 for r in rows)


def plain_components(sets):
    root = {i: i for i in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("block", "bridge"), [(512, 32), (8, 2), (4, 10_000)])
def test_near_duplicates(spark, none, monkeypatch, block, bridge):
    """Families of edited copies; with small blocks the posts are dealt out, with bridges and nearly without."""
    monkeypatch.setattr(minhash_join, "BLOCK", block)
    monkeypatch.setattr(minhash_join, "BRIDGE", bridge)
    rng = random.Random(9)
    texts = [t for t in AWKWARD if t != LONG]
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    wanted = plain_components(sets)
    got = {r.doc_id: r for r in minhash_join.near_duplicates(docs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == wanted
    assert all(got[i].kept == (wanted[i] == i) for i in got)
    assert minhash_join.near_duplicates(none).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8, each a component of its own: all but very few are found."""
    rng, texts, linked = random.Random(14), [], 0
    for i in range(400):
        words = [f"p{i}w{k}" for k in range(120)]
        edited = list(words)
        for k in range(15, 15 + 25 * (3 if i % 2 else 2), 25):  # each edit takes five shingles of 116 away
            edited[k] = f"e{i}x{k}"
        a, b = ({tuple(x[j : j + 5]) for j in range(116)} for x in (words, edited))
        linked += 100 * len(a & b) >= 75 * len(a | b)
        texts += [" ".join(words), " ".join(edited)]
        rng.shuffle(words)
    found = minhash_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert linked == 400 and found.filter("NOT kept").count() >= 0.99 * linked


def test_members_of_posts_in_brief(spark):
    """They bring far less than signatures, and a pair that agrees often enough still meets in its first common post, and only there."""
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 1 << 32, (40, 64), dtype=np.uint64).astype(np.uint32)
    sigs[20:] = np.where(rng.random((20, 64)) < 0.7, sigs[:20], sigs[20:])
    posts = minhash_join.prefix_posts(spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "node long, sig binary"), np.zeros((2, 0), np.uint64)).collect()
    holders = {}
    for row in posts:
        holders.setdefault(row.key, []).append(row.node)
    assert len(posts) == 40 * 31 and all(key & 0xFFFFFFFF == sigs[node, key >> 32] for key, ids in holders.items() for node in ids)
    holders = {key: ids for key, ids in holders.items() if len(ids) > 1}
    shared = {i: sum(1 << (key >> 32) for key, ids in holders.items() if i in ids) for i in range(40)}
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(key, 0, 0, i, 9, as_long(shared[i]), sigs[i].tobytes()) for key, ids in holders.items() for i in ids]
    brief = minhash_join.in_brief(spark.createDataFrame(rows, "key long, block long, side int, node long, n long, shared long, sig binary")).cache()
    told = brief.collect()
    assert len(told) == len(rows) and sum(len(r["values"]) + len(r["sketch"]) for r in told) < 0.4 * 256 * len(rows)
    first = {}
    for key, (i, j) in sorted(holders.items()):
        if (sigs[i] == sigs[j]).sum() >= minhash_join.MATCHES:
            first.setdefault((i, j), key)
    met = {}
    for row in minhash_join.matched(brief).collect():
        met.setdefault(row.key, []).append(row.node)
    assert len(first) > 15 and {tuple(sorted(ids)): key for key, ids in met.items()} == first and len(met) == len(first)


def test_left_over_pairs_meet_once(spark, monkeypatch):
    """Every two members of a large post in different components share one block, on different sides or on one."""
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    nodes = {bytes([i]): bytes([0 if i < 30 else 30 if i < 33 else i]) for i in range(60)}
    hot = spark.createDataFrame([(5, 1, n, 1, len(nodes)) for n in nodes], "key long, coord int, node binary, mask long, posted long")
    alone = spark.createDataFrame([(6, 1, n, 1, 3) for n in list(nodes)[:3]], hot.schema)  # one component already
    rows = minhash_join.left_over(hot.unionByName(alone), spark.createDataFrame(list(nodes.items()), "node binary, root binary")).collect()
    assert {r.key for r in rows} == {5}
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append((bytes(r.node), r.side))
    assert max(map(len, blocks.values())) <= 3 * minhash_join.BLOCK
    met = Counter(frozenset((a, b)) for members in blocks.values() for i, (a, x) in enumerate(members) for b, y in members[:i] if x != y or x == 0)
    assert set(met.values()) == {1}
    assert {frozenset((a, b)) for a in nodes for b in nodes if nodes[a] != nodes[b]} <= set(met)


def test_null_and_repeated_ids(docs):
    rows = minhash_join.near_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.doc_id in (19, 20, 21)} == {19}


def test_shingler_forgets(monkeypatch):
    from terrasift.llm import shingles

    text = prose("en", 300)
    whole = Shingler(5).of_text(text)
    monkeypatch.setattr(shingles, "REMEMBERED", 3)
    assert (Shingler(5).of_text(text) == whole).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (2, 1), *((20, 21 + i) for i in range(30))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4, 5], 1), **dict.fromkeys([7, 8, 9], 7), **dict.fromkeys(range(20, 51), 20)}
    path = spark.createDataFrame([(i, i + 1) for i in range(70)], "u long, v long")
    assert {r.root for r in connected_components(path).collect()} == {0}
    assert connected_components(path.limit(0)).count() == 0


def test_running_total(spark):
    rows = spark.createDataFrame([(i * 7 % 50, 1 + i % 3) for i in range(50)], "k long, n long")
    got = sorted((r.k, r.n, r.at) for r in running_total(rows, ["k"], "n", "at").collect())
    assert [x[2] for x in got] == [0, *np.cumsum([x[1] for x in got])[:-1].tolist()]


def test_json_is_untouched():
    assert json.loads(tokenizer_file("byte_bpe_50k.json"))["model"]["type"] == "BPE"
