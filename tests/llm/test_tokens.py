"""Encoding, packing and token shards against the tokenizers library and plain code."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdure.llm import bpe, packing, queries, text_units, token_store

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>a<|startoftext|> b", "ΑΣ ΣΑΣ. İstanbul ſ K", "it's we'll I'D 12345 ½ é é ​ x　y", "a" * 3000, "the" * 500, "🙂🙂 日本語", " \n\t ", "foo\x1cbar\x85baz\x1eq", "<|ENDOFTEXT|>", "ab\0cd ﻿", "áb ́x", "ẞ ß Ǆ ǅ", "x  \n\n y  　 z  "]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), bpe.trie_encoder(WORD), text_units.encoder(WORD, False)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE), text_units.encoder(BYTE, True)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def texts():
    random.seed(3)
    letters = list("aAbBéÉ'sStTzZ09.,!<|>_-=\"#$ \n\t\r\x0b\x0c\x1c\x1e\x85\xa0　İßſΣσς́​日🙂ǅ½²Ⅷ") + ["<|endoftext|>", "  ", "'ll", "the", "tion"]
    return ODD + ["".join(random.choices(letters, k=random.randint(1, 30))) for _ in range(1500)]


def test_same_ids_and_decoded_texts(word, byte):
    library, trie, units = word
    for text, (found, decoded) in zip(texts(), trie.encode(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(found) == want == ids(units.encode(text))
        assert decoded == library.decode(want, skip_special_tokens=False)
    for text in texts():
        assert ids(byte[1].encode(text)) == byte[0].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(word, byte, text):
    library, trie, units = word
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(trie.encode([text])[0][0]) == want == ids(units.encode(text))
    assert ids(byte[1].encode(text)) == byte[0].encode(text, add_special_tokens=False).ids


def test_trie_shares_prefixes(word):
    _, trie, _ = word
    got = trie.encode_words({"running", "runner", "run", "r", "zzzzqx"})
    for w, found in got.items():
        assert found == word[0].encode(w, add_special_tokens=False).ids


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 5, 6) for r in rows], "doc_id long, text string, ids string, length int, part int")


EDGES = [(8, "a" + " " * 500_000 + "\n" * 500_000 + "b"), (5, "one two"), (1, None), (3, ""), (None, "three four"), (2, "word " * 9000), (4, "one two"), (4, "one two"), (9, "<|endoftext|>")]


def test_encoded_edges(spark, word):
    got = bpe.encoded(table(spark, EDGES), WORD).collect()
    assert len(got) == len(EDGES)
    for r in got:
        pairs = [t for i, t in EDGES if i == r["doc_id"]]
        assert r["ids"] == word[0].encode(pairs[0] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert bpe.encoded(table(spark, EDGES).where("doc_id = 77"), WORD).count() == 0


def test_op8_whole_table(spark, word):
    rows = {r["doc_id"]: r["text"] for r in queries.documents(spark, "/root/testdata/sf0.001").collect()}
    got = queries.op8_bpe_trie(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        want = word[0].encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(word[0].decode(want, skip_special_tokens=False).encode()).hexdigest()


def held(pieces, docs, library, capacity):
    """Checks that pieces tile documents and sequences; returns the number of sequences."""
    by, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs.items():
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [capacity * k for k in range(len(own))]
        assert all(r["length"] == capacity for r in own[:-1]) and sum(r["length"] for r in own) == len(want)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *want[r["start"] : r["start"] + r["length"]]))
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    return len(bins)


def test_op7_whole_table(spark, word):
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, "/root/testdata/sf0.001").collect()}
    pieces = queries.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = held(pieces, docs, word[0], 4096)
    assert n <= -(-sum(r["length"] for r in pieces) // 4096) + 1


def test_packing_edges(spark, word):
    docs = {i: t for i, t in EDGES if i not in (4, None)}
    rows = [(i, t) for i, t in docs.items()]
    held(packing.pack(table(spark, rows), WORD).collect(), docs, word[0], 4096)
    got = packing.pack(table(spark, EDGES), WORD, keep_ids=True).collect()
    assert sum(r["length"] for r in got) == sum(len(word[0].encode(t or "", add_special_tokens=False).ids) + 1 for _, t in EDGES)
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert packing.pack(table(spark, EDGES).where("doc_id = 77"), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30), st.sampled_from([None, 2, 5]), st.sampled_from([None, 2000]), st.sampled_from(["norm", "dot"]))
def test_plans_hold_every_capacity(counts, documents, attention, rule):
    counts = {s: n for s, n in counts.items() if not attention or s * s <= attention}
    plan = packing.Plan(counts, 64, documents=documents, attention=attention, rule=rule)
    bins = defaultdict(list)
    for size, n in counts.items():
        sequence, offset = plan.place(np.full(n, size), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            bins[s].append((o, size))
    assert len(bins) == plan.sequences
    for places in bins.values():
        at = 0
        for o, size in sorted(places):
            assert o == at
            at += size
        assert at <= 64 and len(places) <= (documents or 64) and sum(s * s for _, s in places) <= (attention or 4096)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), min_size=1, max_size=12), st.sampled_from([None, 3]), st.sampled_from([None, 2500]), st.sampled_from(["norm", "dot"]))
def test_plans_are_the_choice_piece_by_piece(counts, documents, attention, rule):
    """Against the rule applied to one piece after the other."""
    counts = {s: n for s, n in counts.items() if not attention or s * s <= attention}
    limit = np.array([64, documents or 64, attention or 4096])
    bins: list = []
    for size in sorted(counts, reverse=True):
        need = np.array([size, 1, size * size])
        for _ in range(counts[size]):
            fits = [i for i, b in enumerate(bins) if (b[0] >= need).all()]
            if not fits:
                bins.append([limit.copy(), []])
                best = len(bins) - 1
            elif rule == "norm":
                best = min(fits, key=lambda i: round(float((((bins[i][0] - need) / limit) ** 2).sum()), 12))
            else:
                best = max(fits, key=lambda i: round(float((bins[i][0] / limit * need / limit).sum()), 12))
            bins[best][0] -= need
            bins[best][1].append(size)
    plan = packing.Plan(counts, 64, documents=documents, attention=attention, rule=rule)
    got = defaultdict(list)
    for size, n in counts.items():
        for s in plan.place(np.full(n, size), np.arange(n))[0].tolist():
            got[s].append(size)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(b[1]) for b in bins)


def test_plan_is_near_the_least():
    rng = np.random.default_rng(0)
    sizes, n = np.unique(np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True)
    plan = packing.Plan(dict(zip(sizes.tolist(), n.tolist(), strict=True)))
    assert plan.sequences <= -(-int((sizes * n).sum()) // 4096) * 1.005 + 1
    with pytest.raises(ValueError):
        packing.Plan({70: 1}, 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500))
def test_wavelet_matrix(values):
    x = np.array(values, np.uint32)
    m = token_store.WaveletMatrix.build(x, 9)
    assert m.all().tolist() == values
    for i in range(0, len(values), 97):
        assert m.access(i) == values[i] and m.rank(values[i], i) == values[:i].count(values[i])
    for token in set(values[:3]) | {301}:
        assert m.occurrences(token) == [i for i, v in enumerate(values) if v == token]
    with pytest.raises(IndexError):
        m.access(len(values))
    with pytest.raises(ValueError):
        token_store.WaveletMatrix.build(np.array([512], np.uint32), 9)


def test_shards_detect_damage():
    data = token_store.pack_shard(np.arange(1000, dtype=np.uint32), [(1, 400), (None, 600)], 16)
    matrix, keys, sizes = token_store.open_shard(data)
    assert keys == [1, None] and sizes.tolist() == [400, 600] and matrix.select(777, 0) == 777
    broken = bytearray(data)
    broken[200] ^= 255
    with pytest.raises((ValueError, zlib.error)):
        token_store.open_shard(bytes(broken))


@pytest.mark.parametrize("n", [1_000_000, 2_000_000, 10_000_000])
def test_long_white_space(byte, n):
    for text in [" " * n] if n > 2_000_000 else [" " * n, "a" + "\n" * n + "b", "\t" * n + "<|endoftext|>" + "\u3000 " * (n // 2) + "\n1"]:
        assert ids(byte[1].encode(text)) == byte[0].encode(text, add_special_tokens=False).ids


def test_runs_of_white_space_are_cut_by_the_pattern(byte, monkeypatch):
    monkeypatch.setattr(text_units, "_LONG_SPACE", text_units.re.compile(text_units._LONG_SPACE.pattern.replace("1000", "2")))
    rng = random.Random(5)
    for _ in range(1000):
        text = "".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "\xa0", "\u3000", "'s", "<|endoftext|>", "1", "!", "\x1c", "\x85"], k=20))
        assert byte[1]._pieces(text) == byte[0].encode(text, add_special_tokens=False).ids


def check_shards(got, docs, library):
    at = 0
    for (i, text), r in zip(docs, got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(want), zlib.crc32(np.asarray(want, "<u4").tobytes()))
        at += len(want)


def test_op9_whole_table(spark, byte):
    docs = sorted((r["doc_id"], r["text"]) for r in queries.documents(spark, "/root/testdata/sf0.001").collect())
    check_shards(sorted(queries.op9_token_wavelet(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["doc_id"]), docs, byte[0])


def test_shard_edges(spark, byte):
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = token_store.write_shards(table(spark, EDGES), BYTE, 2, roll=3)
    check_shards(sorted(token_store.read_documents(manifest).collect(), key=lambda r: r["start"]), order, byte[0])
    assert manifest.count() > 2
    assert token_store.read_documents(token_store.write_shards(table(spark, EDGES).where("doc_id = 77"), BYTE, 2)).count() == 0
