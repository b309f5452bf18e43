"""Spelling variants, window packing and collocations against brute-force versions."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import phrase_tries, spelling_variants, tier_packing
from tidewatch.llm.queries import op11, op12

SF_DIR = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(docs, damage=97, shortest=5, least=3, factor=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    by_size, out, form = defaultdict(list), {}, {}
    for w in n:
        by_size[len(w)].append(w)
    for w in n:
        close = [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = (n[w], len(close))
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, *out[w], None if form[w] is None else n[form[w]]))
    return rows


def as_rows(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdeéÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(300)]
    words += ["Straße", "STRASSE", "abcdeabcde" * 40, "abcdeabcde" * 40 + "a"]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]]
    docs = [(i, " ".join(rng.choices(words, weights=[1 + 40 // (1 + k % 37) for k in range(len(words))], k=200)).upper() if i % 5 == 0 else ", ".join(rng.choices(words, k=200))) for i in range(60)]
    docs += [(None, "abcde abcde Abcde"), (60, None), (61, ""), (62, docs[0][1]), (62, docs[0][1]), (63, "1234 中文abcdeŁ")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, word string, n string").repartition(3)
    want = slow_variants(docs)
    assert len([r for r in want if r[1]]) > 50 and len([r for r in want if r[2] != r[0] and r[2] != r[1]]) > 0
    for block, crowd in ((spelling_variants.BLOCK, spelling_variants.CROWD), (4, 6)):
        monkeypatch.setattr(spelling_variants, "BLOCK", block)
        monkeypatch.setattr(spelling_variants, "CROWD", crowd)
        assert as_rows(spelling_variants.group_variants(spelling_variants.vocabulary(frame, damage=97))) == want


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.group_variants(spelling_variants.vocabulary(empty)).count() == 0


def test_variant_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(op11(spark, SF_DIR)) == slow_variants(rows)


def test_crc_of_many_runs():
    data = np.frombuffer(b"abc\xc3\xa9xyzw", dtype=np.uint8)
    start, length = np.array([0, 3, 5, 8]), np.array([3, 2, 4, 1])
    before = np.array([zlib.crc32(p) for p in (b"1:", b":", b"77:", b"")], dtype=np.uint32)
    got = spelling_variants.crc32_of(before, data, start, length)
    assert [int(x) for x in got] == [zlib.crc32(b"1:abc"), zlib.crc32(":é".encode()), zlib.crc32(b"77:xyzw"), zlib.crc32(b"w")]


def check_pieces(pieces, docs, longest, shortest):
    """Every id in one piece, sequences without gaps, padding only below the shortest power of two; returns the rows."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in docs)
    rows = pieces.collect()
    windows = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        windows[r.sequence_id].append((r.offset, r.length, r.tier))
    for window in windows.values():
        at = 0
        for offset, length, tier in sorted(window):
            assert offset == at
            at += length
        assert at == tier <= longest and at & (at - 1) == 0
    assert len([w for w in windows.values() if w[0][2] < shortest]) < 10 * pieces.rdd.getNumPartitions()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in want.items())
    for doc_id, ids in ((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs):
        got = by_doc[doc_id]
        copies = sum(1 for i, _ in docs if i == doc_id)
        if copies == 1:
            assert tuple(itertools.chain.from_iterable(p for _, p in sorted(got))) == ids
    return rows


def test_packing_keeps_every_id(spark):
    rng = random.Random(7)
    docs = [(i, "".join(rng.choice(["word ", "Ünïcode ", "12345", "  \n\n", "\t x", "don't ", "中文", "<|endoftext|>", "\x1c", "aaaa"]) for _ in range(rng.choice([0, 1, 5, 60, 700, 3000])))) for i in range(150)]
    docs += [(None, "null id"), (1000, None), (1001, ""), (1002, "same"), (1002, "same")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, ids int").repartition(3)
    for pool in (1, 3000, 1 << 20):
        check_pieces(tier_packing.pack(frame, BPE, public_tokenizers.PATTERN, pool_tokens=pool), docs, 1024, 64)
    check_pieces(tier_packing.pack(frame, BPE, public_tokenizers.PATTERN, longest=64, shortest=16, pool_tokens=500), docs, 64, 16)
    assert tier_packing.pack(frame.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_chunks_do_not_change_ids():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "  ", "\n", "\t", "1", "'s", "é", "\x1c", " ", ".", "<|endoftext|>", " \n x"]) for _ in range(rng.randint(0, 80)))
        whole = tier_packing.encode(text, BPE, public_tokenizers.PATTERN)
        assert "".join(tier_packing.chunks(text, 5)) == text
        assert tier_packing.encode(text, BPE, public_tokenizers.PATTERN, size=5).tolist() == whole.tolist()


def test_packing_query_steps(spark):
    rows = op12(spark, SF_DIR).collect()
    size = {r.sequence_id: r.tier for r in rows}
    steps = Counter((r.tier, r.step_id) for r in rows if r.offset == 0)
    for (tier, step), n in steps.items():
        last = step == max(s for t, s in steps if t == tier)
        assert n == (1 << 17) // tier or (last and n < (1 << 17) // tier)
    tokens = Counter()
    for r in rows:
        tokens[r.sequence_id] += r.length
    assert tokens == size
    totals = {}
    for r in rows:
        totals[r.doc_id] = r.doc_tokens
    assert sum(totals.values()) == sum(tokens.values()) and len(totals) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_sequences_join_their_pieces(spark):
    frame = spark.createDataFrame([(i, "one two three " * (i + 1)) for i in range(40)], "doc_id long, text string").repartition(2)
    pieces = tier_packing.pack(frame, BPE, public_tokenizers.PATTERN)
    for r in tier_packing.sequences(pieces).collect():
        assert len(r.ids) == 4 * r.tier


def slow_phrases(docs, least, longest, share, top):
    total, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    rows = defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(len(q) > len(p) and m == lang and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= share * a for (m, q), c in found.items())
        if not inside:
            rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, got in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(got)[:top])}


@pytest.mark.parametrize("longest,shard", [(3, phrase_tries.SHARD), (3, 40), (4, 64), (2, 32)])
def test_phrases_equal_brute_force(spark, longest, shard, monkeypatch):
    monkeypatch.setattr(phrase_tries, "BLOCK_BYTES", 2000)
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "de", "É", "x y", "die", "the", "of", "new", "york", "\x00", "a b"]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " the new york "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    docs += [("en", None), ("en", ""), (None, "   "), ("en", "the the the the the the the the the the the the")]
    frame = spark.createDataFrame([(l, t, 1, "z") for l, t in docs], "lang string, text string, n int, word string").repartition(3)
    got = phrase_tries.collocations(frame, least=4, longest=longest, share=50, top=30, shard_phrases=shard)
    want = slow_phrases(docs, 4, longest, 50, 30)
    assert len(want) > 20
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrase_tries.collocations(empty).count() == 0
    few = spark.createDataFrame([("en", "one two")], "lang string, text string")
    assert phrase_tries.collocations(few).count() == 0


def test_wide_nodes_of_a_trie():
    """Nodes with over 32 and over 256 children, and phrases that are parts of others."""
    rng = np.random.default_rng(1)
    labels = np.unique(rng.integers(1, 2**63, 70000, dtype=np.uint64))
    pairs = np.stack([np.r_[labels[:3].repeat(900), labels[:2000]], np.r_[np.tile(labels[5:905], 3), labels[3000:5000]], np.zeros(4700, np.uint64)], axis=1)
    wide = np.stack([labels[7].repeat(66000), labels[:66000], np.zeros(66000, np.uint64)], axis=1)
    deep = np.c_[pairs[:500, :2], labels[600:1100]]
    phrases = np.unique(np.concatenate([pairs, wide, deep]), axis=0)
    lengths = (phrases != 0).sum(axis=1)
    trie = phrase_tries.build_trie(phrases, lengths)
    assert trie.digits == 3
    at = rng.permutation(len(phrases))
    code = np.searchsorted(labels, phrases[at].ravel())
    flat = np.flatnonzero(phrases[at].ravel())
    words = phrase_tries.Words(code[flat], np.repeat(np.arange(len(at)), 3)[flat], [])
    got = phrase_tries.count_in_block(trie, words, labels, len(phrases), 3)
    want = np.ones(len(phrases), dtype=np.int64)
    row = {tuple(p): i for i, p in enumerate(phrases)}
    for p in deep:
        for part in ((p[0], p[1], 0), (p[1], p[2], 0)):
            if part in row:
                want[row[part]] += 1
    assert (got == want).all()
