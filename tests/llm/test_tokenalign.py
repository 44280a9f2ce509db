"""Token alignment against plain Python: shared boundaries as sets of offsets, pairs counted in dictionaries."""

import collections
import hashlib
import random

import fixtures as fx
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import queries
from tidewatch.llm import tokenalign as A
from tidewatch.llm.tokenfiles import BYTE_LETTERS, default_tokenizer

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.default_pieces())


def brute_tokens(text, libraries):
    """[(id, bytes)] of both sides, or None."""
    a, b = libraries
    if not text:
        return None
    letters = {chr(c): x for x, c in BYTE_LETTERS.items()}
    left = [(i, bytes(letters[ch] for ch in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = b" " + text.encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else None


def brute_groups(left, right):
    ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
    cuts = sorted(set(ends(left)) & set(ends(right)))
    out, i, j = [], 0, 0
    for cut in cuts:
        k = ends(left).index(cut) + 1
        m = ends(right).index(cut) + 1
        out.append(([t for t, _ in left[i:k]], [t for t, _ in right[j:m]]))
        i, j = k, m
    return out


def brute_report(texts, libraries):
    groups = []
    for t in texts:
        both = brute_tokens(t, libraries)
        groups.append(brute_groups(*both) if both else [])
    count = collections.Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), text))
    return out, count, top


def texts():
    rng = random.Random(9)
    odd = ["<|endoftext|> and <s> text </s>", "a▁b", "  two  spaces  ", " lead", "trail ", "\ttab", "a\r\nb", "\x00 nul \x00", "<0x41>", "漢字かな交じり文 と spaces", "🙂🙃 emoji", "é" * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 37 + "x", "ab" * 40, "﻿bom", "x y　z", "1234567890 3.14"]
    return [*fx.awkward_texts()[:24], *odd, *(fx.sentence(rng, n) for n in (1, 2, 7, 40, 40))]


def test_report(spark, libraries):
    docs = fx.documents(spark, texts())
    rows = docs.select("doc_id", "text").collect()
    want, count, top = brute_report([r["text"] for r in rows], libraries)
    for spell, size in ((False, A.BLOCK_BYTES), (True, 300)):
        found, pairs = A.align(docs, spell=spell, block_bytes=size)
        got = collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS), r["groups"]) for r in found.collect())
        shown = lambda t: t if spell else hashlib.sha256(t.encode()).hexdigest() if t else ""
        assert got == collections.Counter((r["doc_id"], *w[:-1], shown(w[-1])) for r, w in zip(rows, want))
        assert {(r["a"], r["b"]): (r["documents"], r["best"]) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in count.items()}
    assert any(w[2] and w[3] > w[2] for w in want) and any(t and not w[0] for (_, t), w in zip(rows, want))


def test_labels_are_the_shared_boundaries():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 400):
        for share in (0.1, 0.5, 0.9):
            a, b = (np.r_[np.flatnonzero(rng.random(n) < share) + 1, n + 1] for _ in range(2))
            got_a, got_b = A.group_labels(a, b)
            cuts = np.array(sorted(set(a.tolist()) & set(b.tolist())))
            assert (got_a == np.searchsorted(cuts, a)).all() and (got_b == np.searchsorted(cuts, b)).all()
    # one long chain: boundaries of 7 and 11 bytes meet every 77
    a, b = np.arange(7, 77_001, 7), np.arange(11, 77_001, 11)
    assert (A.group_labels(a, b)[0] == (a - 1) // 77).all()
    assert all(len(x) == 0 for x in A.group_labels(a[:0], b[:0]))


@pytest.mark.parametrize(("at_once", "large"), [(5, 1 << 40), (7, 3), (10**6, 4)])
def test_links_in_slices_and_large_groups(monkeypatch, at_once, large):
    monkeypatch.setattr(A, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(A, "LARGE_GROUP", large)
    rng = np.random.default_rng(4)
    length = np.array([1, 2, 3])
    encoded = []
    for n in (0, 12, 60, 0, 300):
        a = rng.integers(0, 3, n)
        b = rng.integers(0, 3, 3 * n)
        b = b[np.cumsum(length[b]) <= length[a].sum()]
        b = np.r_[b, np.zeros(length[a].sum() - length[b].sum(), np.int64)].astype(np.int64)
        encoded.append((a, b))
    done = A.Aligned.of(encoded, length, length)
    want = collections.Counter()
    for x, ga in zip(done.a.tolist(), done.group_a.tolist()):
        for y, gb in zip(done.b.tolist(), done.group_b.tolist()):
            if ga == gb:
                want[(int(done.group_doc[ga]), x * 3 + y)] += 1
    document, pair, times = done.links(3)
    assert list(zip(document.tolist(), pair.tolist(), times.tolist())) == [(*k, n) for k, n in sorted(want.items())]


def test_long_texts_are_read_in_windows(libraries):
    both = A.TwoTokenizers(default_tokenizer(), A.default_pieces())
    rng = random.Random(2)
    text = " ".join(rng.choice(["of the", "naïve", "x.  y", "\n", "it's", "42", "日本 語", "a b"]) + fx.sentence(rng, 3) for _ in range(300))
    parts = A.windows(text, 200)
    assert len(parts) > 10 and " ".join(parts) == text
    whole = both.encode(text)
    windowed = [np.concatenate(x) for x in zip(*(both.encode(p) for p in parts))]
    assert all((x == y).all() for x, y in zip(whole, windowed))
    left, right = brute_tokens(text, libraries)
    assert whole[0].tolist() == [i for i, _ in left] and whole[1].tolist() == [i for i, _ in right]
    assert A.windows("x" * 1000, 10) == ["x" * 1000]


def test_nothing(spark):
    docs = fx.documents(spark, [None, "", "▁"])
    found, pairs = A.align(docs)
    assert {tuple(r)[1:] for r in found.collect()} == {(0, 0, 0, 0, 0, 0, "")} and pairs.count() == 0
    found, pairs = A.align(docs.limit(0))
    assert found.count() == 0 and pairs.count() == 0


def test_registered_query(spark, libraries):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want, *_ = brute_report([r["text"] for r in rows], libraries)
    got = queries.QUERIES["op12_token_alignment"](spark, path)
    assert {r["doc_id"]: tuple(r[c] for c in (*COLUMNS, "groups_sha256")) for r in got.collect()} == {r["doc_id"]: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(rows, want)}
    assert got.where(F.col("n_links") > F.col("n_groups")).count() > 0
