"""Every text operator against plain Python on awkward tables."""

import collections
import hashlib
import math
import os
import random
import tracemalloc
import zlib

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, htmltext, jaccardjoin, langid, licenses, linededup, lm, mixing, quality, text, tokenfiles
from tidewatch.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return fx.as_pairs(docs)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Mit Mit License"), (3, None), (4, ""), (5, "zero one two three four five six seven eight nine ten"), (11, "license")]


def planted():
    body = "one two three four five six seven eight nine ten eleven twelve"
    return [f"pre {body} post {body}", body.replace(" ", ", ").upper(), "one two three four five six seven eight nine", f"x x x {body[8:]}", "zero one two three four five six seven eight nine ten eleven", "a mit mit license b", None, "", body * 1 + " " + body[:45]]


def test_words_are_those_of_the_pattern():
    texts = [(t or "").encode() for t in fx.awkward_texts()]
    hashes, per_text, *_ = text.flat_words(texts)
    words = [w for t in texts for w in fx.WORD.findall(t.lower())]
    assert per_text.tolist() == [len(fx.WORD.findall(t)) for t in texts]
    assert len(np.unique(hashes)) == len(set(words)) and len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)}) == len(set(words))
    assert [len(s) for s in text.shingle_sets(hashes, per_text, 5)] == [len(fx.shingles(t.decode())) for t in texts]
    assert len(text.flat_words([])[0]) == 0
    long = (b"x" * 70_000 + b" ") * 3
    assert len(set(text.flat_words([b"a " * 50_000 + long])[0].tolist())) == 2


def test_near_duplicates(spark, docs, rows, empty):
    want = fx.brute_components(rows)
    got = jaccardjoin.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert any(i != c for i, (_, c) in want.items())
    kept = jaccardjoin.keep_one_of_each(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} and kept.columns == docs.columns
    assert jaccardjoin.near_duplicates(empty).collect() == []


def test_near_duplicates_in_small_blocks(spark):
    """A large family of edited copies, chains of them, and a passage that many others hold: every link counts."""
    rng = random.Random(3)
    words = fx.sentence(rng, 90).split()
    texts, chain = [" ".join(words)] * 4, list(words)
    for _ in range(60):
        edited = list(words)
        edited[rng.randrange(90)] = "edit" + str(rng.random())
        texts.append(" ".join(edited))
    for _ in range(25):
        chain[rng.randrange(90)] = "step" + str(rng.random())
        texts.append(" ".join(chain))
    passage = fx.sentence(rng, 55)
    texts += [passage + " " + fx.sentence(rng, rng.choice((8, 12, 14, 60))) for _ in range(40)]
    docs = fx.documents(spark, texts, extra=False)
    want = fx.brute_components(fx.as_pairs(docs))
    for options in ({}, {"block_sets": 3, "block_queries": 4, "owner_bytes": 3_000}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.near_duplicates(docs, **options).collect()}
        assert got == want


def test_counting_shingles_keeps_no_places_of_all_codes():
    """Classes as from plain counts, in little more memory than the sorted codes and those that repeat."""
    rng = np.random.default_rng(5)
    codes = [np.sort(rng.integers(0, 600_000, n, dtype=np.uint32)).astype("<u4") for n in (400_000, 0, 1, 300_000, 100_000)]
    counts = np.bincount(np.concatenate(codes))
    tracemalloc.start()
    told = jaccardjoin.rounded_counts(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == [np.floor(np.log2(counts[c])).astype(np.uint8).tobytes() for c in codes]
    assert jaccardjoin.rounded_counts([codes[2], codes[1]]) == [b"\0", b""]
    assert peak < 6 * sum(c.nbytes for c in codes)  # twelve times with places and inverse of all


def test_near_duplicates_of_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, "x"), (1, "y"), (3, "y")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccardjoin.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (2, 2), (1, 1), (1, 1), (3, 1)], key=str)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 99), (99, 98), (5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), **dict.fromkeys((98, 99, 100), 98)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_quality_base_and_monotone_trees(spark, docs, rows, empty):
    got = quality.score_quality(docs, None).collect()
    want = {i: fx.brute_base(t) for i, t in rows}
    assert len(got) == docs.count()
    for r in got:
        base = tuple(r[c] for c in quality.BASE)
        assert base == want[r["doc_id"]], (r["doc_id"], base)
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and r["kept"] == (not r["base_failed"])
    assert quality.score_quality(empty, None).collect() == []
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(600)) > 0).astype(float)
    forest = quality.fit_forest(x, y, np.array([1, -1, 0]))
    assert ((forest.margin(x) > 0) == (y > 0)).mean() > 0.85
    line = np.linspace(-0.2, 1.2, 300)
    for at in rng.random((40, 3)):
        for j, sign in ((0, 1), (1, -1)):
            path = np.repeat(at[None], 300, 0)
            path[:, j] = line
            assert (sign * np.diff(forest.margin(path)) >= -1e-12).all()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = text.table(spark, folder, "documents"), text.table(spark, folder, "labels")
    train = labels.filter("doc_id % 2 = 0")
    forest = quality.fit_on_labels(docs, train)
    test = quality.score_quality(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    good = [r["kept"] for r in test if r["quality"] == 1]
    bad = [r["kept"] for r in test if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
    assert quality.fit_on_labels(docs, labels.filter("quality = 1")) is None and quality.fit_on_labels(docs, labels.limit(0)) is None


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit(1))
    mixed = docs.select("doc_id", "text").unionAll(fx.documents(spark, planted(), extra=False).select(F.col("doc_id") + 1000, "text"))
    got = decontaminate.decontaminate(mixed, items).collect()
    want = {i: fx.brute_hits(t, ITEMS) for i, t in fx.as_pairs(mixed)}
    assert len(got) == mixed.count() and sum(r["contaminated"] for r in got) > 5
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(r["items"].encode()).hexdigest(), r["contaminated"]) == want[r["doc_id"]], r
    kept = decontaminate.keep_uncontaminated(mixed, items)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]} and kept.columns == mixed.columns
    assert decontaminate.decontaminate(empty, items).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(mixed, items.limit(0)).collect())


def test_every_long_shared_span_is_found(spark):
    """Winnowing must not miss a span of a window's length, wherever it starts."""
    rng = random.Random(11)
    items = [(i, fx.sentence(rng, 40)) for i in range(6)]
    texts = []
    for _, item in items:
        words = item.split()
        for k in range(0, 31, 3):
            texts.append(" ".join([fx.sentence(rng, rng.randint(0, 6)), *words[k : k + 10], fx.sentence(rng, 4)]))
            texts.append(" ".join(["q", *words[k : k + 9], "q"]))
    docs = fx.documents(spark, texts, extra=False)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: fx.brute_hits(t, items)[:3] for i, t in fx.as_pairs(docs)}


def test_line_dedup(spark, docs, rows, empty):
    want = fx.brute_lines(rows)
    got = linededup.drop_repeated_lines(docs).collect()
    assert len(got) == docs.count() and any(r["n_dropped"] for r in got)
    assert all((r["n_lines"], r["n_dropped"], r["kept_text"]) == want[r["doc_id"]] for r in got)
    three = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_repeated_lines(docs, min_docs=4).collect()}
    assert three == {i: w[1] for i, w in fx.brute_lines(rows, min_docs=4).items()}
    assert linededup.drop_repeated_lines(empty).collect() == []


def brute_scores(rows, times):
    tokens = {i: [*fx.WORD.findall((t or "").encode().lower()), None] for i, t in rows}
    teach = [i for i in tokens for _ in range(times[i]) if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for i in teach for w in tokens[i])
    two = collections.Counter(p for i in teach for p in zip(tokens[i], tokens[i][1:]))
    arcs = {p: n for p, n in two.items() if n >= 2}
    gone = collections.Counter()
    for (a, _), n in arcs.items():
        gone[a] += n - 0.75
    total, kinds = sum(one.values()), len(one)
    out = {}
    for i, seq in tokens.items():
        base = score = 0.0
        for k, w in enumerate(seq):
            root = (one[w] + 1) / (total + kinds + 1)
            base += math.log10(root)
            h = seq[k - 1] if k else None
            left = 1 - gone[h] / one[h] if k and one[h] else 1
            n = arcs.get((h, w)) if k else None
            score += math.log10(((n - 0.75) / one[h] if n else 0) + left * root)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(seq), sum(one[w] > 0 for w in seq), total, base, score)
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4_000, "owner_bytes": 9_000}])
def test_language_scores(docs, rows, empty, options):
    times = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    want = brute_scores(rows, times)
    got = lm.language_scores(docs, **options).collect()
    assert len(got) == docs.count()
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4] and r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])
    assert lm.language_scores(empty).collect() == []


def test_language_model_of_order_3(spark, docs, rows):
    """Single bigrams and trigrams are arcs too, in one block or many, and no owner gathers the followers of one word."""
    times = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    tokens = {i: [*fx.WORD.findall((t or "").encode().lower()), None] for i, t in rows}
    counts, arcs = collections.Counter(), collections.defaultdict(set)
    for i, seq in tokens.items():
        for n in (1, 2, 3) if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            for k in range(len(seq) - n + 1):
                gram = tuple(seq[k : k + n])
                counts[gram] += times[i]
                arcs[gram[:-1]].add(gram)
    total, kinds = sum(c for g, c in counts.items() if len(g) == 1), len(arcs[()])

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + kinds + 1)
        seen, n = counts[gram[:-1]], counts[gram]
        return ((n - 0.75) / seen if n else 0) + (0.75 * len(arcs.get(gram[:-1], ())) / seen if seen else 1) * p(gram[1:])

    want = {i: sum(math.log10(p(tuple(seq[max(0, k - 2) : k + 1]))) for k in range(len(seq))) for i, seq in tokens.items()}
    for options in ({}, {"block_bytes": 4_000, "owner_bytes": 9_000}):
        got = {r["doc_id"]: r["score"] for r in lm.language_scores(docs, order=3, min_count=1, **options).collect()}
        assert got == {i: pytest.approx(w) for i, w in want.items()}


def test_followers_of_a_hot_word_are_spread():
    hashes, per_text = lm.tokens_of([b" ".join(b"the w%d" % k for k in range(2_000))])
    asked = lm._ask(0, lm.Grams(hashes, per_text, np.ones(1, bool), 2), 8).to_pylist()
    assert len(asked) == 8 and max(len(m["followers"]) // 4 for m in asked) < 2 * 4_000 / 8


def test_asking_for_counts_takes_few_bytes():
    """Trigrams of many words, 13 bytes each when they left a block as state, last word and count; the rounds of squeezing lose nothing."""
    rng = np.random.default_rng(5)
    hashes, per_text = lm.tokens_of([b" ".join(b"w%d" % k for k in rng.integers(0, 5_000, 200_000))])
    g, asked = lm.Grams(hashes, per_text, np.ones(1, bool), 3), 0
    for orders in ((0, 1), (2,)):
        for m in lm._ask(0, g, 8, orders).to_pylist():
            asked += sum(len(x) for x in m.values() if isinstance(x, bytes))
    assert asked < 8 * sum(map(len, g.keys))
    for n, limit in ((1, 1 << 64), (2, 5), (999, 10_000), (5_000, 1 << 61), (4_001, 1 << 40), (3, 3)):
        places = np.unique(rng.integers(0, limit - 1, n, np.uint64, endpoint=True))
        places[-1] = limit - 1
        assert (lm.unsqueeze(lm.squeeze(places, limit), len(places), limit) == places).all()
    assert len(lm.unsqueeze(b"", 0, 7)) == 0


def test_exchanges_behind_a_cut_are_released(spark, docs, monkeypatch):
    """Each pass over the texts cuts its lineage with its exchanges given back, and the session's setting is as before."""
    from tidewatch.operators import ordering

    seen, before = [], spark.conf.get(ordering.RELEASE, "false")
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: seen.append(spark.conf.get(ordering.RELEASE)) or cut(df))
    lm.language_scores(docs, order=3, min_count=1)
    assert seen == ["true"] * 3 and spark.conf.get(ordering.RELEASE) == before


def test_language_model_sums_to_one(spark):
    """Over all words and the end, what follows a word has probability 1, less the unknown word's share."""
    texts = ["a b a b a c", "a b c", "b a b", "c c c c c"]
    df = spark.createDataFrame([(i * 7 + 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = ["a", "b", "c"]
    probes = spark.createDataFrame([(k + 1, t) for k, t in enumerate(["a a", "a b", "a c", "a"])], "doc_id long, text string")
    held = [k for k in range(1, 3000) if zlib.crc32(str(k).encode()) % 7 == 2]
    taught = [k for k in range(1, 3000) if zlib.crc32(str(k).encode()) % 7 != 2]
    all_rows = [(taught[i], t) for i, t in enumerate(texts)] + [(held[0], "a"), (held[1], "a a"), (held[2], "a b"), (held[3], "a c"), (held[4], "a q"), (held[5], "")]
    got = {r["doc_id"]: r["score"] for r in lm.language_scores(spark.createDataFrame(all_rows, df.schema)).collect()}
    # p(x | a): score of "a x" is p(a) p(x|a) p(end|x); take p(end|x) off by counts
    one = collections.Counter(w for t in texts for w in [*t.split(), None])
    two = collections.Counter(p for t in texts for p in zip([*t.split(), None], [*t.split(), None][1:]))
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (n + v + 1)
    left = lambda h: 1 - sum(c - 0.75 for (a, _), c in two.items() if a == h and c >= 2) / one[h] if one[h] else 1
    p_end = lambda h: ((two[h, None] - 0.75) / one[h] if two[h, None] >= 2 else 0) + left(h) * root(None)
    total = 10 ** got[held[0]] / root("a")
    for k, w in zip(held[1:5], [*words, "q"], strict=True):
        total += 10 ** got[k] / root("a") / p_end(w)
    assert total == pytest.approx(1.0)
    assert probes.count() == 4


def test_mixing(spark, docs, empty):
    rows, order = mixing.mix(docs, rows_per_bucket=7)
    table, turns = rows.collect(), order.collect()
    assert len(table) == docs.count()
    size = collections.Counter()
    for r in table:
        size[r["source"]] += r["size"]
    sources = sorted((x for x in size if x is not None), key=lambda x: x) + [None] * (None in size)
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size.values()))
    while free:  # take out what is above its limit until nothing is
        level = left / sum(weight[x] for x in free)
        over = {x for x in free if weight[x] * level > 3 * size[x]}
        target |= {x: 3.0 * size[x] for x in over} if over else {x: weight[x] * level for x in free}
        left -= sum(3.0 * size[x] for x in over)
        free = free - over if over else set()
    taken = collections.Counter()
    for r in turns:
        taken[r["source"]] += r["size"]
    largest = max(r["size"] for r in table)
    for r in table:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    for x in sources:
        assert target[x] <= taken[x] < target[x] + largest or taken[x] == size[x] * 3
    uses = collections.Counter((r["_id"], r["_row"]) for r in turns)
    copies = collections.Counter((r["_id"], r["_row"]) for r in table)
    assert all(n <= 3 * copies[k] for k, n in uses.items())
    assert [r["position"] for r in turns] == sorted(r["position"] for r in turns) and all(0 <= r["position"] <= 1 for r in turns)
    again = mixing.mix(docs.repartition(5), rows_per_bucket=1000)[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, turns))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(turns)
    assert mixing.mix(empty)[1].collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_demand_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        shares = [k / 20 for k in range(21)]
        got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.demand_time(F.col("s"), knots)).collect()]
        for s, t in zip(shares, got, strict=True):
            asked = 0.0
            for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
                x = min(max(t - t0, 0), t1 - t0)
                asked += h0 * x + (h1 - h0) / (t1 - t0) * x * x / 2
            assert asked / sum(areas) == pytest.approx(s, abs=1e-9)


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenfiles.default_tokenizer())
    got = sorted(tokenfiles.token_rows(docs, block_ids=200).collect())
    place = 0
    texts = dict(rows)
    assert len(got) == docs.count()
    for r in got:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (r["doc_id"], place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
    assert tokenfiles.token_rows(empty).collect() == []


def test_token_files_read_the_vocabulary_once_a_worker(spark, rows):
    docs = spark.createDataFrame([(i, f"{t or ''} word{i}") for i, t in rows], "doc_id long, text string").repartition(6)

    def tasks(batches):
        for batch in batches:
            coder = tokenfiles.encoder(tokenfiles.default_tokenizer())
            for text in batch.column(1).to_pylist():
                coder.encode(text)
            coder.forget(3)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([id(coder)], pa.int64()), pa.array([len(coder.known)], pa.int64())], names=["pid", "coder", "known"])

    got = [r for _ in range(3) for r in docs.mapInArrow(tasks, "pid long, coder long, known long").collect()]
    assert len({(r["pid"], r["coder"]) for r in got}) == len({r["pid"] for r in got}) < len(got)
    assert all(r["known"] <= 3 for r in got)
    coder, fresh = tokenfiles.encoder(tokenfiles.default_tokenizer()), tokenfiles.Encoder(tokenfiles.default_tokenizer())
    for _, t in rows:
        assert coder.encode(t or "").tolist() == fresh.encode(t or "").tolist()
        coder.forget(2)


def test_pieces_encode_like_whole_texts():
    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "B", "é", "1", "23", "'s", "'", "!", "\t", "<|endoftext|>", "\xa0", "漢", ".", "\n\n", "\x00", "👍", "\x1c", "\x85", "​", "word"]
    for _ in range(5_000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert coder.library.encode(x, add_special_tokens=False).ids == coder.encode(x).tolist(), repr(x)


def test_variable_length_code_round_trip():
    rng = np.random.default_rng(2)
    edges = np.array([0, 1, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in range(9):
        assert (tokenfiles.decode_numbers(*tokenfiles.encode_numbers(edges[:n]), n) == edges[:n]).all()
    for ids in (edges, np.zeros(0, np.uint32), rng.integers(0, 50_000, 10_001).astype(np.uint32), np.full(7, 9, np.uint32)):
        assert (tokenfiles.decode_block(tokenfiles.encode_block(ids)) == ids).all()
    with pytest.raises(ValueError):
        tokenfiles.decode_block(b"nope" + b"\0" * 20)


def test_licenses(docs, rows, empty):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    texts = dict(rows)
    for r in got:
        words = fx.ALNUM.findall(fx.low(texts[r["doc_id"]]))
        want = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert r["n_words"] == len(words) and sorted((b["at"], b["label"]) for b in r["base"]) == want
        assert r["base_labels"] == ",".join(sorted({w[1] for w in want})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["found"])
    assert licenses.scan_licenses(empty).collect() == []


def test_license_rules_reach_as_far_as_their_patterns(spark):
    """A holder of many short words, and one that is too long for the pattern."""
    holder = "the a b c d e f g h i j k l m n o p q r"
    texts = [f"Neither the name of {holder} nor the names of its contributors", f"Neither the name of {holder * 4} nor the names of x", "You should have received a copy of the GNU Lesser General Public License"]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "bsd-3-clause" in got[0] and "bsd-3-clause" not in got[1] and "lgpl-notice" in got[2]
    assert len(licenses.parse_rules()) > 200


def test_license_rules_resolve_overlaps(spark):
    texts = ["licensed under the Apache License, Version 2.0.", "the Apache License", "GNU Lesser General Public License v2.1 or MPL 2.0", "cc by-nc-sa 4.0", "Copyright (c) 2020 X. All rights reserved.", "mit and apache and gnu", "SPDX-License-Identifier: MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert labels[0] == "apache,apache-2.0"  # the base label stays, the weaker detections inside are suppressed
    assert labels[1] == "apache" and labels[2] == "lgpl-2.1,mpl-2.0" and labels[3] == "cc-by,cc-by-nc-sa-4.0"
    assert labels[4] == "all-rights-reserved,copyright-notice" and labels[5] == "" and labels[6] == "spdx-tag"
    rules = licenses.parse_rules()
    assert len(rules) > 150 and {r.tier for r in rules} == {1, 2, 3, 4}


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu, menu</a></nav><div class='CLASS'><h1>A &amp; B</h1><p>first  <b>bold</b>er,\n text<br>next<script>no()</script><p>second &eacute;<div class='comments'>no</div></div><aside>no</aside><footer>no, no</footer>"


def test_html(spark, empty):
    pages = [(1, "http://www.a.example/1", PAGE.replace("CLASS", "main-1")), (2, "http://a.example:80/2?x", PAGE.replace("CLASS", "main-2")), (3, None, PAGE.replace("CLASS", "x")), (4, "odd", None), (5, "http://b.example", ""), (6, "http://b.example", "just text"), (7, "http://b.example", "<nav>only menus</nav>"), (8, "http://a.example/3", "<p>lone &lt;paragraph&gt;")]
    df = spark.createDataFrame(pages + pages[:1], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("weight", F.lit(2))
    got = {r["page_id"]: r for r in htmltext.extract(df).collect()}
    body = "A & B first bolder, text next second é"
    assert {k: r["text"] for k, r in got.items()} == {1: body, 2: body, 3: body, 4: "", 5: "", 6: "just text", 7: "", 8: "lone <paragraph>"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[1]["path"] == got[2]["path"] and got[1]["host"] == got[2]["host"] == "a.example"
    assert htmltext.extract(df.limit(0)).collect() == []


def test_html_of_articles_in_several_parts(spark):
    """Title, lead and body in containers of their own; another template on the same host; sections without an article."""
    lead, body, teaser = "A lead of some words. " * 3, "The body goes on, and on. " * 40, "Read this too."
    split = f"<body><nav>menu</nav><article><h1>Title</h1><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></article><div class=more>{teaser}</div></body>"
    other = f"<body><article>{teaser}</article><div class=story><h1>Title</h1><p>{body}</p></div></body>"
    sections = f"<body><div class=wrap><h1>Title</h1>{''.join(f'<section><div class=s{c}><p>{c} {lead}</p></div></section>' for c in 'abc')}</div></body>"
    both = f"<body><main><h1>Title</h1><article><p>{body}</p></article></main><div>{teaser}</div></body>"
    links = "<body><div><a href=x>only links here</a></div></body>"
    pages = [*[(k, "http://a.example/", split) for k in range(4)], (4, "http://a.example/", other), (5, "http://b.example/", sections), (6, "http://c.example/", both), (7, "http://d.example/", links)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    one = lambda x: " ".join(x.split())
    assert all(got[k] == one(f"Title {lead} {body}") for k in range(4))
    assert got[4] == one(f"{teaser} Title {body}")
    assert got[5] == one(f"Title a {lead} b {lead} c {lead}")
    assert got[6] == one(f"Title {body}") and got[7] == "only links here"


def test_html_names_and_icons_keep_the_article(spark):
    """Names that only contain a boilerplate word, wrappers of the whole page, icons without an end tag of their own."""
    body = "The body goes on, and on. " * 20
    want = " ".join(body.split())
    tags = ["div class='content has-sidebar'", "main class=no-sidebar", "div class='entry with-comments'", "div class=share-price", "div id=form-guide", "div class=modal", "div id='page-header'", "div class=formation", "article class=sidebar-left"]
    pages = [f"<body><nav>menu</nav><{t}><p>{body}</p><div class=comments>no</div></{t.split()[0]}></body>" for t in tags]
    nested = f"<body><div class=overlay><div class=popup><div class=modal><div class=widget><div class=side><p>{body}</p></div></div></div></div></div></body>"
    icons = [f"<body><div><svg width=1 />{body[:130]}<math/>{body[130:]}</div></body>", f"<body><div><svg>x</svg><svg width=1>{body}</div></body>", f"<body><p><svg/>{body}</p><svg><text>no</text></svg></body>"]
    dropped = [f"<body><div class={c}>no, no</div><article><p>{body}</p><div id={c}>no</div></article></body>" for c in ("ad", "ad-slot", "main-nav", "site_footer", "sidebar2", "post-comments", "comment-list", "cookie-banner", "related-posts")]
    rows = [(k, f"http://h{k}.example/", p) for k, p in enumerate([*pages, nested, *icons, *dropped])]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: t for k, t in got.items() if t != want} == {}


def own_text(page):
    nodes = htmltext.read_page(page)
    node, _ = htmltext.best_path(nodes)
    return (node and htmltext.text_on(nodes, node.key)) or ""


def test_html_keeps_whole_articles():
    """Forms and hidden elements around a page, slugs as ids, an article's own header, quotes that never close."""
    body = "The body goes on, and on. " * 20
    want = " ".join(body.split())
    wrapped = [
        f"<body><form id=aspnetForm><div class=menu>{'menu ' * 300}</div><div><h1>T</h1><p>{body}</p><input value=x></div></form></body>",
        f"<body><form action=/x><p>T {body}</p><button>Send</button></form></body>",
        f"<body hidden><div hidden><p>T</p><p>{body}</p></div></body>",
        f"<body><div style='display: none'><article><p>T</p><p>{body}</p></article></div><footer>f</footer></body>",
    ]
    assert {k: own_text(p) for k, p in enumerate(wrapped) if own_text(p) != f"T {want}"} == {}
    assert own_text("<body><form><label>Name</label><input><label>Word</label></form></body>") == ""
    assert own_text(f"<body><div><p>{body}</p></div><form><label>Name</label></form><div hidden>x</div></body>") == want
    slugs = f"<article><h2 id=related>A</h2><p>{body}</p><section id=search><h2>B</h2><p>{body}</p></section><div class=legal>{body}</div><div class=tags><a href=x>one</a> <a href=y>two</a></div><section id=comments><p>no</p></section></article>"
    assert own_text(f"<body><nav>m</nav>{slugs}</body>") == f"A {want} B {want} {want}"
    assert own_text(f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{body}</p><footer>f</footer></article></body>") == f"Title {want}"
    comments = f"<div class=comments>{'<p>A long remark of a reader.</p>' * 100}</div>"
    assert own_text(f"<body><article><h1>Title</h1><p>Short.</p></article>{comments}</body>") == "Title Short."
    assert own_text(f"<body><h1>Title</h1><p>Short.</p>{comments}</body>") == "Title Short."
    for link in ('<a href="x>', "<a href='x>", '<a href="x" title="y>', '<a href=x">', '<a" href=x>'):
        assert own_text(f"<body><p>one {link}two</a> three</p></body>") == "one two three", link
    assert own_text('<body><p>one <a href="x>two</a> <b class="y">three</b></p></body>') == "one two three"
    assert own_text('<body><p>one <a title="a > b <i>c</i>" href=x>two</a></p></body>') == "one two"


def test_html_is_read_in_linear_time():
    import time

    n = 40_000
    hostile = ["<a" * n + '"', "<i>" * n + "</b>" * n, "<b>" + "<i>" * n + "<div>" + "</b>" * n, "<i>" * n + "<div></div>" * n, "<span>" * n + "<td></td>" * n, "<svg>" * n, "<a " + "x" * 20 * n + "=>", '<a x="' * n, "<!" * n, "<a x= " + " " * n + "=" * n]
    for page in hostile:
        begun = time.perf_counter()
        own_text(page)
        assert time.perf_counter() - begun < 5, page[:20]


def test_html_on_pages(spark):
    import html
    import re

    rows = htmltext.extract(text.table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(rows) == 250
    for r in rows:
        article = r["html"].split("<article>", 1)[1].split("</article>")[0]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_odd_html_never_fails():
    rng = random.Random(4)
    parts = ["<", ">", "<p>", "</p>", "<div class=a>", "</div>", "<b", "\"", "'", "<!--", "-->", "<script>", "</script>", "&amp;", "&#x110000;", "text", "<li>", "</ul>", "<td>", "<br/>", "</b>", "<a href='x'>", "</nav>", "<nav>"]
    for _ in range(2_000):
        nodes = htmltext.read_page("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        node, _ = htmltext.best_path(nodes)
        htmltext.text_on(nodes, node and node.key)
    deep = "<div>" * 5_000 + "x" + "</div>" * 4_000
    nodes = htmltext.read_page(deep)
    assert htmltext.text_on(nodes, htmltext.best_path(nodes)[0].key) == "x"


def test_language_id(spark, docs, empty):
    got = langid.predict_language(docs.drop("score")).collect()
    assert len(got) == docs.count()
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert langid.predict_language(empty.drop("score")).collect() == []
    nothing = langid.predict_language(docs.drop("score").withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_id_means_the_same_at_every_length(spark):
    docs = text.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    known = langid.language_dictionaries(docs)
    once = docs.filter("length(text) between 3000 and 4000 and lang is not null").limit(20).select("doc_id", F.concat("text", F.lit(" ")).alias("text")).cache()
    short, long = (sorted((r["doc_id"], r["lang_pred"], r["score"], r["margin"]) for r in langid.identify(d, known).collect()) for d in (once, once.withColumn("text", F.repeat("text", 30))))
    assert len(short) == 20
    for a, b in zip(short, long, strict=True):
        assert a[:2] == b[:2] and b[2] == pytest.approx(a[2], rel=0.1) and b[3] == pytest.approx(a[3], rel=0.25)


def test_language_id_on_held_out_documents(spark):
    rows = langid.predict_language(text.table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").select("lang", "lang_pred", "rejected").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows]
    sure = [r["lang"] == r["lang_pred"] for r in rows if not r["rejected"]]
    assert sum(right) >= 0.97 * len(right) and sum(sure) >= 0.99 * len(sure)
