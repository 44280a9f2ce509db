"""The registered text queries: against SQL where there is some, and whole."""

import collections

import duckdb
import pytest
from conftest import TINY

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import mixing
from tidewatch.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df, expected = QUERIES[name](spark, TINY), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    rounded = lambda v: round(v, 4) if isinstance(v, float) else v
    ours = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(rounded(dict(zip(expected.columns, r, strict=True))[c]) for c in columns) for r in expected.fetchall()), key=str)
    assert ours == theirs


def test_every_operator_and_the_pipeline_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_against_its_stages_in_python(spark):
    """Each stage's decisions, made again in plain Python from what the stage before it kept."""
    import zlib

    import fixtures as fx
    import numpy as np
    from tokenizers import Tokenizer

    from tidewatch.llm import mixing, quality, text, tokenfiles

    docs = text.table(spark, TINY, "documents")
    (_, keep), (_, dedup), (_, clean), (_, mix), (_, encode) = corpus_pipeline.STAGES
    step = keep(spark, docs, TINY).cache()
    assert step.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    everything = {r["doc_id"]: r["text"] for r in docs.collect()}
    forest = quality.fit_on_labels(docs, text.table(spark, TINY, "labels"))
    ids = sorted(everything)
    counts = quality.statistics([(everything[i] or "").encode() for i in ids])
    chance = 1 / (1 + np.exp(-forest.margin(quality.feature_rows(counts))))
    base = {i: fx.brute_base(everything[i]) for i in ids}
    assert set(kept) == {i for i, c in zip(ids, chance, strict=True) if c >= 0.5 and base[i][0] >= 50 and 100 * base[i][4] <= 50 * base[i][0]}

    step = dedup(spark, step, TINY).cache()
    single = {r["doc_id"]: r["text"] for r in step.collect()}
    assert single == {i: kept[i] for i, (_, c) in fx.brute_components(list(kept.items())).items() if i == c}

    items = [(r["item_id"], r["text"]) for r in text.table(spark, TINY, "benchmark").collect()]
    step = clean(spark, step, TINY).cache()
    pure = {r["doc_id"]: r["text"] for r in step.collect()}
    assert pure == {i: t for i, t in single.items() if not fx.brute_hits(t, items)[4]}

    mixed = mix(spark, step, TINY).cache()
    assert mixed.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    order = collections.Counter(r["_id"] for r in mixing.mix(step)[1].collect())
    assert times == order and set(times) <= set(pure) and max(times.values()) <= 3

    rows = sorted(tuple(r) for r in encode(spark, mixed, TINY).collect())
    library, place, want = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0, []
    for i in sorted(times.elements()):
        tokens = [*library.encode(pure[i], add_special_tokens=False).ids, 0]
        want.append((i, place, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        place += len(tokens)
    assert rows == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, TINY).collect()) == rows


def test_mix_gives_equal_rows_whole_uses(spark, tmp_path):
    """Equal rows of one id: each is taken a whole number of times, and together as often as the order holds them."""
    words = " ".join(["w"] * 7)
    rows = [(1, words, "a")] * 2 + [(1, words, "b")] + [(k, words + f" {k}", "b") for k in range(2, 9)] + [(9, None, None), (None, "x", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_source_mixing"](spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    order = mixing.mix(docs)[1].collect()
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in order)
