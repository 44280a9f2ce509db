"""Benchmark passages inside documents, found by winnowing.

Both sides are cut into k-grams of words. Of every run of `window - k + 1`
neighbouring k-grams the smallest hash is kept as a fingerprint, so any shared
span of `window` words shares at least one. Fingerprints are joined, and every
hit is extended word by word to both sides: only spans of a whole item window
count, so nothing is reported by hash alone. Items shorter than a window are
windows of their own and are looked up as a whole by their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import NOT_ALNUM, lower_az, row_id, split_words
from tidewatch.operators.ordering import cut_lineage

WINDOW, GRAM = 10, 5


def _words(text_col: str) -> Column:
    return split_words(lower_az(F.col(text_col)), NOT_ALNUM)


def _per_position(count: Column, value: Callable[[Column], Column], kind: str) -> Column:
    """`value(i)` for i in 0 .. count-1; an empty array if there is none."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), value)).otherwise(F.array().cast(kind))


def _gram_hashes(words: Column, size: int) -> Column:
    return _per_position(F.size(words) - size + 1, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]), "array<bigint>")


def _winnowed(hashes: Column, run: int) -> Column:
    return F.array_distinct(_per_position(F.size(hashes) - run + 1, lambda i: F.least(*[F.get(hashes, i + j) for j in range(run)]) if run > 1 else F.get(hashes, i), "array<bigint>"))


def _context(words: Column, at: Column, reach: int) -> Column:
    """The words `reach` before a position up to `reach` behind its gram; null outside the text."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(GRAM + reach - 1)), lambda j: F.when(at + j >= 0, F.get(words, at + j)))


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(`rows`, `spans`).

    `rows`: (_id, _row, n_words), one for each row of `docs`. `spans`: distinct
    (_id, _row, begin, end, _item): words begin .. end-1 lie in occurrences of
    windows of the item. `window` must exceed the gram size of 5.
    """
    if window <= GRAM:
        raise ValueError(f"window must exceed {GRAM}")
    run, reach = window - GRAM + 1, window - GRAM
    bare = docs.select(F.col(id_col).alias("_id"), row_id(id_col, text_col).alias("_row"), _words(text_col).alias("words"))
    marked = cut_lineage(
        bare.withColumn("hashes", _gram_hashes(F.col("words"), GRAM)).select("_id", "_row", F.size("words").cast("long").alias("n_words"), _winnowed(F.col("hashes"), run).alias("prints"))
    )
    tests = cut_lineage(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), _words("text").alias("words")).filter(F.size("words") > 0))
    long_items = tests.filter(F.size("words") >= window).withColumn("hashes", _gram_hashes(F.col("words"), GRAM)).withColumn("prints", _winnowed(F.col("hashes"), run))
    item_grams = cut_lineage(
        long_items.select("_item", "prints", F.posexplode("hashes").alias("item_at", "print")).filter(F.array_contains("prints", F.col("print"))).select("_item", "item_at", "print")
    )
    held = marked.select("_id", "_row", F.explode("prints").alias("print"))
    suspects = held.join(item_grams.select("print").distinct(), "print", "left_semi").select(F.col("_id").alias("s_id"), F.col("_row").alias("s_row")).distinct()
    this_row = lambda a, b: F.col("_id").eqNullSafe(F.col(a)) & (F.col("_row") == F.col(b))
    raw = docs.select(F.col(id_col).alias("_id"), row_id(id_col, text_col).alias("_row"), F.col(text_col).alias("text"))
    # A suspect's words are cut after the join: texts travel, not arrays of words.
    texts = cut_lineage(raw.join(suspects, this_row("s_id", "s_row"), "left_semi").select("_id", "_row", _words("text").alias("words")))
    grams = texts.withColumn("hashes", _gram_hashes(F.col("words"), GRAM)).select("_id", "_row", F.posexplode("hashes").alias("at", "print"))
    matches = (
        grams.join(item_grams, "print")
        .groupBy(F.col("_id").alias("m_id"), F.col("_row").alias("m_row"))
        .agg(F.collect_set(F.struct("at", "_item", "item_at")).alias("matches"))
    )
    near = F.transform("matches", lambda m: F.struct(m["at"].alias("at"), m["_item"].alias("_item"), m["item_at"].alias("item_at"), _context(F.col("words"), m["at"], reach).alias("near")))
    item_words = tests.select(F.col("_item").alias("w_item"), F.col("words").alias("item_words"))
    first_no = lambda a: F.coalesce(F.nullif(F.array_position(a, False), F.lit(0)) - 1, F.size(a))
    spans = (
        texts.dropDuplicates(["_id", "_row"])
        .join(matches, this_row("m_id", "m_row"))
        .select("_id", "_row", F.explode(near).alias("m"))
        .select("_id", "_row", "m.*")
        .join(item_words, F.col("_item").eqNullSafe(F.col("w_item")))
        .withColumn("same", F.zip_with("near", _context(F.col("item_words"), F.col("item_at"), reach), lambda x, y: F.coalesce(x == y, F.lit(False))))
        .withColumn("left", first_no(F.reverse(F.slice("same", 1, reach))))
        .withColumn("right", first_no(F.slice("same", reach + 1, window)))
        .filter((F.col("right") >= GRAM) & (F.col("left") + F.col("right") >= window))
        .select("_id", "_row", (F.col("at") - F.col("left")).cast("int").alias("begin"), (F.col("at") + F.col("right")).cast("int").alias("end"), "_item")
        .distinct()
    )
    lengths = [r[0] for r in tests.filter(F.size("words") < window).select(F.size("words")).distinct().collect()]
    for n in sorted(lengths):  # at most window - 1 of them
        short = tests.filter(F.size("words") == n).select("_item", F.xxhash64(*[F.get("words", F.lit(j)) for j in range(n)]).alias("print"), F.col("words").alias("item_words"))
        found = (
            bare.select("_id", "_row", "words", F.posexplode(_gram_hashes(F.col("words"), n)).alias("at", "print"))
            .select("_id", "_row", "at", "print", F.slice("words", F.col("at") + 1, n).alias("near"))
            .join(short, "print")
            .filter(F.col("near") == F.col("item_words"))
            .select("_id", "_row", F.col("at").alias("begin"), (F.col("at") + n).alias("end"), "_item")
        )
        spans = spans.union(found).distinct()
    return marked.select("_id", "_row", "n_words"), spans


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each row of `docs`: id, `_row`, n_words, n_hit, n_items, items (sorted, comma-joined), contaminated.

    A window is `window` consecutive words of an item; an item with fewer words,
    but not none, is one window. A document word inside any occurrence of a
    window is hit. A null or empty text has no words; a null or empty item hits
    nothing; with no items nothing is hit. Repeated rows get equal results.
    Item ids are compared and sorted as strings; a null item id is the empty
    string. Other columns of either table are not used.
    """
    rows, spans = contaminated_spans(docs, items, window, id_col, text_col, item_col)
    spans = cut_lineage(spans)
    words = spans.select("_id", "_row", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at")).distinct().groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = spans.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    hits = words.join(found, words["_id"].eqNullSafe(found["_id"]) & (words["_row"] == found["_row"])).select(
        words["_id"].alias("h_id"), words["_row"].alias("h_row"), "n_hit", F.size("_items").cast("long").alias("n_items"), F.array_join("_items", ",").alias("items")
    )
    return rows.join(hits, F.col("_id").eqNullSafe(F.col("h_id")) & (F.col("_row") == F.col("h_row")), "left").select(
        F.col("_id").alias(id_col),
        "_row",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a hit, unchanged."""
    bad = decontaminate(docs, items, window).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("_row").alias("bad_row")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (row_id("doc_id", "text") == F.col("bad_row")), "left_anti")
