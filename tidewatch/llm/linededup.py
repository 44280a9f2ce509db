"""Lines that repeat across documents: every copy but the first goes.

Lines are exploded and hashed; distinct documents are counted per hash; lines
over the threshold are dropped; the rest are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import lower_az, row_id

EDGES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII space at both ends and with A-Z lowered."""
    return lower_az(F.btrim(line, F.lit(EDGES)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with `n_lines`, `n_dropped` and `kept_text` added.

    A line is dropped if its key has at least `min_chars` code points, is found
    in at least `min_docs` distinct ids, and this row's id is not the smallest
    of them. Keys are compared by two 64-bit hashes. A null or empty text is one
    empty line. Repeated rows are each handled alike; rows that share an id
    count as one document. A null id ranks behind every other and is one
    document. Added columns replace input columns of the same names. An empty
    table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text").withColumn("_row", row_id(id_col, text_col))
    keyed = F.transform(lines_of(F.col(text_col)), lambda line, at: F.struct(at.alias("at"), line_key(line).alias("key")))
    long_keys = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(long_keys, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("second"), x["key"]).alias("h2")))
    lines = docs.select(F.col(id_col).alias("_id"), "_row", F.explode(hashed).alias("x")).select("_id", "_row", "x.*")
    repeated = (
        lines.select("h1", "h2", "_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("in_docs"), F.min("_id").alias("keeper"))
        .filter(F.col("in_docs") >= min_docs)
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "keeper")
    )
    gone = (
        lines.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
        .filter(~F.col("_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"))
        .agg(F.collect_set("at").alias("_gone"))
    )
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left")
    lines_now = lines_of(F.col(text_col))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_now) - 1), F.col("_gone")), lambda at: F.get(F.col("_lines"), at))
    return (
        joined.withColumn("_lines", lines_now)
        .withColumn("kept_text", F.when(F.col("_gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .drop("_row", "_gone_id", "_gone_row", "_gone", "_lines")
    )
