"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of training text.
A text is encoded with each of them; the language whose dictionary gives the
smallest result wins. Where the runner-up is nearly as small, the margin is
narrow and the prediction is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import small_batches

DICT_BYTES = 112_000
TEXT_BYTES = 2_000
LEVEL = 5
NARROW = 0.01
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
PIECE_BYTES = 1_000


#: Bytes of ASCII characters other than letters become spaces, so that only words are compared.
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(SPACED)


def pieces(text: bytes, most: int = PIECE_BYTES) -> list[bytes]:
    """The whole text in equal pieces of about `most` bytes: a dictionary helps each of them alike, however long the text is."""
    n = max(1, round(len(text) / most))
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def language_dictionaries(docs: DataFrame, dict_bytes: int = DICT_BYTES, text_bytes: int = TEXT_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Training text of each language, the most frequent first: at most `dict_bytes` of it, in the order of a hash of the id.

    The sample is bounded by two parameters: pieces of at most `text_bytes`
    characters from as many documents as fill `dict_bytes` twice over. Rows
    without text, letters or language teach nothing.
    """
    piece = F.substring(F.col(text_col), 1, text_bytes)
    wanted = 2 * dict_bytes // 400
    order = F.xxhash64(F.col(id_col).cast("string"))
    rows = (
        docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .groupBy(F.col(lang_col).alias("lang"), F.pmod(order, F.lit(wanted)).alias("draw"))
        .agg(F.min_by(piece, F.struct(order, F.xxhash64(text_col))).alias("piece"), F.count(F.lit(1)).alias("n"))
        .orderBy("lang", "draw")
        .collect()
    )
    seen: dict[str, int] = {}
    out: dict[str, bytes] = {}
    for r in rows:
        seen[r["lang"]] = seen.get(r["lang"], 0) + r["n"]
        if len(out.get(r["lang"], b"")) < dict_bytes:
            out[r["lang"]] = (out.get(r["lang"], b"") + b" " + letters(r["piece"]))[:dict_bytes]
    return {lang: out[lang] for lang in sorted(out, key=lambda x: (-seen[x], x))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, narrow: float = NARROW, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred, score (0 to 1), margin and rejected added; see `predict_language`."""
    small_batches(docs.sparkSession)
    langs = list(dictionaries)
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    fed = docs.withColumn("_letters", F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)))
    kept = docs.columns
    schema = docs.schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang in langs:
            words = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            pred, score, margin, rejected = [], [], [], []
            for value in batch.column(batch.schema.get_field_index("_letters")):
                text = None if value.as_py() is None else letters(value.as_py())
                if text is None or not coders:
                    got = (UNKNOWN, 0.0, 0.0, True)
                else:
                    parts = pieces(text)
                    sizes = np.array([sum(len(c.compress(part)) for part in parts) for c in coders], float)
                    best = int(sizes.argmin())
                    gap = float((np.delete(sizes, best).min() - sizes[best]) / max(len(text), 1)) if len(sizes) > 1 else 1.0
                    weight = np.exp((sizes.min() - sizes) * 8 / max(16.0, sizes.min()))
                    got = (langs[best], float(weight[best] / weight.sum()), gap, gap < narrow)
                for column, v in zip((pred, score, margin, rejected), got, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return fed.mapInArrow(predict, schema)


def predict_language(docs: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, dict_bytes: int = DICT_BYTES, level: int = LEVEL, narrow: float = NARROW) -> DataFrame:
    """Every row of `docs` (doc_id, text, lang, ...) with held_out, lang_pred, score, margin and rejected added.

    Learns from the rows outside the held-out fold only and looks at nothing but
    the text in a prediction. lang_pred is the language whose dictionary encodes
    the pieces of the whole text smallest (ties: the one with most training rows); `und` with score 0 for a
    text that is null or has no letter, or if nothing could be learned. margin
    is how many bytes a byte of text the runner-up needs more; below `narrow`
    the row is marked rejected, its prediction stays. Repeated rows are handled
    alike, a null id is in no held-out fold, added columns replace input columns
    of the same names.
    """
    docs = docs.drop("held_out").withColumn("held_out", held_out(folds=folds, fold=fold))
    return identify(docs, language_dictionaries(docs.filter(~F.col("held_out")), dict_bytes), level, narrow)
