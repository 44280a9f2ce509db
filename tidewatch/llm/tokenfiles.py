"""Token ids in files, and back.

Documents are range-sorted by id, encoded, and written in blocks. A block ranks
its ids by frequency, so that frequent ids become small numbers, and stores the
ranks in a byte-aligned variable-length code: two bits for each number in a run
of control bytes say whether one to four data bytes follow in a run of data
bytes. Decoding looks the lengths and places of four numbers up by their control
byte in NumPy tables. A block carries its own ranking, so files are written in
one pass and any block can be read alone. Blocks stand in a binary column of
Parquet files, which Spark writes and commits.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import lean, small_batches
from tidewatch.operators.ordering import shared_folder

END_ID = 0
BLOCK_IDS = 1_000_000
MAGIC = b"TWID"
CACHE_PIECES, KEPT_PIECES = 400_000, 150_000
PARTITION_BYTES = 64_000_000
#: Bytes of each of four numbers for every control byte, their sums, and their places.
LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4))[None, :] & 3) + 1
TOTALS = LENGTHS.sum(1)


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers; four numbers a control byte, the last one padded with zero bits."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), data[np.arange(4)[None, :] <= code[:, None]].tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` numbers behind control and data bytes, by table lookup."""
    codes, raw = np.frombuffer(control, np.uint8), np.frombuffer(data + b"\0\0\0", np.uint8)
    lengths = LENGTHS[codes].ravel()[:count]
    places = np.cumsum(lengths) - lengths
    out = raw[places].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(lengths > j)
        out[more] |= raw[places[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def encode_block(ids: np.ndarray) -> bytes:
    """Header (magic, ids, distinct ids, control bytes), ids by falling frequency, control bytes, data bytes."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:  # vocabularies are that small; the table below grows with the largest id
        counts = np.bincount(ids, minlength=top)
        order = np.lexsort((np.arange(top), -counts))[: np.count_nonzero(counts)]
        ranked, table = order, np.zeros(top, np.uint32)
        table[order] = np.arange(len(order), dtype=np.uint32)
        ranks = table[ids]
    else:
        distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -counts))
        ranked, table = distinct[order], np.empty(len(order), np.uint32)
        table[order] = np.arange(len(order), dtype=np.uint32)
        ranks = table[inverse]
    control, data = encode_numbers(ranks)
    return MAGIC + struct.pack("<QII", len(ids), len(ranked), len(control)) + ranked.astype("<u4").tobytes() + control + data


def decode_block(block: bytes) -> np.ndarray:
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    count, distinct, controls = struct.unpack_from("<QII", block, 4)
    begin = 20 + 4 * distinct
    ranked = np.frombuffer(block, "<u4", distinct, 20)
    return ranked[decode_numbers(block[begin : begin + controls], block[begin + controls :], count)]


#: A newline or nothing, letters of the Latin scripts with or without a space before them, a full stop or a comma or nothing.
SIMPLE = re.compile(r"(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)")
#: Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b if b in _PRINTED else 256 + sum(1 for x in range(b) if x not in _PRINTED) for b in range(256)}


class Pieces(dict):
    """Ids of pieces as bytes. A new piece is learned when it is looked up; one that `learn` gives nothing for is kept in `odd`."""

    def __init__(self, learn: Callable[[str], bytes | None]):
        super().__init__()
        self.learn, self.odd = learn, []

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if ids is None:
            self.odd.append(piece)
            return b""
        self[piece] = ids
        return ids


class Encoder:
    """The library's ids of whole texts, with the pieces between white space remembered.

    Byte-level splitting never joins characters over a single space or newline
    between two words, so the words of such a text encode one by one, each with
    the character before it. Simple new pieces are learned one by one, the others
    of a text go to the library in one string, parted by NUL, which no merge of the vocabulary contains. Texts with white space
    next to white space or at their ends, other white space than space and
    newline, NUL, or the name of a special token go to the library as a whole.
    """

    def __init__(self, path: str, cached: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.cached = cached
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parted = self._ids("\0")
        merged = [t for t in self.library.get_vocab() if "\u0100" in t and t != "\u0100"]  # how byte-level vocabularies write NUL
        self.pieces = len(self.parted) == 1 and not merged
        self.tokenize = self.library.model.tokenize
        self.code, self.kind = ("H", np.dtype("<u2")) if self.library.get_vocab_size() <= 1 << 16 else ("I", np.dtype("<u4"))
        self.marks = {m: self._ids(m).astype(self.kind).tobytes() for m in ("", "\n", ".", ",")}
        self.known = Pieces(self._simple)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, word: str) -> bytes:
        """Ids of letters with at most a space before them, straight from the model: they are one piece."""
        if word.isascii():
            letters = "\u0120" + word[1:] if word[0] == " " else word
        else:
            letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _simple(self, piece: str) -> bytes | None:
        m = SIMPLE.fullmatch(piece)
        if m is None:
            return None
        before, word, behind = m.groups()
        if before or behind:
            return self.marks[before] + (self.known.get(word) or self._word(word)) + self.marks[behind]
        return self._word(word)

    def _learn(self, pieces: list[str]) -> None:
        ids = self._ids("\0".join(pieces))
        cuts = np.flatnonzero(ids == self.parted[0])
        data, width, begin = ids.astype(self.kind).tobytes(), self.kind.itemsize, 0
        for piece, end in zip(pieces, [*(width * cuts).tolist(), width * len(ids)], strict=True):
            self.known[piece] = data[begin:end]
            begin = end + width

    def forget(self, most: int) -> None:
        """Keep the first `most` pieces: what came first is what comes often."""
        if len(self.known) > most:
            kept = list(islice(self.known.items(), most))
            self.known.clear()
            self.known.update(kept)

    def encode(self, text: str) -> np.ndarray:
        if not self.pieces or "\0" in text or any(s in text for s in self.special):
            return self._ids(text)
        pieces, known = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"), self.known
        if len(known) > self.cached:
            self.forget(self.cached * 3 // 4)
        ids = b"".join(map(known.__getitem__, pieces))
        if known.odd:
            odd, known.odd = list(dict.fromkeys(known.odd)), []
            if any(p.split() != [p[1:] if p[:1] in " \n" else p] for p in odd):  # white space at an end or next to other white space
                return self._ids(text)
            self._learn(odd)
            ids = b"".join(map(known.__getitem__, pieces))
        return np.frombuffer(ids, self.kind).astype("<u4")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process. Workers live on between tasks, and every reading of a vocabulary leaves memory behind."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with `end_id` behind it, in ascending id order.

    Rows of the files: part, block, doc_ids, lengths, ids (see `encode_block`).
    Parts follow the id ranges, blocks follow one another in a part and hold
    whole documents, about `block_ids` ids. A null or empty text has the end id
    only; null ids come first; rows of equal ids stand by a hash of the text.
    `tokenizer` is a file every executor can open.
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    fed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = fed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("size")).first()
    parts = max(1, -(-(shape["size"] or 0) // PARTITION_BYTES))
    order = (F.col("doc_id"), F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([encode_block(ids)], pa.binary())],
                names=["part", "block", "doc_ids", "lengths", "ids"],
            )

        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = coder.encode(text) if text else end[:0]
                held.append(np.concatenate([got, end]))
                names.append(doc_id)
                size += len(held[-1])
                if size >= block_ids:
                    yield block()
                    held, names, size, number = [], [], 0, number + 1
        if held:
            yield block()
        coder.forget(KEPT_PIECES)  # workers live on: most of what one task has learned must not stay in their memory

    ranged = fed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(lean(blocks), "part int, block int, doc_ids array<long>, lengths array<long>, ids binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the checksum
    of its decoded ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, names, lengths, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                decoded = decode_block(ids).astype("<u4")
                ends = np.cumsum(lengths)
                if len(ends) and ends[-1] != len(decoded):
                    raise ValueError(f"part {part}, block {number}: {len(decoded)} ids, {ends[-1]} expected")
                view = memoryview(decoded).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array([number] * len(names), pa.int32()), pa.array(ends - np.array(lengths), pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("part", "block", "doc_ids", "lengths", "ids").mapInArrow(lean(documents), "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("held"))
    parts = sizes.groupBy("part").agg(F.sum("held").alias("held"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part of 64 MB in the first window, the blocks of a part in the second
    part_starts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(earlier.partitionBy(F.lit(0)).orderBy("part")), F.lit(0)).alias("part_start"))
    block_starts = sizes.join(part_starts, F.col("part") == F.col("p")).select(
        F.col("part").alias("b_part"), F.col("block").alias("b_block"), (F.col("part_start") + F.coalesce(F.sum("held").over(earlier.partitionBy("part").orderBy("block")), F.lit(0))).alias("block_start")
    )
    return decoded.join(block_starts, (F.col("part") == F.col("b_part")) & (F.col("block") == F.col("b_block"))).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_rows(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of `docs` to a new folder among the shared ones and read the documents back."""
    path = f"{shared_folder(docs.sparkSession)}/tokens"
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
