"""Alignment of the tokens of two tokenizers over the same bytes.

Token boundaries that both tokenizers share cut a text into groups. They are
found by pointer jumping: every token points to the farthest-right token that
overlaps it, of the other tokenizer (the last token of a group points to
itself). Following all pointers at once, each becomes the pointer of its
pointer, until every token of a group points to the group's last token, whose
number labels the group.

Tokens of one group are linked. How many documents hold a pair of ids linked is
counted over all documents; a document's links are then judged by those counts.
Documents stand in blocks, and a block sends and gets each of its pairs once, so
what is exchanged grows with blocks times their different pairs, not with links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import small_batches
from tidewatch.llm.tokenfiles import BYTE_LETTERS, Encoder, decode_numbers, default_tokenizer, encode_numbers
from tidewatch.operators.ordering import cut_lineage

BLOCK_BYTES = 8_000_000
CHUNK_BYTES = 400_000
WINDOW_CHARS = 200_000
LINKS_AT_ONCE = 1_000_000
LARGE_GROUP = 65_536
CACHED_PIECES = 100_000
#: Both tokenizers always part a text here: no token of either holds a space behind another character.
BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def windows(text: str, most: int = WINDOW_CHARS) -> list[str]:
    """A text in parts of about `most` characters, cut at single spaces between words, which are left out.

    Both tokenizers read each part with a space before it, so their tokens are
    those of the whole. A stretch without such a space stays in one part.
    """
    out, begin = [], 0
    while len(text) - begin > 2 * most:
        cut = BETWEEN_WORDS.search(text, begin + most)
        if cut is None:
            break
        out.append(text[begin : cut.start()])
        begin = cut.end()
    return [*out, text[begin:]]


class TwoTokenizers:
    """Token ids of `space + text` in both vocabularies, with the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = Encoder(byte_level, CACHED_PIECES)
        self.a.library.encode_special_tokens = True  # their strings are plain text
        self.a.special = []
        self.a.known[""] = b""  # what stands before the space in front
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
        vocabulary = self.a.library.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters.get(ch, 63) for ch in token)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes_b.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, empty where a tokenizer does not give back the bytes of `space + text`."""
        none = np.zeros(0, np.int64)
        held_a, held_b = [], []
        for part in windows(text) if text else []:
            whole = b" " + part.encode()
            a = self.a.encode(" " + part).astype(np.int64)
            b = np.array(self.b.encode(part), np.int64)
            if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
                return none, none
            held_a.append(a)
            held_b.append(b)
        return (np.concatenate(held_a), np.concatenate(held_b)) if held_a else (none, none)


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides, numbered from the left; `ends` are rising byte offsets with the same last one."""
    na, nb = len(ends_a), len(ends_b)
    if not na:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own_b = na + np.arange(nb)
    over = np.searchsorted(ends_a, ends_b, "left")
    follow = np.r_[na + np.searchsorted(ends_b, ends_a, "left"), np.where(ends_a[over] > ends_b, over, own_b)]
    while True:
        further = follow[follow]
        if (further == follow).all():
            break
        follow = further
    number = np.cumsum(follow[na:] == own_b) - 1
    label = number[follow - na]
    return label[:na], label[na:]


@dataclass
class Aligned:
    """Tokens of several documents in a row, with their groups; documents without tokens have none."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    group_doc: np.ndarray

    @classmethod
    def of(cls, encoded: Sequence[tuple[np.ndarray, np.ndarray]], length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([none, *(e[k] for e in encoded)]) for k in (0, 1))
        n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        # Both sides of a document have the same bytes, so running sums agree at its end and no group crosses it.
        group_a, group_b = group_labels(np.cumsum(length_a[a]), np.cumsum(length_b[b]))
        groups = int(group_b[-1]) + 1 if len(group_b) else 0
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        last_b = np.cumsum(size_b) - 1
        return cls(a, b, n_a, n_b, group_a, group_b, size_a, size_b, np.repeat(np.arange(len(encoded)), n_b)[last_b] if groups else none)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of groups."""
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, self.group_doc, values)
        return out

    def links(self, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links): every different pair a * ids_b + b of each document, in order, and how often it is linked."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        space = int(ids_b) * (int(self.a.max()) + 1) if len(self.a) else 1
        per_group = self.size_a * self.size_b
        first_b = np.cumsum(self.size_b) - self.size_b
        usual = np.flatnonzero((per_group <= LARGE_GROUP)[self.group_a]) if len(self.a) else self.a
        width = self.size_b[self.group_a[usual]]
        cut = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()), LINKS_AT_ONCE), "left")
        for part in np.split(np.arange(len(usual)), cut[1:]):
            if len(part):
                token, reps = usual[part], width[part]
                group = np.repeat(self.group_a[token], reps)
                inside = np.arange(len(group)) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append(_counted(self.group_doc[group] * space + np.repeat(self.a[token], reps) * ids_b + self.b[first_b[group] + inside]))
        # A large group is first reduced to its different ids and how often each occurs.
        first_a = np.cumsum(self.size_a) - self.size_a
        for g in np.flatnonzero(per_group > LARGE_GROUP):
            ids_of_a, many_a = np.unique(self.a[first_a[g] : first_a[g] + self.size_a[g]], return_counts=True)
            ids_of_b, many_b = np.unique(self.b[first_b[g] : first_b[g] + self.size_b[g]], return_counts=True)
            rows = max(1, LINKS_AT_ONCE // len(ids_of_b))
            for k in range(0, len(ids_of_a), rows):
                pairs = self.group_doc[g] * space + ids_of_a[k : k + rows, None] * ids_b + ids_of_b[None, :]
                found.append(_counted(pairs.ravel(), (many_a[k : k + rows, None] * many_b[None, :]).ravel()))
        if len(found) > 1:
            found = [_counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
        key, times = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return key // space, key % space, times

    def spelled(self, digits: np.ndarray, width: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        n = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + (np.cumsum(self.size_b) - self.size_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends_a, ends_b = place_a[np.cumsum(self.size_a) - 1], place_b[np.cumsum(self.size_b) - 1]
        mark[ends_a], mark[ends_b] = ord("|"), ord(";")
        size = width[ids]
        shown = digits[ids]
        shown[np.arange(n), size] = mark
        flat = shown[np.arange(digits.shape[1])[None, :] <= size[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(size + 1)][np.cumsum(self.n_a + self.n_b)].tolist()
        begins = [0, *ends[:-1]]
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(begins, ends, strict=True)]


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of their weights (1 each)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(weights[order], new)


def decimals(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of every id, with room for one mark behind, and how many there are."""
    text = [str(i).encode() for i in range(ids)]
    most = len(text[-1]) + 1 if text else 1
    return np.frombuffer(b"".join(t.ljust(most, b"\0") for t in text), np.uint8).reshape(-1, most), np.array([len(t) for t in text], np.int64)


BLOCK_SCHEMA = "block string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<long>, pairs binary, documents binary, steps binary, step_sizes binary, times binary, time_sizes binary"


def aligned_blocks(docs: DataFrame, byte_level: str, pieces: str, spell: bool, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each block of documents, about `block_bytes` of text: their counts, their groups (or a digest of them), and their linked pairs.

    pairs holds the different pairs of the block in order, documents how many
    documents have each; steps and times list each document's pairs as rising
    numbers in `pairs` and how often it links them.
    """
    fed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers(byte_level, pieces)
        digits, width = decimals(max(len(both.bytes_a), len(both.bytes_b)))
        ids_b, part, number = len(both.bytes_b), TaskContext.get().partitionId(), 0
        held = _Block(ids_b)
        waiting: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if waiting:
                done = Aligned.of([e for _, e in waiting], both.length_a, both.length_b)
                texts = done.spelled(digits, width) if len(done.a) else [b""] * len(waiting)
                shown = [t.decode() if spell else hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                held.add([i for i, _ in waiting], done, shown)
                held.size += size
                waiting.clear()
            size = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append((doc_id, both.encode(text or "")))
                size += len(text or "") + 1
                if size >= CHUNK_BYTES:
                    settle()
                if held.size >= block_bytes:
                    yield held.row(f"{part}-{number}")
                    held, number = _Block(ids_b), number + 1
        settle()
        if held.doc_ids:
            yield held.row(f"{part}-{number}")
        both.a.known.clear()  # workers live on

    return fed.mapInArrow(blocks, BLOCK_SCHEMA)


class _Block:
    def __init__(self, ids_b: int):
        self.ids_b, self.size = ids_b, 0
        self.doc_ids: list[int] = []
        self.shown: list[str] = []
        self.counts: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_ids: list[int], done: Aligned, shown: list[str]) -> None:
        document, pair, times = done.links(self.ids_b)
        self.doc_ids += doc_ids
        self.shown += shown
        groups = done.per_document(np.ones(len(done.size_a), np.int64))
        self.counts.append(np.stack([done.n_a, done.n_b, groups, done.per_document(done.size_a * done.size_b), np.bincount(document, minlength=len(doc_ids))]))
        self.pairs.append(pair)
        self.times.append(times)

    def row(self, name: str) -> pa.RecordBatch:
        n_a, n_b, groups, links, n_pairs = np.concatenate(self.counts, 1)
        pair, times = np.concatenate(self.pairs), np.concatenate(self.times)
        pairs, at = np.unique(pair, return_inverse=True)
        begins = np.cumsum(n_pairs) - n_pairs
        steps = np.diff(at, prepend=0)
        some = begins[n_pairs > 0]
        steps[some] = at[some]
        step_sizes, step_data = encode_numbers(steps)
        time_sizes, time_data = encode_numbers(times)
        longs = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                pa.array([self.doc_ids], pa.list_(pa.int64())),
                *map(longs, (n_a, n_b, groups, links)),
                pa.array([self.shown], pa.list_(pa.string())),
                longs(n_pairs),
                *[pa.array([x], pa.binary()) for x in (pairs.astype("<i8").tobytes(), np.bincount(at, minlength=len(pairs)).astype("<i8").tobytes(), step_data, step_sizes, time_data, time_sizes)],
            ],
            names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")],
        )


def pairs_in_blocks(blocks: DataFrame) -> DataFrame:
    """(block, pair, documents): every block's pairs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, pairs, documents in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "documents")), strict=True):
                p, d = np.frombuffer(pairs, "<i8"), np.frombuffer(documents, "<i8")
                for k in range(0, len(p), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(p[k : k + 50_000]), pa.string()), pa.array(p[k : k + 50_000]), pa.array(d[k : k + 50_000])], names=["block", "pair", "documents"])

    return blocks.select("block", "pairs", "documents").mapInArrow(spread, "block string, pair long, documents long")


def pair_counts(blocks: DataFrame, ids_b: int) -> DataFrame:
    """(pair, a, b, documents, best): in how many documents each pair is linked, and whether no other pair of its `a` has more.

    An id has at most as many partners as the other vocabulary has ids.
    """
    totals = pairs_in_blocks(blocks).groupBy("pair").agg(F.sum("documents").alias("documents"))
    a = F.expr(f"pair div {int(ids_b)}").cast("int")
    named = totals.withColumn("a", a).withColumn("b", (F.col("pair") - F.col("a").cast("long") * int(ids_b)).cast("int"))
    return named.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, spell: bool = False, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): every row of `docs` with its token groups and links, and all linked pairs with their counts.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the most common of its `a`), count_sum (documents that hold the pair, summed
    over links) and groups: `a1,a2|b1;a3|b2,b3`, or its SHA-256 unless `spell`.
    pairs: see `pair_counts`. A text that is null, empty, or not given back byte
    by byte by both tokenizers has zeros and an empty string. Rows stand alone:
    each repeated row counts as a document. Other columns are ignored. Both files
    must be readable on every executor.
    """
    small_batches(docs.sparkSession)
    byte_level, pieces = byte_level or default_tokenizer(), pieces or default_pieces()
    blocks = cut_lineage(aligned_blocks(docs, byte_level, pieces, spell, block_bytes, id_col, text_col))
    ids_b = len(TwoTokenizers(byte_level, pieces).bytes_b)
    counts = cut_lineage(pair_counts(blocks, ids_b))
    known = pairs_in_blocks(blocks).select("block", F.col("pair").alias("_pair")).join(counts.select("pair", "documents", "best"), F.col("_pair") == F.col("pair"))
    # as many rows as a block has different pairs
    of_block = known.groupBy("block").agg(F.collect_list(F.struct("pair", "documents", "best")).alias("_known"))
    fed = blocks.drop("pairs", "documents").join(of_block, "block", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i] for name in b.schema.names}
                known = row["_known"].values.flatten() if row["_known"].is_valid else None
                pair, documents, best = (np.asarray(x) for x in known) if known is not None else (np.zeros(0, np.int64),) * 3
                order = np.argsort(pair)
                documents, best = documents[order], best[order].astype(np.int64)
                n_pairs = np.asarray(row["n_pairs"].values)
                total = int(n_pairs.sum())
                steps = decode_numbers(row["step_sizes"].as_py(), row["steps"].as_py(), total).astype(np.int64)
                times = decode_numbers(row["time_sizes"].as_py(), row["times"].as_py(), total).astype(np.int64)
                begins = np.cumsum(n_pairs) - n_pairs
                # running sums begin anew with each document
                at = np.cumsum(steps)
                before = np.r_[0, at][begins]
                at = at - np.repeat(before, n_pairs)
                sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[begins, total]])
                columns = [row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums(times * best[at])), pa.array(sums(times * documents[at])), row["groups"].values], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = fed.mapInArrow(judge, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out, counts.select("a", "b", "documents", "best")
