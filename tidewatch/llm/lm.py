"""Language-model scores from a weighted backoff automaton.

Word n-grams up to `order` of the training documents are counted over the whole
corpus and smoothed: an n-gram found at least `min_count` times becomes an arc
from the state of the words before its last, with the interpolated probability
of absolute discounting; the mass left over is the weight of the state's failure
arc to the state of one word less, and in the end to the root, whose arcs are the
words themselves. The state at a token is given by the words before it, so all
tokens of a block are walked at once, order by order.

The automaton of a large corpus fits in no task. Documents are dealt to blocks of
about a million words; each block sends its distinct n-grams with their counts to
tasks that own them by a hash of all their words, so that no frequent word
gathers its followers in one place. An owner has a range of hashes, which leave a
block in order and so need little more than the bits of their distances. It
answers which n-grams stand in other blocks too, the counts of those, and which
one block shall add each of them to its state: what the arcs of a state sum to is
then added up over the blocks that share the state. Each order is a pass of its
own whose exchange is given back before the next, and blocks get exactly the
counts and states that their own texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import chunks, flat_words, mix, small_batches
from tidewatch.operators.ordering import cut_lineage_and_release

FOLDS, HELD_OUT = 7, 2
DISCOUNT, MIN_COUNT = 0.75, 2
BLOCK_BYTES, OWNER_BYTES = 6_000_000, 24_000_000
END = np.uint64(0x8000000000000001)  # the end token: not the hash of any word but by chance


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """A null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in a row, an end token behind each, and tokens per text."""
    hashes, counts = [], []
    for _, held in chunks(texts):
        words, per_text, *_ = flat_words(held)
        ends = np.cumsum(per_text)
        hashes.append(np.insert(words, ends, END))
        counts.append(per_text + 1)
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, larger ones apart in order."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()


def unsmall(low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, "<i8")
    return out


def follower_code(hashes: np.ndarray) -> np.ndarray:
    """32 bits of a word's hash: enough to tell the followers of one state apart."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def gram_key(states: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, from those of all words but the last and the last word's code."""
    return mix(mix(states ^ np.uint64(0x9E3779B97F4A7C15)) + followers.astype(np.uint64))


class Grams:
    """Distinct n-grams of a block; each list has words first, then pairs and so on, sorted by key.

    code: the n-gram that ends at each token, -1 where the text has begun too
    late. state and suffix: the n-gram of one word less without the last or the
    first word.
    """

    def __init__(self, hashes: np.ndarray, per_text: np.ndarray, training: np.ndarray, order: int):
        self.per_text = per_text
        teaches = np.repeat(training, per_text)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        words, code = np.unique(hashes, return_inverse=True)
        self.keys, self.code, self.counts = [words], [code], [np.bincount(code, teaches, len(words)).astype(np.int64)]
        self.state, self.suffix = [None], [None]
        for n in range(1, order):
            at = np.flatnonzero(place >= n)
            before, last = self.code[-1], follower_code(hashes[at])
            keys, first, which = np.unique(gram_key(self.keys[-1][before[at - 1]], last), return_index=True, return_inverse=True)
            code = np.full(len(hashes), -1, np.int64)
            code[at] = which
            self.keys.append(keys)
            self.code.append(code)
            self.counts.append(np.bincount(which, teaches[at], len(keys)).astype(np.int64))
            self.state.append(before[at[first] - 1])
            self.suffix.append(before[at[first]])

    def owned(self, owners: int) -> list[np.ndarray]:
        """For each order where the n-grams of each owner begin, and the end."""
        begins = np.array([first_key(o, owners) for o in range(owners)], np.uint64)
        return [np.append(np.searchsorted(k, begins), len(k)) for k in self.keys]


def first_key(owner: int, owners: int) -> int:
    """Owners have ranges of keys, in order."""
    return -(-(owner << 64) // owners)


def low_bits(n: int, limit: int) -> int:
    """How many low bits of `n` ascending integers below `limit` are kept as they are, a multiple of 4."""
    return min(range(0, 64, 4), key=lambda low: low + (limit // n >> low))


def squeeze(ascending: np.ndarray, limit: int) -> bytes:
    """Ascending integers below `limit`: low bits, whole bytes before a half one; the rest counted up, a bit for each integer and each step."""
    n = len(ascending)
    if not n:
        return b""
    low = low_bits(n, limit)
    raw = np.ascontiguousarray(ascending, "<u8").view(np.uint8).reshape(n, 8)
    half = np.zeros((n + 1) // 2 * 2 if low % 8 else 0, np.uint8)
    if low % 8:
        half[:n] = raw[:, low // 8] & 15
    high = (ascending.astype(np.uint64) >> np.uint64(low)).astype(np.int64) + np.arange(n)
    steps = np.zeros(high[-1] + 1, np.uint8)
    steps[high] = 1
    return raw[:, : low // 8].tobytes() + (half[::2] | half[1::2] << 4).tobytes() + np.packbits(steps).tobytes()


def unsqueeze(held: bytes, n: int, limit: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    low = low_bits(n, limit)
    raw, whole, halves = np.zeros((n, 8), np.uint8), n * (low // 8), (n + 1) // 2 if low % 8 else 0
    raw[:, : low // 8] = np.frombuffer(held, np.uint8, whole).reshape(n, low // 8)
    if halves:
        half = np.frombuffer(held, np.uint8, halves, whole)
        raw[::2, low // 8], raw[1::2, low // 8] = half & 15, half[: n // 2] >> 4
    high = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8, offset=whole + halves)))[:n] - np.arange(n)
    return raw.view("<u8").ravel() | high.astype(np.uint64) << np.uint64(low)


ASKED = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("n_longer", pa.int64()), *[(c, pa.binary()) for c in ("followers", "counts", "counts_high")]])
ASKED_TYPE = "owner int, block long, n_words long, words binary, n_longer long, followers binary, counts binary, counts_high binary"
#: What is told. TOTALS: of all words of an owner; HELD: by an owner to itself, which of its shared states a block has; COUNTS: to a block,
#: which of its n-grams are shared and their counts; SUMS: by a block to owners, what its arcs add to shared states; LEFT: to a block, all sums of those.
TOTALS, HELD, COUNTS, SUMS, LEFT, TEXT = range(6)
TOLD = ["n", "keys", "low", "high", "mass_low", "mass_high"]
TOLD_SCHEMA = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("role", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in TOLD[1:]], ("size", pa.int64()), ("total", pa.int64())])
TOLD_TYPE = "owner int, block long, role int, n int, keys binary, low binary, high binary, mass_low binary, mass_high binary, size long, total long"


def _told(owner: int, block: int, role: int, n: int = 0, keys: bytes = b"", kinds: tuple = (b"", b""), mass: tuple = (b"", b""), size: int = 0, total: int = 0) -> pa.RecordBatch:
    row = (owner, block, role, n, keys, *kinds, *mass, size, total)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TOLD_SCHEMA.types, strict=True)], schema=TOLD_SCHEMA)


def _ask(block: int, g: Grams, owners: int, orders: tuple[int, ...] = (0, 1)) -> pa.RecordBatch:
    """A message to each owner: its words (order 0), its n-grams of one longer order, and the counts of all."""
    owned, limit = g.owned(owners), (1 << 64) // owners
    rows = []
    for o in range(owners):
        mine = [slice(owned[n][o], owned[n][o + 1]) if n in orders else slice(0, 0) for n in (0, orders[-1])]
        if orders[-1] == 0:
            mine[1] = slice(0, 0)
        keys = [g.keys[n][m] - np.uint64(first_key(o, owners)) for n, m in zip((0, orders[-1]), mine, strict=True)]
        if any(map(len, keys)):
            counts = np.concatenate([g.counts[n][m] for n, m in zip((0, orders[-1]), mine, strict=True)])
            rows.append((o, block, *[x for k in keys for x in (len(k), squeeze(k, limit))], *small(counts)))
    columns = zip(*rows, strict=True) if rows else [[]] * len(ASKED)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ASKED.types, strict=True)], schema=ASKED)


def _sum(owner: int, messages: list[dict], owners: int, longer: int, order: int) -> Iterator[pa.RecordBatch]:
    """Sum what all blocks counted, and tell each block what it shares with others. `longer`: the order of the n-grams beside words."""
    limit = (1 << 64) // owners
    counted = [unsmall(m["counts"], m["counts_high"]) for m in messages]
    for n, name, size in ((0, "words", "n_words"), (longer, "followers", "n_longer")):
        sizes = [m[size] for m in messages]
        if not sum(sizes):
            continue
        every, first, which = np.unique(np.concatenate([unsqueeze(m[name], k, limit) for m, k in zip(messages, sizes, strict=True)]), return_index=True, return_inverse=True)
        mine = [c[:k] if name == "words" else c[len(c) - k :] for c, k in zip(counted, sizes, strict=True)]
        counts = np.bincount(which, np.concatenate(mine), len(every)).astype(np.int64)
        shared = np.bincount(which, minlength=len(every)) > 1
        index, adds = np.cumsum(shared) - 1, np.zeros(len(which), bool)
        adds[first] = True
        if name == "words":
            yield _told(owner, -1, TOTALS, size=int(counts.sum()), total=int((counts > 0).sum()))
        a = 0
        for m, k in zip(messages, sizes, strict=True):
            own, add = which[a : a + k], adds[a : a + k]
            a += k
            both = shared[own]
            yield _told(owner, m["block"], COUNTS, n, np.packbits(both).tobytes() + np.packbits(add[both]).tobytes(), small(counts[own[both]]))
            if n + 1 < order:
                yield _told(owner, m["block"], HELD, n, squeeze(index[own[both]], int(shared.sum())), size=int(both.sum()), total=int(shared.sum()))


def _left(owner: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Tell each block number and counts of the arcs of the states it shares."""
    for n in sorted({r["n"] for r in rows}):
        held = {r["block"]: unsqueeze(r["keys"], r["size"], r["total"]).astype(np.int64) for r in rows if (r["role"], r["n"]) == (HELD, n)}
        kinds, mass = (np.zeros(max(r["total"] for r in rows if r["n"] == n), np.int64) for _ in range(2))
        for r in rows:
            if (r["role"], r["n"]) == (SUMS, n):
                kinds[held[r["block"]]] += unsmall(r["low"], r["high"])
                mass[held[r["block"]]] += unsmall(r["mass_low"], r["mass_high"])
        for block, mine in held.items():
            yield _told(owner, block, LEFT, n, kinds=small(kinds[mine]), mass=small(mass[mine]))


class Counted:
    """Counts of a block's n-grams over the whole corpus, which of them it shares, and what its arcs add to its states."""

    def __init__(self, g: Grams, told: list[dict], owners: int, min_count: int):
        self.g, self.owned = g, g.owned(owners)
        self.counts, self.shared, adds = [c.copy() for c in g.counts], [np.zeros(len(k), bool) for k in g.keys], [np.ones(len(k), bool) for k in g.keys]
        for x in told:
            if x["role"] == COUNTS:
                n, a, b = x["n"], *self.range(x["n"], x["owner"])
                bits = np.frombuffer(x["keys"], np.uint8)
                both = np.unpackbits(bits[: -(-(b - a) // 8)], count=b - a).astype(bool)
                at = a + np.flatnonzero(both)
                self.shared[n][at], self.counts[n][at] = True, unsmall(x["low"], x["high"])
                adds[n][at] = np.unpackbits(bits[-(-(b - a) // 8) :], count=len(at)).astype(bool)
        self.kinds, self.mass = [], []
        for n in range(1, len(g.keys)):
            arc = adds[n] & (self.counts[n] >= min_count)
            state, states = g.state[n][arc], len(g.keys[n - 1])
            self.kinds.append(np.bincount(state, minlength=states).astype(np.int64))
            self.mass.append(np.bincount(state, self.counts[n][arc], states).astype(np.int64))

    def range(self, n: int, owner: int) -> tuple[int, int]:
        return int(self.owned[n][owner]), int(self.owned[n][owner + 1])

    def shared_states(self, n: int, owner: int) -> np.ndarray:
        a, b = self.range(n, owner)
        return a + np.flatnonzero(self.shared[n][a:b])

    def sums(self, block: int, owners: int) -> Iterator[pa.RecordBatch]:
        for n in range(len(self.kinds)):
            for o in range(owners):
                mine = self.shared_states(n, o)
                if len(mine):
                    yield _told(o, block, SUMS, n, kinds=small(self.kinds[n][mine]), mass=small(self.mass[n][mine]))

    def settle(self, told: list[dict]) -> None:
        for x in told:
            if x["role"] == LEFT:
                mine = self.shared_states(x["n"], x["owner"])
                self.kinds[x["n"]][mine] = unsmall(x["low"], x["high"])
                self.mass[x["n"]][mine] = unsmall(x["mass_low"], x["mass_high"])


class Automaton:
    """The part of the model that the texts of one block can reach."""

    def __init__(self, g: Grams, told: list[dict], owners: int, n_all: int, n_kinds: int, discount: float, min_count: int):
        counted = Counted(g, told, owners, min_count)
        counted.settle(told)
        counts, kinds, mass = counted.counts, counted.kinds, counted.mass
        self.g, self.known = g, counts[0] > 0
        #: For each order the probability of the last word after the others: by the arc if there is one, or along failure arcs.
        self.weight = [(counts[0] + 1) / (n_all + n_kinds + 1)]
        for n in range(1, len(counts)):
            seen = np.maximum(counts[n - 1], 1)
            left = np.where(counts[n - 1] > 0, 1.0 - (mass[n - 1] - discount * kinds[n - 1]) / seen, 1.0)
            arc = np.where(counts[n] >= min_count, (counts[n] - discount) / seen[g.state[n]], 0.0)
            self.weight.append(arc + left[g.state[n]] * self.weight[-1][g.suffix[n]])

    def traverse(self, order: int) -> np.ndarray:
        """log10 probability of every token, from the root on, in states of fewer than `order` words."""
        out = np.log10(self.weight[0])[self.g.code[0]]
        for n in range(1, order):
            at = np.flatnonzero(self.g.code[n] >= 0)
            out[at] = np.log10(self.weight[n])[self.g.code[n][at]]
        return out


def language_scores(docs: DataFrame, discount: float = DISCOUNT, min_count: int = MIN_COUNT, order: int = 2, block_bytes: int = BLOCK_BYTES, owner_bytes: int = OWNER_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows outside the held-out fold. Tokens are ASCII_SPACE words
    after lowering A-Z, and one end for each text; a null or empty text is an end
    alone. base_score is the add-one unigram log10 probability, score that of
    the automaton. Without training rows every token has probability 1. Repeated
    rows are scored alike and count as often as they stand there. Other columns
    are not used. Words and states are told apart by 64-bit hashes, followers of
    one state by 32 bits of theirs.
    """
    small_batches(docs.sparkSession, 100)
    fed = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = fed.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks, owners = max(1, -(-size // block_bytes)), max(1, -(-size * (order - 1) // owner_bytes))
    dealt = fed.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(blocks)))

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(part):
                    continue
                if now is not None and ids[part[0]] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(ids[part[0]])
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield now, pa.Table.from_batches(held)

    def grams(rows: pa.Table, up_to: int) -> Grams:
        hashes, per_text = tokens_of(rows.column("text").to_pylist())
        return Grams(hashes, per_text, ~rows.column("held_out").to_numpy(zero_copy_only=False), up_to)

    def told_and_texts(rows: pa.Table) -> tuple[list[dict], pa.Table]:
        split = int((rows.column("role").to_numpy() != TEXT).sum())
        return rows.slice(0, split).select(["owner", "role", *TOLD]).to_pylist(), rows.slice(split)

    def counting(orders: tuple[int, ...]):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, rows in whole_blocks(batches):
                yield _ask(block, grams(rows, orders[-1] + 1), owners, orders)

        return count

    def owning(longer: int):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for owner, messages in whole_blocks(batches):
                yield from _sum(owner, messages.to_pylist(), owners, longer, order)

        return own

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in whole_blocks(batches):
            told, mine = told_and_texts(rows)
            yield from Counted(grams(mine, order), told, owners, min_count).sums(block, owners)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in whole_blocks(batches):
            yield from _left(owner, rows.to_pylist())

    in_blocks = lambda df, *by: df.repartition(max(1, blocks // 2), "block").sortWithinPartitions("block", *by)
    # a partition may have several owners: sorted, one is held at a time
    by_owner = lambda df: df.repartition(owners, "owner").sortWithinPartitions("owner", "block")
    summed = None
    for orders in [(0, 1)[:order], *[(n,) for n in range(2, order)]]:
        asked = in_blocks(dealt.select("block", "held_out", "text")).mapInArrow(counting(orders), ASKED_TYPE)
        part = cut_lineage_and_release(by_owner(asked).mapInArrow(owning(orders[-1]), TOLD_TYPE))
        summed = part if summed is None else summed.unionByName(part)
    totals = summed.where(F.col("role") == TOTALS).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("total"), F.lit(0)).alias("n_kinds")).first()
    n_all, n_kinds = totals["n_all"], totals["n_kinds"]

    texts = dealt.select("block", F.lit(TEXT).alias("role"), F.col("doc_id"), "held_out", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("owner", "int"), ("n", "int"), *[(c, "binary") for c in TOLD[1:]])])

    def met(told: DataFrame) -> DataFrame:
        """The texts of each block behind what it was told."""
        told = told.select("block", "role", F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("text"), "owner", *TOLD)
        return in_blocks(texts.unionByName(told), "role")

    counts = summed.where(F.col("role") == COUNTS)
    added = met(counts).mapInArrow(add, TOLD_TYPE)
    left = cut_lineage_and_release(by_owner(added.unionByName(summed.where(F.col("role") == HELD))).mapInArrow(states, TOLD_TYPE))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_blocks(batches):
            replies, mine = told_and_texts(rows)
            g = grams(mine, order)
            per_text = g.per_text
            model = Automaton(g, replies, owners, n_all, n_kinds, discount, min_count)
            del replies
            begins = np.cumsum(per_text) - per_text
            base, scores = (np.add.reduceat(model.traverse(n), begins) if len(begins) else np.zeros(0) for n in (1, order))
            known = np.add.reduceat(model.known[g.code[0]].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [mine.column("doc_id").combine_chunks(), mine.column("held_out").combine_chunks(), pa.array(per_text, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = met(counts.unionByName(left)).mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
