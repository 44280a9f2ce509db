"""Repair of the turn structure of conversations at least cost.

A conversation must read `(s?(ua)+)?` by the first letters of its roles. Keep,
Delete, Rerole and Insert have costs; the cheapest edits are found by a cost
program over (row, state) nodes, and of several the one with the ASCII-least
audit is taken.

Costs: a conversation is cut into blocks of consecutive rows. A block's least
costs from state to state are a 4 x 4 matrix; matrices compose under (min, +),
so the cost from a block's end to the conversation's end is carried backwards
over summaries of blocks, in two levels, and no task holds a whole conversation.

Audit: arcs that lie on a cheapest path are ranked by prefix doubling. A node's
rank for audits of length 1 is its least letter; ranks for length 2k order the
pairs (rank for k, rank for k of the node k letters on), and pointers double
along. The final ranks choose each node's arc, and doubled pointers unfold the
chosen path: its first 2k nodes are its first k nodes and those k letters on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import small_batches
from tidewatch.operators.ordering import Layout, add_position, cut_lineage, in_blocks

BLOCK_TURNS = 4_096
SUPER_BLOCKS = 1_024
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States by what was last written: nothing, a system, user or assistant turn. After NEXT[s] comes user or assistant only.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
ENTRY = np.array([START, AFTER_S, AFTER_U, AFTER_A])
#: States in which a row whose role begins with u, a, s or anything else can be kept.
KEEPS = np.array([[1, 1, 0, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]], bool)
KEPT_AS = np.array([AFTER_U, AFTER_A, AFTER_S, START])
FAR = 1 << 40
LETTERS = np.frombuffer(b"DIKR", np.uint8)
SPACE = " \t\n\x0b\x0c\r"
TURN_COLUMNS = ("conv_id", "turn", "role", "text")


# -- rows ---------------------------------------------------------------------


def spoken(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32(`conv_id:turn`) % 20 names: 0 drop, 1 empty text, 2 no `.!?`, 3 twice, 4 role user. Nulls read as one space."""
    how = F.crc32(F.concat(spoken(F.col("conv_id")), F.lit(":"), spoken(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spoken(F.col("role")).alias("role"), spoken(F.col("text")).alias("text"), how.alias("_how")).where("_how <> 0")
    text = F.when(F.col("_how") == 1, F.lit("")).when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("_how") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def conversation_key(conv_id: Column) -> Column:
    """A string for every id, null included, so that joins need no special case."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def placed(rows: DataFrame) -> tuple[DataFrame, Layout]:
    """Rows with `_key` and `pos`: by turn, nulls first, rows of one turn by role and text."""
    keyed = rows.select(
        conversation_key(F.col("conv_id")).alias("_key"), "turn", F.coalesce("turn", F.lit(-(1 << 63))).alias("_turn"), F.col("turn").isNotNull().alias("_known"), "role", "text"
    )
    layout = Layout.plan(keyed, "_turn")
    out = add_position(keyed, ["_key"], ["_turn", "_known", "role", "text"], layout)
    return cut_lineage(out.select("_key", "pos", "turn", "role", "text")), layout


def judged(rows: DataFrame, layout: Layout) -> DataFrame:
    """Every placed row with its fault, what precedes it, and a small code of its role and fault; without the text."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    marks = rows.select(
        "_key",
        "pos",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.xxhash64("role", "text").alias("_h1"),
        F.xxhash64(F.lit(1), "role", "text").alias("_h2"),
    )
    # Only texts that stand more than once are joined back; AQE splits the rows of a very frequent one.
    same = ["_key", "_h1", "_h2"]
    again = marks.where("NOT blank").groupBy(*same).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    known = cut_lineage(marks.join(again, same, "left").select("_key", "pos", "turn", "initial", "blank", (~F.col("blank") & (F.col("pos") > F.col("_first"))).alias("duplicate"), "open"))

    def looked_back(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("pos")
        return frame.withColumns({"_before": F.lag("initial").over(w), "_turn_before": F.lag("turn").over(w)})

    out = in_blocks(known, ["_key"], "pos", layout, looked_back, before=1)
    duplicate = F.coalesce("duplicate", F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("open"), "truncated")
    kind = F.coalesce(*[F.when(F.col("initial") == c, F.lit(i)) for i, c in enumerate("uas")], F.lit(3))
    burden = F.when(F.col("blank") | duplicate, 1).when(F.col("open"), 2).otherwise(0)
    pair = F.concat("_before", "initial")
    return out.select(
        "_key",
        "pos",
        "turn",
        fault.alias("fault"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn_before"))).alias("fresh"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (kind * 3 + burden).cast("int").alias("code"),
    )


def fault_counts(marks: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal. Gaps beyond the range of a long are null."""
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long"))
    return marks.groupBy("_key").agg(
        F.try_subtract(F.when(F.max("turn").isNull(), F.lit(0).cast("long")).otherwise(span), F.count_if("fresh")).alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
    )


# -- blocks of codes ----------------------------------------------------------


def _row_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row: cost of keeping in each state, of giving it the next role, and the state it is kept as."""
    kind, burden = codes // 3, codes % 3
    extra = np.where(burden == 2, TRUNCATED, 0)
    stays = burden != 1
    keep = np.where(KEEPS[kind] & stays[..., None], (KEEP + extra)[..., None], FAR)
    return keep, np.where(stays, REROLE + extra, FAR), KEPT_AS[kind]


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs (..., state) when turns may be inserted first; two rounds close the only cycle."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[..., NEXT])
    return cost


def _padded(blocks: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in blocks])
    codes = np.full((len(blocks), max(1, size.max(initial=0))), -1, np.int64)
    for i, b in enumerate(blocks):
        codes[i, : len(b)] = b
    return codes, size


def costs_to_go(blocks: Sequence[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """(block, place, ..., state) least costs, inserts included, up to the costs `ends` (block, ..., state) behind each block's last row."""
    codes, size = _padded(blocks)
    extra = ends.ndim - 2
    out = np.full((len(blocks), codes.shape[1] + 1, *ends.shape[1:]), FAR, np.int64)
    out[np.arange(len(blocks)), size] = ends
    for at in range(codes.shape[1] - 1, -1, -1):
        here = np.flatnonzero(size > at)
        keep, rerole, as_state = (a.reshape(len(here), *[1] * extra, *a.shape[1:]) for a in _row_costs(codes[here, at]))
        after = out[here, at + 1]
        kept = keep + np.take_along_axis(after, np.broadcast_to(as_state[..., None], (*after.shape[:-1], 1)), -1)
        changed = rerole[..., None] + after[..., NEXT]
        out[here, at] = _with_inserts(np.minimum(np.minimum(DELETE + after, kept), changed))
    return np.minimum(out, FAR)


def block_matrices(blocks: Sequence[np.ndarray]) -> np.ndarray:
    """(block, from, to): least cost from a state before the block to a state behind its last row."""
    goal = np.where(np.eye(4, dtype=bool), 0, FAR)
    ends = np.broadcast_to(goal, (len(blocks), 4, 4)).copy()
    return costs_to_go(blocks, ends)[:, 0].swapaxes(1, 2)


#: Costs behind the last row: nothing or a whole pair has been written, or turns must be inserted.
LAST = _with_inserts(np.array([0, FAR, FAR, 0]))


def least_audits(blocks: Sequence[np.ndarray], ends: np.ndarray, last: np.ndarray, entries: Sequence[Sequence[int]]) -> list[list[tuple[str, int, int]]]:
    """For each block and entry state: (audit, exit state, cost to the conversation's end).

    `ends` are the costs behind each block, `last` marks the blocks behind which
    the conversation ends, so that turns can be inserted there.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in blocks]
    # Blocks of similar length are handled together, so that the unfolded paths waste no room.
    classes: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        classes.setdefault(int(len(b)).bit_length(), []).append(i)
    for held in classes.values():
        step = max(1, (1 << 18) // (4 * (len(blocks[held[-1]]) + 1)))
        for k in range(0, len(held), step):
            part = held[k : k + step]
            for i, found in zip(part, _ranked_paths([blocks[i] for i in part], ends[part], last[part], [entries[i] for i in part]), strict=True):
                out[i] = found
    return out


def _ranked_paths(blocks, ends, last, entries):
    codes, size = _padded(blocks)
    togo = costs_to_go(blocks, ends)
    n, width = len(blocks), codes.shape[1] + 1
    at = np.broadcast_to(np.arange(width)[None, :, None], (n, width, 4))
    node = np.arange(n * width * 4).reshape(n, width, 4)
    inside = at < size[:, None, None]
    row = np.concatenate([np.maximum(codes, 0), np.zeros((n, 1), np.int64)], 1)
    keep, rerole, as_state = _row_costs(row)
    onward = np.concatenate([node[:, 1:], node[:, -1:]], 1)  # the same state one row on
    pick = lambda a, s: np.take_along_axis(a, s, 2)
    fixed = np.broadcast_to(as_state[:, :, None], (n, width, 4))
    following = np.broadcast_to(NEXT, (n, width, 4))
    # Arcs in the order of their letters: D, I, K, R.
    target = np.stack([onward, pick(node, following), pick(onward, fixed), pick(onward, following)], -1).reshape(-1, 4)
    cost = np.stack([np.full((n, width, 4), DELETE), np.full((n, width, 4), INSERT), keep, np.broadcast_to(rerole[:, :, None], (n, width, 4))], -1)
    may = np.stack([inside, inside | (last[:, None, None] & (at == size[:, None, None])), inside, inside], -1)
    flat = togo.reshape(-1)
    best = (may & (cost.reshape(n, width, 4, 4) + flat[target].reshape(n, width, 4, 4) == togo[..., None]) & (togo[..., None] < FAR)).reshape(-1, 4)
    ends_here = ~best.any(1)
    letter = np.where(ends_here, 4, best.argmax(1))
    itself = np.arange(len(letter))
    # Ranks for audits of length 1, 2, 4, ...: 0 where the path has ended.
    rank, jump, reach = np.where(ends_here, 0, letter + 1), np.where(ends_here, itself, target[itself, np.minimum(letter, 3)]), 1
    longest = 3 * width  # at most two inserts stand before a row on a cheapest path
    while reach < longest:
        rank = np.unique(rank * (len(rank) + 5) + rank[jump], return_inverse=True)[1]
        jump, reach = jump[jump], 2 * reach
        if (jump[jump] == jump).all():
            break
    # The chosen arc: least letter, then least rank of what follows.
    order = np.where(best, np.arange(4)[None, :] * (len(rank) + 1) + rank[target], np.iinfo(np.int64).max)
    arc = order.argmin(1)
    step = np.where(ends_here, itself, target[itself, arc])
    begin = np.array([node[i, 0, s] for i, states in enumerate(entries) for s in states])
    path, jump = begin[:, None], step
    while not ends_here[path[:, -1]].all():
        path = np.concatenate([path, jump[path]], 1)
        jump = jump[jump]
    shown = np.where(ends_here[path], 0, LETTERS[arc[path]]).astype(np.uint8)
    lengths = (shown != 0).sum(1)
    texts = [bytes(s[:k]).decode() for s, k in zip(shown, lengths.tolist(), strict=True)]
    exits, costs = (path[:, -1] % 4).tolist(), flat[begin].tolist()
    found, k = [], 0
    for states in entries:
        found.append(list(zip(texts[k : k + len(states)], exits[k : k + len(states)], costs[k : k + len(states)], strict=True)))
        k += len(states)
    return found


def replay(audit: str, state: int, codes: np.ndarray) -> list[tuple[int, str, str | None]]:
    """(row, letter, new role or None) of every turn that the audit leaves, inserts with the row they stand before."""
    out, row = [], 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        if letter == "K":
            out.append((row, letter, None))
            state = int(KEPT_AS[codes[row] // 3])
        else:
            state = int(NEXT[state])
            out.append((row, letter, "user" if state == AFTER_U else "assistant"))
        row += letter != "I"
    return out


# -- carrying over blocks -----------------------------------------------------


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def carried(matrices: DataFrame, start: np.ndarray, backwards: bool, super_blocks: int = SUPER_BLOCKS) -> DataFrame:
    """(_key, block, v): for each block the vector that arrives at it, from `start`, through all blocks before it (behind it, if backwards).

    `matrices` has _key, block and m, 16 numbers (from, to). Blocks are first
    multiplied in groups of `super_blocks`, so a task holds that many matrices,
    or one matrix a group.
    """
    grouped = matrices.withColumn("_super", F.floor(F.col("block") / super_blocks).cast("long"))
    way = -1 if backwards else 1

    def through(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.minimum(((m + v[None, :]).min(1) if backwards else (v[:, None] + m).min(0)), FAR)

    def ordered(t: pa.Table, by: str) -> tuple[list, np.ndarray]:
        t = t.sort_by([(by, "ascending")])
        return t.column(by).to_pylist(), np.array(t.column("m").to_pylist(), np.int64).reshape(-1, 4, 4)

    def multiply(t: pa.Table) -> pa.Table:
        _, m = ordered(t, "block")
        whole = m[0]
        for x in m[1:]:
            whole = _product(whole, x)
        return pa.table({"_key": t.column("_key")[:1], "_super": t.column("_super")[:1], "m": pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))})

    def pass_on(t: pa.Table, by: str, v: np.ndarray) -> pa.Table:
        names, m = ordered(t, by)
        seen = {}
        for i in list(range(len(names)))[::way]:
            seen[i] = v
            v = through(v, m[i])
        return pa.table({"_key": pa.array([t.column("_key")[0].as_py()] * len(names), pa.string()), by: pa.array(names, pa.int64()), "v": pa.array([seen[i].tolist() for i in range(len(names))], pa.list_(pa.int64()))})

    supers = grouped.groupBy("_key", "_super").applyInArrow(multiply, "_key string, _super long, m array<long>")
    arriving = supers.groupBy("_key").applyInArrow(lambda t: pass_on(t, "_super", start), "_key string, _super long, v array<long>")
    inside = grouped.join(arriving, ["_key", "_super"])
    return inside.groupBy("_key", "_super").applyInArrow(lambda t: pass_on(t, "block", np.array(t.column("v")[0].as_py(), np.int64)), "_key string, block long, v array<long>")


def code_blocks(marks: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(_key, block, blocks, codes): codes of consecutive rows, at most `block_turns` of them, and the number of blocks of the conversation."""
    block = F.floor(F.col("pos") / block_turns).cast("long")
    held = marks.groupBy("_key", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_rows"))
    sizes = held.groupBy("_key").agg((F.max("block") + 1).alias("blocks"))
    return held.select("_key", "block", F.col("_rows.code").alias("codes")).join(sizes, "_key")


def audits(marks: DataFrame, block_turns: int = BLOCK_TURNS, super_blocks: int = SUPER_BLOCKS) -> DataFrame:
    """(_key, block, state, codes, audit, cost): the chosen edits of every block, the state it is entered in, and the cost from there to the end."""
    blocks = cut_lineage(code_blocks(marks, block_turns))
    numbers = lambda column: [np.array(x, np.int64) for x in column.to_pylist()]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = block_matrices(numbers(b.column("codes"))).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("block"), pa.array(m.tolist(), pa.list_(pa.int64()))], names=["_key", "block", "m"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, first = numbers(b.column("codes")), np.array(b.column("block")) == 0
            final = np.array(b.column("block")) == np.array(b.column("blocks")) - 1
            ends = np.array([LAST if v is None else v for v in b.column("v").to_pylist()], np.int64)
            found = least_audits(codes, ends.reshape(-1, 4), final, [[START] if f else ENTRY.tolist() for f in first])
            rows = [[{"state": s, "audit": a, "leaves": e, "cost": c} for s, (a, e, c) in zip([START] if f else ENTRY.tolist(), x, strict=True)] for f, x in zip(first, found, strict=True)]
            kind = pa.list_(pa.struct([("state", pa.int32()), ("audit", pa.string()), ("leaves", pa.int32()), ("cost", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.select(["_key", "block", "blocks", "codes"]).columns, pa.array(rows, kind)], names=["_key", "block", "blocks", "codes", "ways"])

    many = blocks.where("blocks > 1")
    behind = carried(many.mapInArrow(matrices, "_key string, block long, m array<long>"), LAST, True, super_blocks)
    ways = cut_lineage(
        blocks.join(behind, ["_key", "block"], "left")
        .select("_key", "block", "blocks", "codes", "v")
        .mapInArrow(search, "_key string, block long, blocks long, codes array<int>, ways array<struct<state:int,audit:string,leaves:int,cost:long>>")
    )
    # Which state a block leaves in is a matrix as well: cost 0 to that state, from each state it may be entered in.
    leaves = lambda s: F.aggregate("ways", F.lit(-1), lambda a, w: F.when(w["state"] == s, w["leaves"]).otherwise(a))
    one_hot = F.array(*[F.when(leaves(s) == e, F.lit(0)).otherwise(F.lit(FAR)).cast("long") for s in range(4) for e in range(4)])
    entered = carried(ways.where("blocks > 1").select("_key", "block", one_hot.alias("m")), np.where(np.arange(4) == START, 0, FAR), False, super_blocks)
    state = F.coalesce(F.array_position("v", F.lit(0).cast("long")) - 1, F.lit(START)).cast("int")
    picked = ways.join(entered, ["_key", "block"], "left").withColumn("_state", state)
    chosen = picked.withColumn("_way", F.get(F.filter("ways", lambda w: w["state"] == F.col("_state")), F.lit(0)))
    return chosen.select("_key", "block", F.col("_state").alias("state"), "codes", F.col("_way.audit").alias("audit"), F.col("_way.cost").alias("cost"))


# -- repaired conversations ---------------------------------------------------


def edits_of(chosen: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(_key, block, place, pos, letter, role): every turn of the repaired conversations in order; pos names the kept row, role is new where given."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, block, state, codes, audit in zip(*(b.column(c).to_pylist() for c in ("_key", "block", "state", "codes", "audit")), strict=True):
                for place, (row, letter, role) in enumerate(replay(audit, state, np.array(codes, np.int64))):
                    out.append((key, block, place, block * block_turns + row, letter, role))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_key", "block", "place", "pos", "letter", "role"])

    return chosen.select("_key", "block", "state", "codes", "audit").mapInArrow(spell, "_key string, block long, place long, pos long, letter string, role string")


def repaired_turns(rows: DataFrame, chosen: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(_key, block, place, letter, role, text): the repaired conversations, ordered by block and place."""
    edits = edits_of(chosen, block_turns).withColumn("_pos", F.when(F.col("letter") != "I", F.col("pos")))
    old = rows.select(F.col("_key").alias("_k"), F.col("pos").alias("_p"), F.col("role").alias("_role"), "text")
    both = edits.join(old, (F.col("_key") == F.col("_k")) & (F.col("_pos") == F.col("_p")), "left")
    return both.select("_key", "block", "place", "letter", F.coalesce("role", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """(_key, sha256): hex digest of the `role:text` lines of each conversation, joined by newlines.

    The digest of one text has to be taken in order; rows come sorted and are fed
    to it one at a time, so a long conversation needs time but no memory.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            keys, sums = [], []
            for k, line in zip(b.column("_key").to_pylist(), b.column("line").to_pylist(), strict=True):
                if held is None or k != key:
                    if held is not None:
                        keys.append(key)
                        sums.append(held.hexdigest())
                    key, held = k, hashlib.sha256(line)
                else:
                    held.update(b"\n")
                    held.update(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["_key", "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([held.hexdigest()], pa.string())], names=["_key", "sha256"])

    lines = turns.select("_key", "block", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition("_key").sortWithinPartitions("_key", "block", "place").select("_key", "line").mapInArrow(digest, "_key string, sha256 string")


def repair(conversations: DataFrame, block_turns: int = BLOCK_TURNS, super_blocks: int = SUPER_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, marks, chosen): damaged rows in order, their faults, and the cheapest edits of each block of them.

    Input columns other than conv_id, turn, role and text are ignored. An empty
    table gives empty tables. Null ids form one conversation; null turns come
    first; null roles and texts are one space; rows of one turn stand by role
    and text, so repeated rows are neighbours and all but one are duplicates.
    """
    small_batches(conversations.sparkSession)
    rows, layout = placed(damaged(conversations.select(*TURN_COLUMNS)))
    marks = cut_lineage(judged(rows, layout))
    return rows, marks, cut_lineage(audits(marks, block_turns, super_blocks))


def repair_report(conversations: DataFrame, block_turns: int = BLOCK_TURNS, super_blocks: int = SUPER_BLOCKS) -> DataFrame:
    """One row for every original conv_id: its faults, the cost and audit of its repair, and a digest of the repaired turns.

    A conversation whose rows were all dropped has zeros, an empty audit and the
    digest of an empty text; so has one whose cheapest repair deletes all rows,
    but for its counts, cost and audit.
    """
    rows, marks, chosen = repair(conversations, block_turns, super_blocks)
    ids = conversations.select("conv_id").distinct().withColumn("_key", conversation_key(F.col("conv_id")))
    whole = chosen.groupBy("_key").agg(
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"),
    )
    sums = conversation_hashes(repaired_turns(rows, chosen, block_turns))
    joined = ids.join(fault_counts(marks), "_key", "left").join(whole, "_key", "left").join(sums, "_key", "left")
    zero, present = F.lit(0).cast("long"), F.col("cost").isNotNull()
    return joined.select(
        "conv_id",
        F.when(present, F.col("gaps")).otherwise(zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
