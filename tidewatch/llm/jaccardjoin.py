"""Near-duplicate documents: an exact Jaccard self-join of shingle sets by a token-group matrix.

1. Every document becomes a set of 64-bit shingle hashes. Equal sets become one.
2. How many documents hold a shingle is counted for all of them, in tasks that
   own a part of the hashes. A set's shingles are ordered from rare to frequent,
   and only a prefix can matter: sets that reach the threshold share a shingle of
   both their prefixes. Prefix shingles that no other document has drop out.
3. Similar sets are partitioned into groups: each set joins the smallest set of a
   fitting size that shares a prefix shingle with it. Groups are cut into blocks
   of a bounded number of sets, each with the group's first set, and linked inside.
4. The token-group matrix holds which blocks' prefixes contain a shingle. A set
   queries the blocks that share one with it and are not yet known to be of its
   component. In a block, the union of its sets bounds the overlap; only a block
   whose bound reaches the threshold is opened, and its sets are compared.
5. Links make components.

Pairs known to be connected are not compared again, so a large group of copies
costs one comparison for each member and not one for each pair; no link between
different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.text import chunks, flat_words, lean, row_id, shingle_sets, small_batches
from tidewatch.operators.ordering import cut_lineage

SHINGLE, PERCENT = 5, 80
BLOCK_SETS, BLOCK_QUERIES = 200, 500
OWNER_BYTES = 24_000_000


def sets_of(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, held in chunks(texts):
        words, per_text, *_ = flat_words(held)
        out += shingle_sets(words, per_text, shingle)
    return out


def owned(tokens: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each token, stable order by owner)."""
    owner = (tokens % np.uint64(owners)).astype(np.int64)
    return owner, np.argsort(owner, kind="stable")


def rounded_counts(codes: list[np.ndarray]) -> list[bytes]:
    """For each code, in bytes, the rounded binary logarithm of how often all arrays hold it.

    Only the repeated codes are kept beside one sorted copy: most shingles stand
    once, and places of all codes would take several times their memory.
    """
    held = np.concatenate(codes)
    held.sort()
    again, times = np.unique(held[1:][held[1:] == held[:-1]], return_counts=True)
    del held
    classes = np.frexp(times + 1.0)[1].astype(np.uint8) - np.uint8(1)
    told = []
    for c in codes:
        at = np.searchsorted(again, c)
        at[at == len(again)] = 0
        told.append((np.where(again[at] == c, classes[at], 0) if len(again) else np.zeros(len(c))).astype(np.uint8).tobytes())
    return told


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct tokens."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Union:
    """Which of a few items are connected."""

    def __init__(self, kinds: list):
        first: dict = {}
        self.up = [first.setdefault(k, i) for i, k in enumerate(kinds)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values in the first column, across batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and ids[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _frequencies(docs: DataFrame, shingle: int, owners: int) -> DataFrame:
    """(_id, _row, classes): for each shingle of a set, by owner and hash, the rounded binary logarithm of how many rows hold it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            sets = sets_of(batch.column(2).to_pylist(), shingle)
            if not sets:
                continue
            tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            name = xxhash.xxh3_64_intdigest(repr((part, number, batch.column(0).to_pylist(), batch.column(1).to_pylist())).encode()) >> 1
            owner, order = owned(tokens, owners)
            cuts = np.searchsorted(owner[order], np.arange(owners + 1))
            for o in range(owners):
                mine = order[cuts[o] : cuts[o + 1]]
                per_doc = np.bincount(doc[mine], minlength=len(sets)).astype("<i4")
                codes = (tokens[mine] >> np.uint64(32)).astype("<u4")
                keys = [batch.column(0), batch.column(1)] if o == 0 else [batch.column(0).slice(0, 0), batch.column(1).slice(0, 0)]
                ids = [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([name], pa.int64()), *ids, pa.array([per_doc.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["owner", "batch", "ids", "rows", "per_doc", "codes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            told = rounded_counts([np.frombuffer(c.as_buffer(), "<u4") for c in table.column("codes")])
            for batch in table.drop_columns(["codes"]).append_column("classes", pa.array(told, pa.binary())).to_batches():
                yield batch

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            ids, rows = (next(x for x in table.column(c).to_pylist() if x) for c in ("ids", "rows"))
            parts: list[list[bytes]] = [[] for _ in ids]
            order = np.argsort(table.column("owner").to_numpy())
            per_doc, classes = table.column("per_doc").to_pylist(), table.column("classes").to_pylist()
            for i in order.tolist():
                ends = np.cumsum(np.frombuffer(per_doc[i], "<i4")).tolist()
                begin, data = 0, classes[i]
                for part, end in zip(parts, ends, strict=True):
                    if end > begin:
                        part.append(data[begin:end])
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(rows, pa.int64()), pa.array([b"".join(p) for p in parts], pa.binary())], names=["_id", "_row", "classes"])

    kind = docs.schema["_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    asked = docs.select("_id", "_row", "text").mapInArrow(lean(ask), f"owner int, batch long, ids array<{kind}>, rows array<long>, per_doc binary, codes binary")
    counted = asked.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(lean(count), f"owner int, batch long, ids array<{kind}>, rows array<long>, per_doc binary, classes binary")
    return counted.select("batch", "owner", "ids", "rows", "per_doc", "classes").repartition("batch").sortWithinPartitions("batch").mapInArrow(lean(deal), f"_id {kind}, _row long, classes binary")


def shingle_table(docs: DataFrame, shingle: int, percent: int, owners: int) -> DataFrame:
    """(_id, _row, n, sign, prefix, tokens) of each row; prefix and tokens only where another document shares a shingle of the prefix."""
    ranked = _frequencies(docs, shingle, owners).dropDuplicates(["_id", "_row"]).select(F.col("_id").alias("r_id"), F.col("_row").alias("r_row"), "classes")
    met = docs.join(ranked, F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_row") == F.col("r_row"))).select("_id", "_row", "text", "classes")
    kind = docs.schema["_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sign, prefix, tokens = [], [], [], []
            for s, told in zip(sets_of(batch.column(2).to_pylist(), shingle), batch.column(3).to_pylist(), strict=True):
                size.append(len(s))
                sign.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not len(s):
                    prefix.append([])
                    tokens.append(None)
                    continue
                classes = np.empty(len(s), np.uint8)
                classes[owned(s, owners)[1]] = np.frombuffer(told, np.uint8)
                first = np.lexsort((s, classes))[: len(s) - _needed(len(s), percent) + 1]
                shared = s[first[classes[first] > 0]]
                prefix.append(shared.view(np.int64))
                tokens.append(s.tobytes() if len(shared) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sign, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                names=["_id", "_row", "n", "sign", "prefix", "tokens"],
            )

    return cut_lineage(met.mapInArrow(lean(build), f"_id {kind}, _row long, n long, sign binary, prefix array<long>, tokens binary"))


def _compare(percent: int):
    """Blocks of (block, role, node, component, tokens) to links (a, b): role 0 the block's first set, 1 its sets, 2 queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            role, node, kind = (table.column(c).to_pylist() for c in ("role", "node", "component"))
            sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
            members = [i for i, r in enumerate(role) if r < 2]
            queries = [i for i, r in enumerate(role) if r == 2]
            union, found = Union(kind), []

            def test(i: int, j: int) -> None:
                if union.find(i) != union.find(j) and linked(sets[i], sets[j], percent):
                    union.join(i, j)
                    found.append((node[i], node[j]))

            if queries:
                together = np.unique(np.concatenate([sets[i] for i in members])) if members else np.zeros(0, np.uint64)
                for q in queries:
                    at = np.searchsorted(together, sets[q])
                    at[at == len(together)] = 0
                    bound = int((together[at] == sets[q]).sum()) if len(together) else 0
                    if bound >= _needed(len(sets[q]), percent):
                        for i in members:
                            test(i, q)
            else:
                for x, i in enumerate(members):
                    for j in members[:x]:
                        test(j, i)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], table.schema.field("node").type), pa.array([f[1] for f in found], table.schema.field("node").type)], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    kind = rows.schema["node"].dataType.simpleString()
    placed = rows.select("block", "role", "node", "component", "tokens").repartition("block").sortWithinPartitions("block", "role", "node")
    return cut_lineage(placed.mapInArrow(lean(_compare(percent)), f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_queries: int = BLOCK_QUERIES, owner_bytes: int = OWNER_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, _row, n_shingles, component_id.

    Words are runs without ASCII space, A-Z lowered; a text of fewer words than a
    shingle is one shingle; a text without words is an empty set and linked with
    nothing. Two sets link when 100 * |both| >= `percent` * |either|;
    component_id is the smallest id reachable by links. Rows that share an id are
    one document: their links are united. Rows without an id get a component of
    null. Repeated rows are handled alike. Other columns are not used.
    """
    small_batches(docs.sparkSession)
    fed = docs.select(F.col(id_col).alias("_id"), row_id(id_col, text_col).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = fed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = shingle_table(fed, shingle, percent, max(1, -(-size // owner_bytes)))
    some = sets.filter(F.size("prefix") > 0).filter(F.col("_id").isNotNull())
    signs = some.groupBy("sign").agg(F.min_by(F.struct("n", "prefix", "tokens"), F.struct("_id", "_row")).alias("x"), F.min("_id").alias("node"))
    reps = cut_lineage(signs.select("sign", "node", "x.*"))

    entries = reps.select("node", "n", F.explode("prefix").alias("token"))
    lists = entries.groupBy("token").agg(F.min(F.struct("n", "node")).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").select(F.col("token").alias("l_token"), "first")
    shared = cut_lineage(entries.join(lists, F.col("token") == F.col("l_token")).select("token", "node", "n", "first"))
    fitting = F.when(100 * F.col("first.n") >= percent * F.col("n"), F.col("first"))
    leaders = shared.groupBy("node").agg(F.min(fitting).alias("first")).select("node", F.coalesce("first.node", "node").alias("leader"))
    sizes = leaders.groupBy(F.col("leader").alias("s_leader")).agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("pieces"))
    places = cut_lineage(
        leaders.join(sizes, F.col("leader") == F.col("s_leader")).select("node", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("block"))
    )
    content = reps.select(F.col("node").alias("c_node"), "tokens")
    heads = places.select("block", "leader").distinct().select("block", F.lit(0).alias("role"), F.col("leader").alias("node"))
    bodies = places.filter("node <> leader").select("block", F.lit(1).alias("role"), "node")
    grouped = heads.unionAll(bodies).join(content, F.col("node") == F.col("c_node")).select("block", "role", "node", F.col("node").alias("component"), "tokens")
    inner = _in_blocks(grouped, percent)

    known = cut_lineage(components(inner)).select(F.col("node").alias("k_node"), F.col("component").alias("known"))
    spots = places.select(F.col("node").alias("p_node"), "block")
    rows = (
        shared.select("token", "node", "n")
        .join(spots, F.col("node") == F.col("p_node"))
        .join(known, F.col("node") == F.col("k_node"), "left")
        .select("token", "node", "n", "block", F.coalesce("known", "node").alias("component"))
    )
    rows = cut_lineage(rows)
    open_tokens = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    open_rows = rows.join(open_tokens, "token", "left_semi")
    matrix = open_rows.groupBy(F.col("token").alias("m_token"), F.col("block").alias("m_block")).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hits = open_rows.join(matrix, (F.col("token") == F.col("m_token")) & (F.col("block") > F.col("m_block"))).filter(
        (100 * F.col("n_max") >= percent * F.col("n")) & (percent * F.col("n_min") <= 100 * F.col("n")) & ((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component")))
    )
    asking = cut_lineage(hits.select(F.col("m_block").alias("block"), "node", "component").distinct())
    pieces = asking.groupBy(F.col("block").alias("q_block")).agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("pieces"))
    queries = asking.join(pieces, F.col("block") == F.col("q_block")).select(F.xxhash64("block", F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("block"), F.lit(2).alias("role"), "node", "component")
    opened = (
        places.join(pieces, F.col("block") == F.col("q_block"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .join(known, F.col("node") == F.col("k_node"), "left")
        .select(F.xxhash64("block", "piece").alias("block"), F.lit(1).alias("role"), "node", F.coalesce("known", "node").alias("component"))
    )
    across = _in_blocks(queries.unionAll(opened).join(content, F.col("node") == F.col("c_node")).select("block", "role", "node", "component", "tokens"), percent)

    final = components(known.select(F.col("k_node").alias("a"), F.col("known").alias("b")).unionAll(across)) if not across.isEmpty() else known.select(F.col("k_node").alias("node"), F.col("known").alias("component"))
    # A document whose rows differ stands for several sets: all of them hang together by its id.
    of_sign = reps.select(F.col("sign").alias("g_sign"), F.col("node").alias("g_node"))
    out = sets.select("_id", "_row", "n", "sign").join(of_sign, F.col("sign") == F.col("g_sign"), "left")
    out = out.join(final.select(F.col("node").alias("f_node"), "component"), F.col("g_node") == F.col("f_node"), "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "g_node", "_id"))
    return out.select(F.col("_id").alias(id_col), "_row", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, and those without an id, unchanged."""
    gone = near_duplicates(docs, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("g_id"), F.col("_row").alias("g_row")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("g_id")) & (row_id("doc_id", "text") == F.col("g_row")), "left_anti")
