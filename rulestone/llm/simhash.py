"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint is the bitwise majority of the hashes of a document's word shingles. Fingerprints within an error budget
are found in tries over permuted bits: the bits are cut into budget + m blocks, of which at least m are the same in any
two fingerprints to be linked, so there is one trie for each choice of m blocks, with these blocks' bits on top. Below
each such top, which is where the work is dealt out, pairs of nodes are walked together, differing bits are added up, and
a pair is left when they exceed the budget. Every m finds all links; m is the least that keeps tops small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, checkpoint, few_rows, fresh, text_or_empty
from .components import components

BUDGET, SHINGLE = 4, 4
#: For a similarity of about 0.8 of sets of five-word shingles, at which half of all pairs differ in 8 bits or fewer.
BUDGET_AT_08, SHINGLE_AT_08 = 8, 5
#: Independent fingerprints of a text by which near copies are looked for; a pair is a candidate by any of them.
SKETCHES = 4
#: A trie top holds so many fingerprints on average at most; one with more than CHUNK is dealt out as pairs of chunks.
FEW, CHUNK = 4096, 8192
#: Nodes with so few fingerprints are compared as a block.
LEAF = 96
#: Texts that are compared at once at most, when candidates are verified; larger groups are dealt out as pairs of chunks.
TEXTS = 512
#: Least Jaccard similarity of near copies: numerator and denominator.
SIMILAR = (4, 5)
#: Tables of at most so many rows are broadcast; others are joined by a shuffle.
SMALL_ROWS = 100_000


def _hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of the shingles, repeats included: A-Z are lower-cased; words are what stands between ASCII white
    space; fewer words than a shingle are one. No words: none."""
    words = text.encode().lower().split()
    one = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([one(joined, 42)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.array([one(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes. No hashes: 0."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The bitwise majority of the hashes of a text's shingles."""
    return _majority(_hashes(text, shingle))


def sketches(text: str, shingle: int, number: int = SKETCHES) -> list[int]:
    """number fingerprints, the first that of fingerprint(); for each other one the hashes are mixed anew."""
    hashes = _hashes(text, shingle)
    found = [_majority(hashes)]
    for k in range(1, number):
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(odd)
        found.append(_majority(mixed ^ mixed >> np.uint64(31)))
    return found


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; words as fingerprint() takes them."""
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))}
    return np.sort(np.fromiter(found if words else (), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of shingles reaches SIMILAR; two empty sets are alike."""
    up, down = SIMILAR
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits). A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in few_rows(batches):
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks_on_top(n: int, budget: int, few: int = FEW) -> int:
    """The least number of blocks whose bits leave few fingerprints below each top."""
    m = 1
    while m < 64 - budget and n / 2 ** (64 * m / (budget + m)) > few:
        m += 1
    return m


def masks(budget: int, m: int) -> list[int]:
    """Signed 64-bit masks of the bits on top of each trie."""
    bounds = [64 * i // (budget + m) for i in range(budget + m + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in map(sum, combinations(blocks, m))]


class _Union:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links left[i] with right[i]; labels are brought up to date at once."""
        a, b = self.label[left], self.label[right]
        open_ = a != b
        if not open_.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = np.array(list(parent), np.int64)
        if len(moved):
            to = np.arange(len(self.label))
            to[moved] = [root(x) for x in parent]
            self.label = to[self.label]


def trie_links(values: np.ndarray, budget: int, same: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """values: unsigned fingerprints, sorted. Returns for each the index of the least one of its component under links of
    at most budget differing bits, by walking pairs of trie nodes (ranges of values with a common prefix). A pair whose
    fingerprints are all of one component already is left as well. With same, pairs of indices that it denies are no
    links."""
    own = _Union(len(values))

    def cut(lo: int, hi: int, bit: int) -> int:
        """Where the branch with that bit set begins."""
        at = (int(values[lo]) >> (bit + 1) << (bit + 1)) | 1 << bit
        return lo + int(np.searchsorted(values[lo:hi], np.uint64(at)))

    def done(a: tuple[int, int], b: tuple[int, int]) -> bool:
        first = own.label[a[0]]
        return bool((own.label[a[0] : a[1]] == first).all() and (own.label[b[0] : b[1]] == first).all())

    walk = [((0, len(values)), (0, len(values)), 63, 0)]
    while walk:
        a, b, bit, differing = walk.pop()
        if a[0] == a[1] or b[0] == b[1] or differing > budget or (a == b and a[1] - a[0] == 1) or done(a, b):
            continue
        if bit < 0 or max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            near = np.bitwise_count(values[a[0] : a[1], None] ^ values[None, b[0] : b[1]]) <= budget
            left, right = np.nonzero(near)
            if same is None:
                own.join(left + a[0], right + b[0])
                continue
            for x, y in zip((left + a[0]).tolist(), (right + b[0]).tolist(), strict=True):
                if (a != b or x < y) and own.label[x] != own.label[y] and same(x, y):
                    own.join(np.array([x]), np.array([y]))
            continue
        ma, mb = cut(*a, bit), cut(*b, bit)
        a0, a1, b0, b1 = (a[0], ma), (ma, a[1]), (b[0], mb), (mb, b[1])
        walk.append((a0, b1, bit - 1, differing + 1))
        if a != b:
            walk.append((a1, b0, bit - 1, differing + 1))
        walk += [(a0, b0, bit - 1, differing), (a1, b1, bit - 1, differing)]
    return own.label


def _link_groups(budget: int):
    def flush(group: np.ndarray, values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows sorted by group and value; values repeat in a group if two tops' names agree or two chunks overlap."""
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[begins, len(group)])
        two = begins[sizes == 2]
        near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= budget]
        left, right = [nodes[near]], [nodes[near + 1]]
        for lo, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own, at = np.unique(values[lo : lo + n], return_index=True)
            label, node = trie_links(own, budget), nodes[lo + at]
            least = node.copy()  # of each component, at its label
            np.minimum.at(least, label, node)
            linked = np.flatnonzero(node != least[label])
            left.append(node[linked])
            right.append(least[label[linked]])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        held = [np.empty(0, np.int64) for _ in range(3)]
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
            held = [r[whole:] for r in rows]
            if whole:
                left, right = flush(rows[0][:whole], rows[1][:whole].view(np.uint64), rows[2][:whole])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])
        if len(held[0]):
            left, right = flush(held[0], held[1].view(np.uint64), held[2])
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return run


def links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, few: int = FEW, apart: list[Column] | None = None) -> DataFrame:
    """distinct: fp, node (longs, each once); rows that differ in apart, columns of distinct, are never compared. Returns a, b: links between nodes that connect exactly those that a chain
    of fingerprints with at most budget differing bits connects (a spanning set, not all pairs)."""
    on_top = masks(budget, blocks_on_top(distinct.count(), budget, few))
    tops = F.explode(F.array(*[F.xxhash64(F.lit(i), *(apart or []), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(on_top)]))
    rows = distinct.select(tops.alias("top"), "fp", "node")
    large = checkpoint(rows.groupBy("top").count().filter(F.col("count") > chunk).withColumnRenamed("top", "large"))
    large = F.broadcast(large) if large.count() <= SMALL_ROWS else large
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = (
        rows.join(large, F.col("top") == F.col("large"), "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            F.when(F.col("parts") == 1, F.col("top"))
            .otherwise(F.xxhash64("top", F.least("own", "other"), F.greatest("own", "other")))
            .alias("top"),
            "fp",
            "node",
        )
    )
    return dealt.repartition("top").sortWithinPartitions("top", "fp").mapInArrow(_link_groups(budget), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest doc_id that a chain of links reaches, itself included).

    Documents without words have fingerprint zero and are linked like any other. Rows with a null doc_id get the
    component of their fingerprint, null if nothing else has it. Repeated rows stand as often as given; an empty table
    gives an empty one. Exact copies meet in a pre-aggregated table of distinct fingerprints, so they cost no pairs.
    """
    own = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(distinct.filter(F.col("node").isNotNull()), budget))
    named = checkpoint(
        distinct.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(
            F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id")
        )
    )
    return own.join(named, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "component_id")


def _texts(docs: DataFrame, shingle: int) -> DataFrame:
    """Distinct texts (as words, case aside) with an identity of their own: node, fps (its sketches) and
    first, the first row of the text by doc_id (rows without one come last) and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in few_rows(batches):
            texts = batch.column(3).to_pylist()
            words = [b" ".join(t.encode().lower().split()) for t in texts]
            keys = np.array([(d >> 64, d & (1 << 64) - 1) for d in map(xxhash.xxh3_128_intdigest, words)], np.uint64).reshape(-1, 2)
            found = np.array([sketches(t, shingle) for t in texts], np.uint64).reshape(-1, SKETCHES).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in (0, 1)]
            columns.append(pa.array(list(found), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "h1", "h2", "k1", "k2", "fps"])

    rows = docs.select(*_row(), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, h1 long, h2 long, k1 long, k2 long, fps array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2")).alias("first")
    distinct = rows.groupBy("k1", "k2").agg(F.min("fps").alias("fps"), first)
    return checkpoint(distinct.select(F.monotonically_increasing_id().alias("node"), "fps", "first"))


def _row() -> list[Column]:
    """What a row is named by: its id and text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h1"), F.xxhash64(F.lit(7), text_or_empty()).alias("h2")]


def _rows_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs joined with named (first and more): the rows that first names, with all columns of named in one, the last."""
    key, by = fresh(docs.columns, "_first", "_by")
    own = named.select(F.col("first").alias(key), F.struct(*named.columns).alias(by))
    own = F.broadcast(own) if own.count() <= SMALL_ROWS else own
    doc_id, h1, h2 = _row()
    first = F.col(key)
    return docs.join(own, (h1 == first["h1"]) & (h2 == first["h2"]) & doc_id.eqNullSafe(first["doc_id"])).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(by))


def _verify_groups(budget: int, shingle: int):
    def flush(prints: list[list[int]], nodes: list[int], texts: list[str]) -> Iterator[tuple[int, int]]:
        rows = [i for _, i in sorted(dict(zip(nodes, range(len(nodes)), strict=True)).items())]  # so that roots are least nodes
        known: dict[int, np.ndarray] = {}
        root = list(range(len(rows)))
        denied = np.zeros((len(rows), len(rows)), bool)

        def of(i: int) -> np.ndarray:
            if i not in known:
                known[i] = shingles(texts[rows[i]].encode().lower().split(), shingle)
            return known[i]

        def up(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def same(x: int, y: int) -> bool:
            """Whether a chain of links found so far, by any sketch, or a new one connects them."""
            a, b = up(x), up(y)
            if a == b:
                return True
            if denied[x, y]:
                return False
            if alike(of(x), of(y)):
                root[max(a, b)] = min(a, b)
                return True
            denied[x, y] = denied[y, x] = True
            return False

        for k in range(SKETCHES):
            order = sorted(range(len(rows)), key=lambda i: (prints[rows[i]][k] & (1 << 64) - 1, i))
            values = np.array([prints[rows[i]][k] & (1 << 64) - 1 for i in order], np.uint64)
            trie_links(values, budget, lambda x, y: same(order[x], order[y]))  # noqa: B023
        for i in range(len(rows)):
            if up(i) != i:
                yield nodes[rows[i]], nodes[rows[up(i)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        group, held = None, ([], [], [])

        def done() -> pa.RecordBatch:
            found = list(flush(*held))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in few_rows(batches):
            for at, fps, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != group and held[0]:
                    yield done()
                    held = ([], [], [])
                group = at
                for column, value in zip(held, (fps, node, text), strict=True):
                    column.append(value)
        if held[0]:
            yield done()

    return run


def verified_links(docs: DataFrame, texts: DataFrame, budget: int, shingle: int, chunk: int = TEXTS) -> DataFrame:
    """texts: of _texts(). Returns a, b: links that connect exactly those nodes that a chain of texts connects whose
    neighbours differ in at most budget bits of one sketch and are alike(). What chains of bits alone connect is only
    where links can be; each such group's texts are compared, in all pairs of its chunks if it is large."""
    sketched = texts.select("node", F.posexplode("fps").alias("which", "fp"))
    distinct = checkpoint(sketched.groupBy("which", "fp").agg(F.min("node").alias("node")))
    equal = sketched.join(distinct.withColumnRenamed("node", "least"), ["which", "fp"]).filter(F.col("node") != F.col("least"))
    near = links(distinct, budget, few=FEW * SKETCHES, apart=[F.col("which")])
    found = components(near.union(equal.select("node", "least")))
    groups = texts.join(found.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    groups = checkpoint(groups.select("node", "fps", "first", F.coalesce("component", "node").alias("group")))
    sizes = checkpoint(groups.groupBy("group").count().filter(F.col("count") > 1).withColumnRenamed("group", "sized"))
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL_ROWS else sizes
    parts = F.ceil(F.col("count") / chunk).cast("int")
    suspects = checkpoint(groups.join(sizes, F.col("group") == F.col("sized")).select("node", "fps", "first", "group", parts.alias("parts")))
    read = _rows_of(docs.select("doc_id", "text"), suspects)
    by = F.col(read.columns[-1])
    read = read.select(*[by[c].alias(f"_{c}") for c in ("node", "fps", "group", "parts")], text_or_empty().alias("text"))
    own = F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int")
    read = read.dropDuplicates(["_node"])  # rows may repeat
    dealt = read.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    top = F.struct("_group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).alias("top")
    dealt = dealt.select(top, "_fps", "_node", "text").repartition("top").sortWithinPartitions("top")
    flat = dealt.select(F.concat_ws("/", "top._group", "top.low", "top.high").alias("top"), "_fps", "_node", "text")
    return flat.mapInArrow(_verify_groups(budget, shingle), "a long, b long")


def keep_one(docs: DataFrame, budget: int = BUDGET_AT_08, shingle: int = SHINGLE_AT_08) -> DataFrame:
    """docs with one row of each component of near copies, the first by doc_id and then text hash; columns as given.

    Near copies are texts of which one of SKETCHES fingerprints differs in at most budget bits and whose sets of shingles have a Jaccard
    similarity of at least SIMILAR; texts with the same words are copies, and so are all texts without words. Rows are
    told apart by id and text, so those that share a doc_id but not the text have links of their own; rows without a
    doc_id come after those with one."""
    texts = _texts(docs, shingle)
    found = components(verified_links(docs, texts, budget, shingle))
    named = texts.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    stay = checkpoint(named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select("first"))
    doc_id, h1, h2 = _row()
    keys = fresh([*docs.columns, *fresh(docs.columns, "_by")], "_id", "_h1", "_h2")
    kept = _rows_of(docs, stay).withColumns(dict(zip(keys, (doc_id, h1, h2), strict=True))).dropDuplicates(keys)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
