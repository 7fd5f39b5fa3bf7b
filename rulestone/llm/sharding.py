"""Sharding along a Hilbert curve, by DataFrame functions alone.

Metadata dimensions are quantised to a few bits each, in the order of their values; a document's cell has an index on the
Hilbert curve through all cells. Documents are ordered by that index and the order is cut into runs of equal counts, so
each shard covers a compact region in every dimension and a reader can skip shards by the ranges of several columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_or_empty

#: Bits of each of the three dimensions: 2 ** 15 cells at most, whatever the input.
BITS, DIMENSIONS = 5, 3
#: Documents of one cell are numbered in parts of about so many rows; a cell has MOST_PARTS at most.
PART_ROWS, MOST_PARTS = 128, 8192


def curve_steps(dimensions: int) -> tuple[list[int], list[int]]:
    """For each state and corner (state * 2**dimensions + corner): the digit of the curve's index and the next state.
    A state is the corner at which the curve enters a cell and the axis along which it leaves, entry * dimensions +
    axis. Within a cell the corners follow a Gray code that is turned so as to begin and end there."""
    size, top = 1 << dimensions, (1 << dimensions) - 1

    def turn(x: int, by: int) -> int:
        by %= dimensions
        return (x << by | x >> (dimensions - by)) & top

    gray = [i ^ i >> 1 for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]

    def ones(i: int) -> int:
        """Trailing ones of i."""
        return (i ^ (i + 1)).bit_length() - 1

    axis = [0] + [ones(i - 1 if i % 2 == 0 else i) % dimensions for i in range(1, size)]
    digits, states = [], []
    for state in range(size * dimensions):
        at, along = divmod(state, dimensions)
        for corner in range(size):
            digit = place[turn(corner ^ at, -(along + 1))]
            digits.append(digit)
            states.append((at ^ turn(entry[digit], along + 1)) * dimensions + (along + axis[digit] + 1) % dimensions)
    return digits, states


def curve_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of integer coordinates in [0, 2**bits)."""
    n = len(coordinates)
    digits, states = (F.array(*map(F.lit, t)) for t in curve_steps(n))
    corners = [
        sum((F.shiftright(c, b).bitwiseAND(1) * (1 << k) for k, c in enumerate(coordinates)), F.lit(0)) for b in reversed(range(bits))
    ]

    def step(state: Column, corner: Column) -> Column:
        at = (state["state"] * (1 << n) + corner).cast("int")
        return F.struct((state["index"] * (1 << n) + F.get(digits, at)).cast("long").alias("index"), F.get(states, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*[c.cast("int") for c in corners]), start, step, lambda s: s["index"])


def dimensions_of() -> dict[str, Column]:
    """What documents are ordered by, as values that sort; nulls are values too and come first."""
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "n_chars": F.coalesce(F.col("n_chars").cast("long"), F.lit(-1).cast("long")),
    }


def cuts(docs: DataFrame, bits: int = BITS) -> dict[str, tuple[list, list[int]]]:
    """For each dimension, in order, the least values of its steps but the first, and all steps: numbers in [0, 2**bits),
    of which each stands for about an equal share of all rows. A value of very many rows is a step of its own; few values
    are spread over all steps. At most 2**bits of each come to the driver, whatever the input.

    Rows are pre-aggregated to counts by value; values are sorted by ranges and their counts are added up within each
    range, so neither a common value nor many different ones meet in one task."""
    steps, found = 1 << bits, {}
    for name, column in dimensions_of().items():
        counted = docs.groupBy(column.alias("value")).agg(F.count("*").alias("n"))
        ranged = checkpoint(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = ranged.groupBy("part").agg(F.sum("n").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
        total = ranged.agg(F.sum("n")).first()[0] or 1
        within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.join(F.broadcast(parts), "part").select("value", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("from"))
        # a value stands where its middle row does; a row for each partition of the shuffle is all that is broadcast
        step = F.least(F.floor((F.col("from") + F.col("n") / 2) * steps / total), F.lit(steps - 1)).cast("int")
        firsts = placed.groupBy(step.alias("step")).agg(F.min("value").alias("value")).orderBy("step").collect()
        found[name] = [r.value for r in firsts[1:]], [r.step for r in firsts] or [0]
    return found


def coordinates(at: dict[str, tuple[list, list[int]]]) -> list[Column]:
    """Steps of a document's values by cuts()."""

    def step(name: str, value: Column) -> Column:
        least, steps = at[name]
        each = F.array(*map(F.lit, least)).cast("array<long>" if name == "n_chars" else "array<string>")
        return F.get(F.array(*map(F.lit, steps)), F.size(F.filter(each, lambda v: v <= value)))

    return [step(name, value) for name, value in dimensions_of().items()]


def assign(docs: DataFrame, shards: int = 8, *, whole: bool = False) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text, plus 1), text_crc32, cell, shard, slot (0, 1, ... in each
    shard along the curve). Counts of shards differ by one at most. whole: also row, the document as it was given.

    A null text is empty; nulls in the dimensions are values of their own, before all others; repeated rows each get a
    slot; documents of one cell stand in an order of their own, which is the same for the same files read in the same
    pieces; very long texts count by their bytes alone; other columns are not looked at; an empty table gives none.

    Without whole, texts are read once and not shuffled. A cell of many documents, alike or not, is dealt out in even
    parts, and numbers are added up from counts: those of cells (at most 2**15) in one small task, those of parts (at
    most MOST_PARTS) per cell.
    """
    text = text_or_empty()
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    own = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        curve_index(coordinates(cuts(docs))).alias("cell"),
        F.monotonically_increasing_id().alias("tie"),
        *row,
    )
    rows = checkpoint(own)
    total = rows.count()
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(MOST_PARTS))
    cells = cells.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_from"), parts.alias("parts"))
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("tie"), F.col("parts")))
    within = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("cell", "part").agg(F.count("*").alias("n"))
    counted = counted.select("cell", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("part_from"))
    order = Window.partitionBy("cell", "part").orderBy("tie")
    rank = (F.col("cell_from") + F.col("part_from") + F.row_number().over(order) - 1).cast("long")
    # shard k begins at the first rank that is not below k * total / shards
    return (
        dealt.join(counted, ["cell", "part"])
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"rank - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "cell", "shard", "slot", *(["row"] if whole else []))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents as Parquet, a folder for each shard (its column is `shard`, or `_shard` if documents have one), in
    order of the curve within each file. Each row is carried along, so rows without an id and repeated ones are kept as
    they are."""
    placed = assign(docs, shards, whole=True)
    at, slot = "_shard" if "shard" in docs.columns else "shard", f"_slot_{uuid.uuid4().hex}"
    rows = placed.select(F.col("shard").alias(at), F.col("slot").alias(slot), *[F.col("row")[c].alias(c) for c in docs.columns])
    rows.repartitionByRange(at, slot).sortWithinPartitions(at, slot).drop(slot).write.partitionBy(at).parquet(path)
