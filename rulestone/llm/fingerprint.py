"""Canonical exact digests, by DataFrame functions alone.

A text is normalised (Unicode NFKC), case-folded, and its white space is folded to single spaces; two 64-bit xxhashes of
that form are its digest. Where several documents share a digest their canonical forms are compared byte by byte; forms
that differ get digests of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_or_empty

#: Neighbouring documents meet in ranges of about so many, of which there are at most MOST (and as many pieces of ids that
#: very many rows share); ranges begin between CUTS quantiles of the ids.
RANGE_ROWS, MOST, CUTS = 256, 1 << 16, 1024
#: An id, or an id and text, is heavy if at least this share of all rows have it.
HEAVY = 1 / 512
SMALL_ROWS = 200_000


def canonical(text: Column) -> Column:
    def composed(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(text: Column) -> Column:
    """32 hex digits: XXH64 with seed 42, and that of the same bytes with another seed."""
    halves = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def digests(docs: DataFrame, wide: Callable[[Column], Column] = wide_hash, first: bool = False) -> DataFrame:
    """Canonical forms whose digest another form has too, by byte comparison within equal digests: wide, canon, variant
    (2, 3, ...; the least form keeps the bare digest, and these are returned with first). It is empty unless the hash
    collides."""
    forms = docs.select(canonical(text_or_empty()).alias("canon")).withColumn("wide", wide(F.col("canon")))
    several = checkpoint(forms.groupBy("wide").count().filter(F.col("count") > 1).select(F.col("wide").alias("of")))
    several = F.broadcast(several) if several.count() <= SMALL_ROWS else several
    # copies collapse before the shuffle: a group of equal forms is one row for each task
    each = forms.join(several, F.col("wide") == F.col("of"), "left_semi").groupBy("wide", "canon").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("wide").orderBy("canon"))
    return each.withColumn("variant", rank).filter(F.col("variant") == 1 if first else F.col("variant") > 1).select("wide", "canon", "variant")


def _steps_up_to(cuts: list[int], value: Column, width: int = 32) -> Column:
    """How many of the sorted cuts are at most value: by blocks of so many cuts, then within one."""
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    starts = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")
    block = F.size(F.filter(starts, lambda c: c <= value))
    own = F.get(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), block - 1)
    return F.when(block < 1, 0).otherwise((block - 1) * width + F.size(F.filter(own, lambda c: c <= value)))


def _collapsed(rows: DataFrame, ids: list, n: int) -> DataFrame:
    """rows (doc_id, text, tie) with times: rows of a heavy id that share its text, which no order could split, are few
    rows that stand for RANGE_ROWS or so each."""
    of_heavy = F.lit(False)
    for i in ids:
        of_heavy = of_heavy | F.col("doc_id").eqNullSafe(F.lit(i).cast("long"))
    alike = rows.filter(of_heavy).groupBy("doc_id", "tie").count().filter(F.col("count") >= max(RANGE_ROWS, int(n * HEAVY))).collect() if ids else []
    if not alike:
        return rows.withColumn("times", F.lit(1).cast("long"))
    several = of_heavy & F.col("tie").isin([r.tie for r in alike])
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(-(-max(r["count"] for r in alike) // RANGE_ROWS)))
    merged = rows.filter(several).groupBy("doc_id", "text", "tie", salt.alias("salt")).agg(F.count("*").alias("times")).drop("salt")
    return rows.filter(~several).withColumn("times", F.lit(1).cast("long")).unionByName(merged)


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, canon (its canonical form), following and next_canon (of the next document by doc_id, after the last
    the first). Nulls come first; ties are ordered by a hash of the text.

    Documents are shuffled once, into ranges of ids; the first of each range also goes to the range before, so that each
    range holds the successor of its last one. Ranges begin at quantiles of the ids and are divided evenly between two of
    them; an id that very many rows share (none is one too) is a range of its own, divided by the hash of the text. The
    table of ranges has at most twice 2**16 rows; beyond some 17 million documents ranges grow with the corpus, and a
    range is sorted, which spills, and read in order one row ahead."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tie"))
    ids = rows.select("doc_id")
    fine = [i / CUTS for i in range(CUTS + 1)]
    n, quantiles = ids.agg(F.count("*"), F.percentile_approx("doc_id", fine, 20_000)).first()
    heavy = {r.doc_id: r["count"] for r in ids.groupBy("doc_id").count().filter(F.col("count") >= max(RANGE_ROWS, int(n * HEAVY))).collect()}
    own_range = [c for i in heavy if i is not None for c in (i, min(i + 1, (1 << 63) - 1))]
    cuts = sorted({*(quantiles or [0]), *own_range})
    per_cut = max(1, min(MOST // (len(cuts) + 1), -(-n // (RANGE_ROWS * len(cuts)))))
    known = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    low, high = (F.get(known, i).cast("double") for i in (F.col("cut") - 1, F.col("cut")))
    share = (F.col("doc_id").cast("double") - low) / (high - low)
    fine_part = F.when((F.col("cut") < 1) | high.isNull(), 0).otherwise(F.least(F.floor(share * per_cut), F.lit(per_cut - 1)))
    ranged = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("cut") * per_cut + fine_part).cast("long")
    piece = F.lit(0)
    for i, count in heavy.items():
        pieces = max(1, min(count // RANGE_ROWS, int(MOST * count / n)))
        place = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * pieces)
        piece = F.when(F.col("doc_id").eqNullSafe(F.lit(i).cast("long")), F.least(place, F.lit(pieces - 1)).cast("int")).otherwise(piece)

    def in_range(df: DataFrame) -> DataFrame:
        return df.withColumn("cut", _steps_up_to(cuts, F.col("doc_id"))).withColumn("range", F.struct(ranged.alias("of"), piece.alias("piece"))).drop("cut")

    by_range = Window.orderBy("range")
    firsts = in_range(rows.select("doc_id", "tie")).groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    firsts = firsts.select(
        "range",
        "first",
        F.coalesce(F.lag("range").over(by_range), F.max("range").over(Window.partitionBy())).alias("previous"),
    )
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))
    other = F.struct(F.col("previous").alias("range"), F.lit(1).alias("copy"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    slots = F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own)))
    meet = Window.partitionBy("slot.range").orderBy("slot.copy", F.col("doc_id").asc_nulls_first(), "tie", "text")
    met = (
        in_range(_collapsed(rows, list(heavy), n))
        .join(F.broadcast(firsts), "range")
        .select("doc_id", "tie", "times", slots.alias("slot"), "text")
        .repartition("slot.range")
        # once for each text, and carried over to the one before
        .withColumn("canon", canonical(F.col("text")))
        .withColumn("following", F.lead("text").over(meet))
        .withColumn("next_canon", F.lead("canon").over(meet))
        .filter(F.col("slot.copy") == 0)
    )
    each = met.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    last = F.col("time") == F.col("times")
    return each.select(
        "doc_id", "text", "canon", F.when(last, F.col("following")).otherwise(F.col("text")).alias("following"), F.when(last, F.col("next_canon")).otherwise(F.col("canon")).alias("next_canon")
    )


def fingerprints(docs: DataFrame, wide: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text has its last half (rounded down) replaced by the first as many code points of the next document by doc_id.
    Exact digests are alike or not, so likeness is 1 or 0, and 1 only if the canonical forms are equal byte by byte.

    A null text is empty; a document on its own is its own successor; repeated rows stand as often as given, and rows
    that share a doc_id follow each other by a hash of the text; a very long text is one row, whose canonical form is made
    as a whole; where forms of documents share a digest, an edited form that equals none of them gets -0 behind it; other
    columns are not looked at; an empty table gives an empty one.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - half))"), F.expr("substring(following, 1, half)"))
    rows = (
        _neighbours(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("half", half)
        .select("doc_id", "n_chars", "canon", "next_canon", edited.alias("edited"))
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "canon", canonical(F.col("edited")).alias("edited_canon"), "next_canon")
    )
    variants = checkpoint(digests(docs, wide))
    if variants.limit(1).count():  # two forms share a digest: whole forms are looked up
        forms = variants.select(F.concat_ws("-", "wide", "variant").alias("own"), F.col("canon").alias("form"))
        rows = rows.join(forms, F.col("canon") == F.col("form"), "left").drop("form")
        forms = forms.withColumnRenamed("own", "edited_own")
        rows = rows.join(forms, F.col("edited_canon") == F.col("form"), "left").drop("form")
        # the bare digest is that of the least form alone
        least = digests(docs, wide, first=True).select(F.col("wide").alias("of"), F.col("canon").alias("least"))
        rows = rows.withColumn("edited_wide", wide(F.col("edited_canon"))).join(least, F.col("edited_wide") == F.col("of"), "left")
        bare = F.when(F.col("least").isNull() | (F.col("least") == F.col("edited_canon")), F.col("edited_wide")).otherwise(F.concat("edited_wide", F.lit("-0")))
        fingerprint, other = F.coalesce("own", wide(F.col("canon"))), F.coalesce("edited_own", bare)
    else:
        fingerprint, other = wide(F.col("canon")), wide(F.col("edited_canon"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.alias("fingerprint"),
        other.alias("edited_fingerprint"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    )
