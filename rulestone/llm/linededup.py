"""Removing repeated passages by overlapping three-line windows, with DataFrame functions alone.

Every three consecutive lines are hashed. A window that occurs again anywhere is kept where it occurs first, in the order
of doc_id, text (by its hash) and position; the lines that later occurrences cover are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, text_or_empty

WINDOW = 3
_BLANK = " \t\r\x0b\f"


def _lines() -> Column:
    return F.split(text_or_empty(), "\n", -1)


def _solid(lines: Column) -> Column:
    """at (place in lines), a and b (two hashes) of the lines that hold more than white space, without that around."""
    numbered = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(_BLANK)).alias("line")))
    solid = F.filter(numbered, lambda s: s["line"] != "")
    return F.transform(solid, lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["line"]).alias("a"), F.xxhash64(F.lit(7), s["line"]).alias("b")))


def _document() -> list[Column]:
    """What a decision is keyed by: rows alike in id and text are one document."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash")]


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, at (number among the document's solid lines), covers (places of its lines), h1 and h2 (two
    64-bit hashes of them), and place, which orders all windows by doc_id, text_hash and position; nulls come first."""
    each = docs.select(*_document(), _solid(_lines()).alias("solid"))

    def window(i: Column) -> Column:
        own = [F.get("solid", i + k) for k in range(width)]
        return F.struct(
            F.array(*[s["at"] for s in own]).alias("covers"), F.xxhash64(*[s["a"] for s in own]).alias("h1"), F.xxhash64(*[s["b"] for s in own]).alias("h2")
        )

    # without a filter, which would be pushed below the projection and hash all lines again
    slid = F.when(F.size("solid") >= width, F.transform(F.sequence(F.lit(0), F.size("solid") - width), window))
    return (
        each.select("doc_id", "text_hash", F.posexplode(slid).alias("at", "w"))
        .select("doc_id", "text_hash", "at", "w.covers", "w.h1", "w.h2")
        .withColumn("place", F.struct("doc_id", "text_hash", "at"))
    )


def removals(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, gone (places among the document's lines; may repeat)."""
    every = windows(docs, width)
    repeated = checkpoint(
        every.groupBy("h1", "h2")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gap = F.col("at") - F.col("first.at")
    # an occurrence that overlaps the first one, in the same document, spares that one's lines
    spared = F.when(own & (gap < width), F.lit(width) - gap).otherwise(0)
    later = every.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).filter(~(own & (gap == 0)))
    covered = F.slice("covers", spared + 1, F.lit(width))
    # rows alike in id and text have the same windows, each of which is gathered once, before the shuffle already
    return later.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set(covered)).alias("gone"))


def drop_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with text cut down to the lines that stay, and n_lines and n_removed. Documents of which nothing stays keep
    an empty text.

    Lines are compared without white space around them; lines of white space alone are never part of a window and stay.
    A text of fewer solid lines than a window stays as it is, and so do null and empty texts. Rows alike in id and text
    count as one document; a null doc_id comes before all others. A very long text has as many windows as lines, which are
    dealt out by hash, and is cut as a whole where it stands. Other columns are passed on, but for any named n_lines or
    n_removed; an empty table gives an empty one.

    Windows of all texts are shuffled as hashes; first occurrences are pre-aggregated, so a passage that a third of all
    documents share is one row for each task; texts are shuffled once, to meet what is removed from them.
    """
    of_id, of_hash, gone, lost, lines = fresh(docs.columns, "_of_id", "_of_hash", "_gone", "_lost", "_lines")
    found = removals(docs, width).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("gone").alias(gone))
    doc_id, text_hash = _document()
    text = text_or_empty()
    joined = docs.join(found, doc_id.eqNullSafe(F.col(of_id)) & (text_hash == F.col(of_hash)), "left")
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    kept = F.array_join(F.transform(staying, lambda i: F.get(F.col(lines), i)), "\n")
    cut = F.when(F.size(lost) == F.size(lines), "").otherwise(kept)
    cut = F.when(F.col(lost).isNull(), F.col("text")).otherwise(cut)
    return (
        joined.withColumn(lost, F.array_distinct(gone))
        .withColumn(lines, F.when(F.col(lost).isNotNull(), _lines()))
        .select(
            *[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
            F.coalesce(F.size(lost), F.lit(0)).alias("n_removed"),
        )
    )


def cut_documents(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """drop_repeats() with the columns of docs alone; n_chars, where it is one, becomes that of the text that is left.
    Documents of which nothing is left go; those that were empty before stay."""
    cut = drop_repeats(docs, width).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    own = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return cut.withColumns({c: v for c, v in own.items() if c in docs.columns}).select(*docs.columns)


#: DuckDB SQL for drop_repeats() over documents: doc_id, n_lines, n_removed, text. Assumes ids are unique.
SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ln
  FROM documents
), solid AS (
  SELECT doc_id, ln, s, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS p
  FROM (SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM line) WHERE s <> ''
), three AS (
  SELECT doc_id, p, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS w3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), named AS (
  SELECT doc_id, p, first_value(doc_id) OVER f AS first_doc, first_value(p) OVER f AS first_p
  FROM three WHERE w3 IS NOT NULL WINDOW f AS (PARTITION BY w3 ORDER BY doc_id, p)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(p, first_p + 3) ELSE p END, p + 3)) AS p
  FROM named WHERE doc_id <> first_doc OR p <> first_p
), lost AS (
  SELECT doc_id, ln FROM gone JOIN solid USING (doc_id, p)
), stay AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS kept FROM line ANTI JOIN lost USING (doc_id, ln) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS INTEGER) AS n_lines,
       CAST(coalesce(l.n, 0) AS INTEGER) AS n_removed,
       CASE WHEN l.n IS NULL THEN d.text ELSE coalesce(s.kept, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id) l USING (doc_id) LEFT JOIN stay s USING (doc_id)
"""
