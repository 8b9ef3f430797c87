"""Exact de-duplication by distributed most-significant-digit radix partitioning (operator 8).

Texts are compared after deleting white space, byte by byte, never by a digest. Rows start in groups by length (a
row's end is the first digit: equal texts end together). Each round splits every group that still has two rows or
more by the next run of bytes, in one hash aggregation over (group, bytes) with map-side combination; a new group is
named by its least row number. Rows alone in their group leave. Groups whose text has ended are classes of equal
texts. Runs grow from round to round, so the number of rounds follows the logarithm of the longest text, and a row
that shares nothing leaves after its first bytes.

What moves: texts are read once for a table of lengths and first bytes, on which the first round works; further bytes
are fetched of rows with company alone, by their row numbers (a list that is broadcast below `BROADCAST_ROWS`, and joined
by key beyond, which moves texts). A group of copies that holds a third of all rows meets only in the aggregation, where
each task sends one row for it, and in a join of its rows with that one row, which adaptive execution splits.

Defined results: null counts as empty; texts of nothing but white space are equal; texts are compared whole, however
long; ties of the number of code points go to the smallest id; ids that repeat are separate rows (each is its own row of
the result); an empty table gives no rows; other columns, whatever their names, are ignored (or kept by drop_copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import SPACE_CHARS, discard, materialize, need, with_row

FIRST_RUN = 48
GROWTH = 32
BROADCAST_ROWS = 500_000


def normalized(text: Column) -> Column:
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def _split(live: DataFrame, digit: Column, rest: list[Column]) -> DataFrame:
    """live: row, group, n and more. Rows whose digit another row of their group has: row, the new group, n and `rest`."""
    keyed = live.select("row", F.struct("group", digit.alias("digit")).alias("key"), "n", *rest)
    found = keyed.groupBy("key").agg(F.min("row").alias("group"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return keyed.join(found.select("key", "group"), "key").drop("key")


def split_groups(rows: DataFrame, heads: DataFrame | None = None, first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """rows: (row long unique, bytes binary). Returns (row, group) of rows that equal another one; group is its class's
    least row. heads: a table (row, n, head) of their lengths and first `first_run` bytes, where the caller has one."""
    if heads is None:
        heads = rows.select("row", F.length("bytes").alias("n"), F.substring("bytes", 1, first_run).alias("head"))
    # one run of bytes; the pair (group, digit) decides, and every row of a group has the same length
    kept = materialize(_split(heads.withColumn("group", F.col("n").cast("long")), F.col("head"), []), "radix-heads")
    parts = [kept.where(F.col("n") <= first_run).select("row", "group")]
    longer = kept.where(F.col("n") > first_run)
    at, run = first_run, first_run * growth
    if longer.isEmpty():
        return parts[0]
    wanted = longer.select("row", "group", "n")
    wanted = F.broadcast(wanted) if longer.count() <= BROADCAST_ROWS else wanted
    live = materialize(rows.join(wanted, "row").select("row", "group", "n", F.substring("bytes", first_run + 1, 2_147_483_647).alias("bytes")), "radix-live")
    while True:
        # bytes are what is left of a text from position `at` on
        kept = _split(live, F.substring("bytes", 1, run), [F.when(F.col("n") > at + run, F.expr(f"substring(bytes, {run + 1})")).alias("bytes")])
        kept = materialize(kept, "radix-round")
        discard(live)
        at, run = at + run, run * growth
        parts.append(kept.where(F.col("n") <= at).select("row", "group"))
        live = kept
        if kept.where(F.col("n") > at).isEmpty():
            break
        live = materialize(kept.where(F.col("n") > at), "radix-live")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _facts(numbered: DataFrame, row_col: str, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """numbered: docs with row_col, a number that tells rows apart. One row each: row, doc_id, n_points, n, head and more;
    the table of what the rest needs of a text, but for the bytes of rows with company."""
    data = F.encode(normalized(F.col(text_col)), "utf-8")
    points = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return materialize(numbered.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), points.alias("n_points"), F.length(data).alias("n"), F.substring(data, 1, FIRST_RUN).alias("head"), *more), "radix-facts")


def _marks(facts: DataFrame, numbered: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """Of rows that equal another one: row, keep_id, size, and first (whether it stays)."""
    bytes_ = numbered.select(F.col(row_col).alias("row"), F.encode(normalized(F.col(text_col)), "utf-8").alias("bytes"))
    groups = materialize(split_groups(bytes_, facts.select("row", "n", "head")), "radix-groups")
    members = materialize(facts.select("row", "doc_id", "n_points").join(groups, "row"), "radix-members")
    discard(groups)
    first = F.struct((-F.col("n_points")).alias("a"), "doc_id", "row")
    classes = members.groupBy("group").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("size"))
    return members.join(classes, "group").select("row", F.col("best.doc_id").alias("keep_id"), "size", (F.col("best.row") == F.col("row")).alias("first"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the row that stays of its class: the most code points, then the
    smallest id), group_size, kept, text_sha256 of the text without white space."""
    numbered, row, _ = with_row(need(docs, id_col, text_col), id_col, "radix-rows")
    facts = _facts(numbered, row, id_col, text_col, F.sha2(F.encode(normalized(F.col(text_col)), "utf-8"), 256).alias("text_sha256"))
    marks = _marks(facts, numbered, row, text_col)
    return facts.select("row", "doc_id", "text_sha256").join(marks, "row", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("first", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    numbered, row, _ = with_row(docs, id_col, "radix-rows")
    facts = _facts(numbered, row, id_col, text_col)
    gone = materialize(_marks(facts, numbered, row, text_col).where(~F.col("first")).select(F.col("row").alias(row)), "radix-dropped")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
