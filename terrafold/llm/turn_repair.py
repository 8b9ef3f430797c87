"""Conversation structure repair (operator 11): the cheapest edits that make a conversation s?(ua)+, or empty.

Each row has a kind: its role's initial and its fault. In one of four grammar states (nothing yet, after the system turn,
after a user turn, after an assistant turn) a row is kept, given the role that the state waits for, or deleted, and turns
with an empty text may be inserted before it. The cost to go is worked out backwards over rows and states; then a walk
forwards takes, of the edits that are tight (their cost and the cost to go after them add up), the one whose initial is
least in ASCII. Every letter leads to one state, so the walk's letters are the least string of all cheapest ones. The turns are rebuilt from the walk and
hashed.

Scale: rows are sorted by a range partitioning, so that a conversation that holds a third of all rows lies in many
partitions; blocks of at most BLOCK neighbours of one conversation are the unit of work. A block is a min-plus matrix over
the four states; one pass backwards over the matrices of a conversation gives the cost to go behind each block, one pass
forwards over the blocks' maps of states gives the state before each, and each block then walks on its own. A task that passes over blocks holds
one of them at a time. The hash of a conversation is one chain, so its texts, and its audit, which is one value of the
result, pass in order through one task, a batch of rows at a time.

Defined results: a null role, text, id or turn is one space where it becomes text (so that a null text is blank and a null
role cannot be kept); an empty role, or one with another initial than s, u or a, cannot be kept either; rows of one turn go by role, then text; a null conv_id is a
conversation of its own; rows that repeat are duplicates; texts of any length are hashed whole; an empty table gives no rows; other columns are kept
aside (ignored).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from terrafold.llm.common import materialize, need

BLOCK = 4096
INK = r"[^\x20\x09-\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; the state that the awaited role (u, u, a, u) leads to.
NEXT = (2, 2, 3, 2)
#: Cost behind the last row: what is missing is inserted.
END = (0, 2 * INSERT, INSERT, 0)


def damage(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the crc32 of `conv_id:turn`: a twentieth of the rows each is dropped,
    emptied, loses its sentence ends, is repeated or becomes a user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = need(messages, "conv_id", "turn", "role", "text").withColumn("_hit", hit).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(text_of("role"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _conv(column: str) -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, at (place in the order of all rows), block, initial, in a written table."""
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # the number tells rows apart that repeat each other, so that many of them can lie in several partitions
    keyed = rows.select(_conv("conv_id").alias("conv"), "turn", "role", "text").withColumn("_n", F.monotonically_increasing_id())
    keys = ["conv", "turn", "role", "text", "_n"]
    dealt = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_n").withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("initial", F.substring("role", 1, 1))
    return materialize(dealt, "repair-rows")


def faulted(rows: DataFrame) -> DataFrame:
    """conv, turn, at, block, initial, fault: blank, duplicate, truncated or null, the first that applies."""
    known = rows.select(
        "conv", "turn", "at", "block", "initial",
        (~F.col("text").rlike(INK)).alias("_blank"),
        F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z").alias("_open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("_said"),
    )
    # the first row that says something is joined by its place, of which each row has one of its own
    firsts = known.groupBy("conv", "_said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    known = known.join(firsts, "at", "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_open"), "truncated")
    return known.select("conv", "turn", "at", "block", "initial", fault.alias("fault"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row for each conversation and block: at (its first row's), kinds (a letter a row: s, u, a, o for other roles, in
    capitals if truncated; x: has to go), illegal (pairs of neighbours, the pair with the block before included), part, parts."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    each = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("at", "initial", kind.alias("kind")))).alias("rows"))
    legal = ("su", "ua", "au")
    n = F.size("rows")
    pairs = F.zip_with(F.slice("rows", 1, n - 1), F.slice("rows", 2, n - 1), lambda a, b: F.concat(a["initial"], b["initial"]).isin(*legal))
    in_order = Window.partitionBy("conv").orderBy("block")
    before = F.lag("last").over(in_order)
    each = each.select(
        "conv", "block", F.col("rows")[0]["at"].alias("at"), F.array_join(F.transform("rows", lambda x: x["kind"]), "").alias("kinds"),
        F.size(F.filter(pairs, lambda ok: ~ok)).alias("inside"), F.col("rows")[0]["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"),
    )
    across = F.when(before.isNotNull() & ~F.concat(before, F.col("first")).isin(*legal), 1).otherwise(0)
    return each.select(
        "conv", "block", "at", "kinds", (F.col("inside") + across).cast("long").alias("illegal"),
        F.row_number().over(in_order).alias("part"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("parts"),
    )


@lru_cache(maxsize=None)
def moves(kind: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, state after the row, cost) of each edit of a row of that kind, but for insertions, least letter first."""
    out = [("D", state, DELETE)]
    if kind != "x":
        more, role = TRUNCATED * kind.isupper(), kind.lower()
        if role == "s" and state == 0:
            out.append(("K", 1, more))
        elif role == ("a" if state == 2 else "u"):
            out.append(("K", NEXT[state], more))
        out.append(("R", NEXT[state], REROLE + more))
    return tuple(out)


@lru_cache(maxsize=65536)
def _back(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before a row, insertions before it included, from the cost to go after it."""
    v = [min(cost + after[to] for _, to, cost in moves(kind, g)) for g in range(4)]
    for _ in range(2):  # u and a may be inserted in turn; more than both never pays
        v = [min(v[g], INSERT + v[NEXT[g]]) for g in range(4)]
    return tuple(v)


@lru_cache(maxsize=None)
def _step(kind: str) -> np.ndarray:
    """The row as a min-plus matrix: cost from each state before it to each state behind it."""
    unit = [tuple(0 if g == to else FAR for g in range(4)) for to in range(4)]
    return np.array([_back(kind, u) for u in unit], dtype=np.int64).T


def costs(kinds: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost to go before each row of a block and, last, behind it."""
    out = [after]
    for kind in reversed(kinds):
        least = min(out[-1])  # costs relative to the least one recur, so that the table of steps stays small
        out.append(tuple(x + least for x in _back(kind, tuple(min(x - least, FAR) for x in out[-1]))))
    return out[::-1]


def walk(kinds: str, go: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[str], int]:
    """For each row the insertions before it (u, a) and its edit (D, K, U, A: the new role); the state behind the block.

    The last block of a conversation has what is inserted behind the last row with that row's edits."""
    edits: list[str] = []
    for i, kind in enumerate(kinds):
        done = ""
        while True:
            now = go[i][state]
            tight = [(x, to) for x, to, cost in moves(kind, state) if cost + go[i + 1][to] == now]
            if INSERT + go[i][NEXT[state]] == now:
                tight.append(("I", NEXT[state]))
            letter, to = min(tight)
            if letter == "I":
                done += "a" if state == 2 else "u"
                state = to
                continue
            done += ("A" if state == 2 else "U") if letter == "R" else letter
            state = to
            break
        edits.append(done)
    while last and go[-1][state] > 0:
        edits[-1] += "a" if state == 2 else "u"
        state = NEXT[state]
    return edits, state


@F.pandas_udf(ArrayType(LongType()))
def _matrix(kinds: pd.Series) -> pd.Series:
    def one(x: str | None) -> list[int] | None:
        if x is None:
            return None
        m = np.where(np.eye(4, dtype=bool), 0, FAR)
        for kind in x:
            m = np.minimum((m[:, :, None] + _step(kind)[None]).min(axis=1), FAR)
        return m.ravel().tolist()

    return kinds.map(one)


@F.pandas_udf(ArrayType(IntegerType()))
def _exits(kinds: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else [walk(k, go, g, False)[1] for g in range(4)] for k, go in ((k, k and costs(k, tuple(map(int, v)))) for k, v in zip(kinds, after))], dtype=object)


_EDITS = StructType([StructField("edits", ArrayType(StringType())), StructField("cost", LongType())])


@F.pandas_udf(_EDITS)
def _edits(kinds: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series) -> pd.DataFrame:
    out = []
    for k, v, g, is_last in zip(kinds, after, state, last):
        go = costs(k, tuple(map(int, v)))
        out.append((walk(k, go, int(g), bool(is_last))[0], go[0][int(g)]))
    return pd.DataFrame(out, columns=["edits", "cost"])


def _behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each conversation from the last to the first: the cost to go behind each."""
    v: np.ndarray | None = None
    for batch in batches:
        found = []
        for part, parts, matrix in zip(batch["part"], batch["parts"], batch["matrix"]):
            if part == parts:
                v = np.array(END, dtype=np.int64)
            found.append(v.tolist())
            if matrix is not None:
                v = (np.asarray(matrix, dtype=np.int64).reshape(4, 4) + v[None]).min(axis=1)
        batch["after"] = found
        yield batch.drop(columns="matrix")


def _before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each conversation from the first to the last: the state before each."""
    state = 0
    for batch in batches:
        found = []
        for part, exits in zip(batch["part"], batch["exits"]):
            state = 0 if part == 1 else state
            found.append(state)
            state = state if exits is None else int(exits[state])
        batch["state"] = found
        yield batch.drop(columns="exits")


def solve(blocks: DataFrame) -> DataFrame:
    """blocks with edits (a string for each row) and cost (from this block on)."""
    plain = "conv string, block long, at long, kinds string, illegal long, part int, parts long"
    first, last = F.col("part") == 1, F.col("part") == F.col("parts")
    back = blocks.withColumn("matrix", _matrix(F.when(~first, F.col("kinds")))).repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    back = back.mapInPandas(_behind, f"{plain}, after array<long>")
    on = back.withColumn("exits", _exits(F.when(~last, F.col("kinds")), F.col("after"))).repartition("conv").sortWithinPartitions("conv", "block")
    on = on.mapInPandas(_before, f"{plain}, after array<long>, state int")
    return on.withColumn("_found", _edits("kinds", "after", "state", last)).select("conv", "block", "at", "illegal", "part", "parts", "_found.edits", "_found.cost")


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of a block, then its rows, in order: a conversation's audit and the hash of its rebuilt turns."""
    conv, pieces, digest, begun, edits = None, [], None, False, iter(())
    audit = str.maketrans("uaUA", "IIRR")
    names = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
    done: list[tuple[str, str, str]] = []
    for batch in batches:
        for key, own, role, text in zip(batch["conv"], batch["edits"], batch["role"], batch["text"]):
            if key != conv:
                if conv is not None:
                    done.append((conv, "".join(pieces), digest.hexdigest()))
                conv, pieces, digest, begun = key, [], hashlib.sha256(), False
            if own is not None:
                edits = iter(own)
                pieces.append("".join(own).translate(audit))
                continue
            for x in next(edits):
                if x == "D":
                    continue
                digest.update((("\n" if begun else "") + (f"{names[x]}:" if x in "ua" else f"{names.get(x, role)}:{text}")).encode())
                begun = True
        yield pd.DataFrame(done, columns=["conv", "audit", "repaired_sha256"])
        done = []
    if conv is not None:
        yield pd.DataFrame([(conv, "".join(pieces), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])


def repair(messages: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of messages: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    damaged: the rows to repair (conv_id, turn, role, text without nulls in role and text); messages themselves after
    damage() if not given. A conversation without rows there has zeros, an empty audit and the hash of an empty string."""
    rows = ordered(damage(messages) if damaged is None else damaged)
    known = materialize(faulted(rows), "repair-faults")
    count = lambda name: F.sum((F.col("fault").eqNullSafe(name)).cast("long")).alias(name)
    facts = known.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"),
    )
    solved = materialize(solve(blocks_of(known)), "repair-edits")
    # the cost to go from a conversation's first block is the cost of all
    sums = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    marks = solved.select("conv", "at", F.lit(0).alias("own"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv", "at", F.lit(1).alias("own"), F.lit(None).cast("array<string>").alias("edits"), "role", "text")
    stream = marks.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "at", "own").select("conv", "edits", "role", "text")
    built = stream.mapInPandas(_rebuilt, "conv string, audit string, repaired_sha256 string")
    found = facts.join(sums, "conv").join(built, "conv")
    all_ = messages.select("conv_id").distinct().withColumn("conv", _conv("conv_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_.join(found, "conv", "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
