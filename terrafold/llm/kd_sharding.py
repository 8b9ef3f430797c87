"""Sharding by a k-d tree over metadata (operator 4). Law: `bytes`, sizes near equal.

The unit that is placed is a group of equal texts, with the metadata of its row with the smallest id. Cells are split
recursively: along the dimension in which the cell is widest (as a share of the whole table's range), at the weighted
quantile that gives each side the bytes of the shards it will hold (the median where the number is even), until each
cell is one shard. Medians are distributed: all cells of a level are cut at once by histograms of weight over the
ordering key, each a bounded aggregation (`BUCKETS` counters a cell), refined inside the bucket that holds the cut.
Ties in a dimension are ordered by a hash of the text, so a dimension with few values still splits where it must.

A group of equal texts stays in one shard unless it alone weighs more than `WHOLE` of a shard's target; then it is
dealt in pieces of `PIECE` of the target by a hash of the row, next to each other in the order, so that it fills
as few shards as the law allows. How many groups can be that heavy is bounded by shards / WHOLE.

Slots come from counts per (shard, bucket of rows) and ranks within a bucket; no shard is gathered in one task.

Results do not depend on how the input is partitioned, unless ids repeat. Defined results: null text has size
`overhead`; null metadata are the least value; a text of any length is one row of its size; text metadata are ordered by
their first six characters, and further by the hash of the document's text; ids that repeat are separate rows (told apart
by numbers that follow the partitioning); an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.common import materialize, need, with_row

SHARDS = 40
OVERHEAD = 16
WHOLE = 0.25
PIECE = 0.01
BUCKETS = 2048
SLACK = 0.002
SLOT_ROWS = 20_000
#: Bits of the ordering key: value of the dimension, hash of the text, piece of a heavy group.
VALUE_BITS, HASH_BITS, PIECE_BITS = 20, 26, 14
_TOP = 1 << (VALUE_BITS + HASH_BITS + PIECE_BITS)


@dataclass
class Cell:
    """Shards first..first+n-1. A split cell has a dimension, a key (units below it go left) and two children."""

    first: int
    n: int
    dim: int | None = None
    cut: int = 0
    left: "Cell | None" = None
    right: "Cell | None" = None

    def leaves(self) -> list["Cell"]:
        return [self] if self.dim is None else self.left.leaves() + self.right.leaves()


def metadata(docs: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    """Each column as a long: numbers as a logarithmic scale of their size, other types by their leading characters."""
    out = []
    for c in columns:
        kind = dict(docs.dtypes)[c]
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            v = F.col(c).cast("double")
            out.append(F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 20_000), F.lit(-(1 << 40))).cast("long"))
        else:
            text = F.rpad(F.substring(F.col(c).cast("string"), 1, 6), 6, "\u0000")
            out.append(F.coalesce(F.conv(F.substring(F.hex(F.encode(text, "utf-8")), 1, 14), 16, 10).cast("long"), F.lit(-1)))
    return out


def _expression(cell: Cell, keys: list[Column], leaf) -> Column:
    if cell.dim is None:
        return F.lit(leaf(cell))
    return F.when(keys[cell.dim] < cell.cut, _expression(cell.left, keys, leaf)).otherwise(_expression(cell.right, keys, leaf))


def build_tree(units: DataFrame, dims: int, shards: int, total: int, bounds: list[tuple[int, int]], buckets: int = BUCKETS) -> Cell:
    """units: columns k0..k(dims-1) (ordering keys) and weight. bounds: the keys' range in each dimension."""
    root = Cell(0, shards)
    target = total / shards
    keys = [F.col(f"k{d}") for d in range(dims)]
    while True:
        open_cells = [c for c in root.leaves() if c.n > 1]
        if not open_cells:
            return root
        number = {id(c): i for i, c in enumerate(open_cells)}
        here = units.withColumn("cell", _expression(root, keys, lambda c: number.get(id(c), -1))).where(F.col("cell") >= 0)
        facts = {r["cell"]: r for r in here.groupBy("cell").agg(F.sum("weight").alias("w"), *[f(f"k{d}").alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()}
        plan = {}
        for i, c in enumerate(open_cells):
            left_n = c.n // 2
            r = facts.get(i)
            if r is None:
                plan[i] = [0, 0, 1, 0.0, 0, left_n]
                continue
            width = [(r[f"hi{d}"] - r[f"lo{d}"]) / max(1, bounds[d][1] - bounds[d][0]) for d in range(dims)]
            d = max(range(dims), key=lambda d: (width[d], -d))
            plan[i] = [d, r[f"lo{d}"], r[f"hi{d}"] + 1, r["w"] * left_n / c.n, 0, left_n]
        loose = {i for i, p in plan.items() if p[2] - p[1] > 1}
        while loose:
            # cell -> (dimension, low, bucket width): a literal map of at most `shards` entries
            spec = {i: (plan[i][0], plan[i][1], max(1, -(-(plan[i][2] - plan[i][1]) // buckets)), plan[i][2]) for i in loose}
            by_cell = lambda k: F.create_map(*[x for i, s in spec.items() for x in (F.lit(i), F.lit(s[k]).cast("long"))])[F.col("cell")]
            key = F.element_at(F.array(*keys), (by_cell(0) + 1).cast("int"))
            hist = here.where(F.col("cell").isin(sorted(loose))).withColumn("key", key).withColumn("low", by_cell(1)).where((F.col("key") >= F.col("low")) & (F.col("key") < by_cell(3)))
            hist = hist.withColumn("bucket", F.col("key") - F.col("low") - F.pmod(F.col("key") - F.col("low"), by_cell(2)))
            got: dict[int, list] = {}
            for r in hist.groupBy("cell", "bucket").agg(F.sum("weight").alias("w")).collect():
                got.setdefault(r["cell"], []).append((r["bucket"], r["w"]))
            for i in sorted(loose):
                d, low, high, want, before, _ = plan[i]
                step = spec[i][2]
                held = before
                for offset, w in sorted(got.get(i, [])):
                    if held + w >= want:
                        break
                    held += w
                else:
                    offset, w = high - low, 0
                start, end = low + offset, min(low + offset + step, high)
                # the cut may stand at either side of the bucket; look inside while that is too coarse
                if step == 1 or w <= SLACK * target:
                    plan[i][1], plan[i][4] = (start, held) if want - held <= held + w - want else (end, held + w)
                    loose.discard(i)
                else:
                    plan[i][1], plan[i][2], plan[i][4] = start, end, held
        for i, c in enumerate(open_cells):
            d, cut, _, _, _, left_n = plan[i]
            c.dim, c.cut = d, cut
            c.left, c.right = Cell(c.first, left_n), Cell(c.first + left_n, c.n - left_n)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("n_chars", "lang", "source"), shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    need(docs, id_col, text_col)
    dims = tuple(c for c in dims if c in docs.columns)
    docs, row, _ = with_row(docs.select(*dict.fromkeys([id_col, text_col, *dims])), id_col, "shard-numbered")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(data) + overhead).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("group"),
        *[m.alias(f"m{d}") for d, m in enumerate([*metadata(docs, dims), F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0))][: max(1, len(dims))])],
        F.xxhash64(F.col(row).cast("string")).alias("salt"),
    )
    n_dims = max(1, len(dims))
    rows = materialize(rows, "shard-rows")
    facts = rows.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), *[f(f"m{d}").alias(f"{n}{d}") for d in range(n_dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    total, n_rows = int(facts["total"] or 0), int(facts["n"])
    target = max(1.0, total / shards)
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id"), *[F.col(f"m{d}") for d in range(n_dims)])).alias("rep"))
    groups = groups.select("group", "weight", "copies", *[F.col(f"rep.m{d}").alias(f"m{d}") for d in range(n_dims)])
    pieces = F.when((F.col("weight") > WHOLE * target) & (F.col("copies") > 1), F.least(F.ceil(F.col("weight") / (PIECE * target)), F.lit((1 << PIECE_BITS) - 1))).otherwise(1)
    groups = materialize(groups.withColumn("pieces", pieces.cast("int")), "shard-groups")

    def keys(piece: Column) -> list[Column]:
        tail = F.shiftleft(F.shiftrightunsigned(F.xxhash64("group"), 64 - HASH_BITS), PIECE_BITS) + piece.cast("long")
        out = []
        for d in range(n_dims):
            lo, hi = int(facts[f"lo{d}"] or 0), int(facts[f"hi{d}"] or 0)
            value = F.floor((F.col(f"m{d}") - lo).cast("double") * (((1 << VALUE_BITS) - 1) / max(1, hi - lo))).cast("long")
            out.append((F.shiftleft(value, HASH_BITS + PIECE_BITS) + tail).alias(f"k{d}"))
        return out

    # heavy groups in pieces, in the proportion in which their rows fall: exact for equal sizes of equal texts
    heavy = rows.join(F.broadcast(groups.where(F.col("pieces") > 1).select("group", "pieces", *[F.col(f"m{d}").alias(f"h{d}") for d in range(n_dims)])), "group")
    heavy = heavy.withColumn("piece", F.pmod(F.col("salt"), F.col("pieces"))).groupBy("group", "piece").agg(F.sum("size").alias("weight"), *[F.first(f"h{d}").alias(f"m{d}") for d in range(n_dims)])
    light = groups.where(F.col("pieces") == 1).select("group", F.lit(0).cast("long").alias("piece"), "weight", *[f"m{d}" for d in range(n_dims)])
    units = light.unionByName(heavy.withColumn("piece", F.col("piece").cast("long")))
    units = materialize(units.select("weight", *keys(F.col("piece"))), "shard-units")
    tree = build_tree(units, n_dims, shards, total, [(0, _TOP)] * n_dims)

    placed = rows.select("doc_id", "size", "text_crc32", "group", "salt").join(groups.select("group", "pieces", *[f"m{d}" for d in range(n_dims)]), "group")
    placed = placed.withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.col("salt"), F.col("pieces"))).otherwise(0))
    placed = placed.select("doc_id", "size", "text_crc32", "salt", *keys(F.col("piece")))
    placed = placed.withColumn("shard", _expression(tree, [F.col(f"k{d}") for d in range(n_dims)], lambda c: c.first))
    per_shard = max(1, -(-n_rows // (shards * SLOT_ROWS)))
    spread = placed.withColumn("part", F.pmod(F.col("salt"), F.lit(per_shard))).select("doc_id", "size", "text_crc32", "salt", "shard", "part")
    spread = materialize(spread, "shard-placed")
    counts = spread.groupBy("shard", "part").count()
    starts = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("start"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("salt", "doc_id")) - 1)
    return ranked.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
