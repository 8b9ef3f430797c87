"""Mixing sources to target weights (operator 12), in DataFrame operations only.

Sources share the words of all documents by weight; a source gets no more than REPEATS times its own words, and what it
cannot take is shared again. The documents of a source lie in blocks, by hash. What a source has to give is a number of
whole passes over its blocks, and of one more pass the first blocks of a permutation, up to its target; the block in
which the target falls gives its first documents by hash, then, REFILLS times, the largest that still fits, and the
smallest of the others if that brings it nearer.

So each source has an exact quota of blocks. A splitting tree deals the quotas to the output shards: a node's shards are
halved, and the blocks of each source in the left half are a multivariate hypergeometric draw from the node's blocks, one
univariate draw (by inversion from the mode) after another. A leaf's counts take that many blocks, the next ones of a
permutation of the source's blocks, so no two shards have a block of one pass in common. Inside a shard, documents are
ordered by hash: the local shuffle.

Scale: texts are read once, for their size and hash; all else moves narrow rows. A source's blocks are put into order
by spans of SPAN blocks, so that a source that holds a third of all rows needs no task of its own. The tree works on arrays of at most
WIDTH counts; more sources are split as groups first, then inside each group. A list of sources is broadcast up to
SMALL rows, joined beyond. All draws are hashes of the seed and of what the documents hold: reruns and other partitionings
give the same mix. Rows with the same id and the same text lie in one block.

Defined results: a null or blank text has size 0 and is taken as often as its block; a null source is the last of all;
equal ids are separate rows; texts of any length count whole; an empty table gives no rows; if all sizes are 0, so are all
targets; a source without words has target 0 and gives nothing; other columns are kept by mix(), whose own columns then get other names if these are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.common import free_name, materialize, need, numbered

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARDS = 32
BLOCK_DOCS, SPAN, WIDTH, REFILLS = 1024, 1024, 64, 6
SMALL = 100_000
SEED = 12


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; a join by key otherwise."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) from the hash of keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among its `marked`: the u-quantile of the hypergeometric distribution.

    Weights are worked out from the mode to both sides, as far as ten standard deviations."""
    big = lambda c: c.cast("double")
    rest = total - marked
    lo, hi = F.greatest(F.lit(0).cast("long"), drawn - rest), F.least(marked, drawn)
    mode = F.least(hi, F.greatest(lo, F.floor((big(drawn) + 1) * (big(marked) + 1) / (big(total) + 2)).cast("long")))
    variance = big(drawn) * big(marked) * big(rest) * big(total - drawn) / (F.greatest(big(total), F.lit(1.0)) ** 2 * F.greatest(big(total) - 1, F.lit(1.0)))
    reach = F.ceil(10 * F.sqrt(variance)).cast("long") + 10
    known = F.struct(
        big(marked).alias("marked"), big(drawn).alias("drawn"), big(rest - drawn).alias("over"), mode.alias("mode"), u.alias("u"),
        F.least(reach, mode - lo).alias("down"), F.least(reach, hi - mode).alias("up"),
    )

    def up(p: Column, k: Column) -> Column:  # weight of k + 1 over that of k
        return (p["marked"] - k) * (p["drawn"] - k) / ((k + 1) * (p["over"] + k + 1))

    def side(p: Column, steps: Column, ratio: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            F.slice(F.sequence(F.lit(0).cast("long"), steps), F.lit(2), steps.cast("int")), start,
            lambda s, j: _let(s["w"] * ratio(j), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))),
        )

    def quantile(p: Column, below: Column, above: Column) -> Column:
        start = F.struct(below["w"].alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("passed"))
        low, aim = p["mode"] - p["down"], p["u"] * (1 + below["sum"] + above["sum"])

        def step(s: Column, j: Column) -> Column:
            return _let(s["sum"] + s["w"], lambda t: F.struct((s["w"] * up(p, big(low + j))).alias("w"), t.alias("sum"), (s["passed"] + F.when(t < aim, 1).otherwise(0)).alias("passed")))

        passed = F.aggregate(F.sequence(F.lit(0).cast("long"), p["down"] + p["up"]), start, step, lambda s: s["passed"])
        return low + F.least(passed, p["down"] + p["up"])

    def solve(p: Column) -> Column:
        below = side(p, p["down"], lambda j: 1 / up(p, big(p["mode"] - j)))
        above = side(p, p["up"], lambda j: up(p, big(p["mode"] + j - 1)))
        return _let(below, lambda b: _let(above, lambda a: quantile(p, b, a)))

    return _let(known, solve)


def _left(counts: Column, drawn: Column, *keys: Column) -> Column:
    """A multivariate hypergeometric draw: how many of each count are among `drawn` of all."""
    start = F.struct(_sum(counts).alias("total"), drawn.alias("drawn"), F.array().cast("array<long>").alias("out"))
    indexed = F.transform(counts, lambda x, i: F.struct(x.alias("n"), i.alias("i")))

    def take(s: Column, x: Column) -> Column:
        k = hypergeometric(s["total"], x["n"], s["drawn"], uniform(*keys, x["i"]))
        return _let(k, lambda k: F.struct((s["total"] - x["n"]).alias("total"), (s["drawn"] - k).alias("drawn"), F.concat(s["out"], F.array(k)).alias("out")))

    return F.aggregate(indexed, start, take, lambda s: s["out"])


def split(nodes: DataFrame, shards: int, seed: int) -> DataFrame:
    """nodes: node, counts and margins (blocks of each shard; both sum to the same). Adds shard, a row each, with its counts."""
    now = nodes.withColumn("a", F.lit(0)).withColumn("b", F.lit(shards))
    for _ in range(max(1, (shards - 1).bit_length()) if shards > 1 else 0):
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        drawn = _sum(F.slice("margins", F.col("a") + 1, mid - F.col("a")))
        now = now.withColumn("left", F.when(F.col("b") - F.col("a") > 1, _left(F.col("counts"), drawn, F.lit(seed), F.col("node"), F.col("a"), F.col("b"))))
        part = lambda a, b, counts: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), counts.alias("counts"))
        halves = F.array(part(F.col("a"), mid, F.col("left")), part(mid, F.col("b"), F.zip_with("counts", "left", lambda x, y: x - y)))
        own = F.array(part(F.col("a"), F.col("b"), F.col("counts")))
        now = now.withColumn("half", F.explode(F.when(F.col("left").isNull(), own).otherwise(halves)))
        now = now.withColumns({"a": F.col("half.a"), "b": F.col("half.b"), "counts": F.col("half.counts")}).drop("half", "left")
    return now.withColumnRenamed("a", "shard").drop("b")


def deal(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """quotas: rank (from 0), blocks. Returns rank and ends, the running sum of its blocks over the shards."""
    size = quotas.agg(F.max("rank").alias("rank"), F.sum("blocks").alias("blocks")).first()
    sources, blocks = (size["rank"] or 0) + 1, size["blocks"] or 0
    levels = 1
    while WIDTH**levels < sources:
        levels += 1
    known = quotas.sparkSession.range(1).select(
        F.col("id").alias("node"),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.lit(blocks // shards) + F.when(i < blocks % shards, 1).otherwise(0)).alias("margins"),
    )
    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("rank") / WIDTH**level)
        sums = quotas.groupBy(child.alias("child")).agg(F.sum("blocks").alias("blocks"))
        groups = sums.groupBy(F.floor(F.col("child") / WIDTH).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "blocks"))).alias("children"))
        nodes = known.join(groups, "node").withColumn("counts", F.transform("children", lambda x: x["blocks"]))
        cells = split(nodes, shards, seed + level)
        cells = cells.select("shard", F.explode(F.arrays_zip(F.transform("children", lambda x: x["child"]).alias("child"), "counts")).alias("cell"))
        cells = cells.select("shard", F.col("cell.child").alias("child"), F.col("cell.counts").alias("blocks"))
        known = cells.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("cells"))
        known = known.select(F.col("child").alias("node"), F.transform("cells", lambda x: x["blocks"]).alias("margins"))
    each = known.select(F.col("node").alias("rank"), F.posexplode("margins").alias("shard", "blocks"))
    ends = each.withColumn("end", F.sum("blocks").over(Window.partitionBy("rank").orderBy("shard")))
    return ends.groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, total (words), docs. Adds rank (by code point, null last), weight and target, in a written table."""
    ranked = numbered(sizes, [F.asc_nulls_last("source")], "rank", "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "mix-weights")
    top = REPEATS * F.col("total")
    # the level rises until no more sources stop at their top: one small sum over the sources a step
    level, stopped = 0.0, -1
    while True:
        over = top < F.lit(level) * F.col("weight")
        at = ranked.agg(F.sum("total").alias("all"), F.coalesce(F.sum(F.when(over, top)), F.lit(0)).alias("tops"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(over).alias("stopped")).first()
        if at["stopped"] == stopped or not at["open"]:
            break
        stopped, level = at["stopped"], (at["all"] - at["tops"]) / at["open"]
    return ranked.withColumn("target", F.least(top.cast("double"), F.lit(float(level)) * F.col("weight")))


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (rank, spans, h, block, pass) with `name`, the sum of value over the rows before it by h in its rank: one
    window inside a span, one over the spans."""
    rows = rows.withColumn("span", F.floor(F.shiftrightunsigned("h", 32) * F.col("spans") / 2.0**32))
    inside = Window.partitionBy("rank", "span").orderBy("h", "block", "pass").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("rank").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rank", "span").agg(F.sum(value).alias("_sum")).select("rank", "span", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    found = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, ["rank", "span"])
    return found.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_start", "_in", "span")


def _edges(dealt: DataFrame, edges: DataFrame) -> DataFrame:
    """edges: rank, block, left (words that the block has to give). Adds last (hash and row of the last document by hash
    that it gives) and picks (rows of those that fill what then is left)."""
    docs = dealt.join(_small(edges), ["rank", "block"])
    by_hash = Window.partitionBy("rank").orderBy("h", "row")
    docs = docs.withColumn("taken", F.sum("size").over(by_hash) <= F.col("left"))
    alone = Window.partitionBy("rank")
    docs = docs.withColumn("last", F.max(F.when(F.col("taken"), F.struct("h", "row"))).over(alone)).withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))).over(alone), F.lit(0)))
    picks = []
    for k in range(REFILLS + 1):
        free = ~F.col("taken") & (F.col("size") > 0)
        if k < REFILLS:
            docs = docs.withColumn(f"p{k}", F.max(F.when(free & (F.col("size") <= F.col("left")), F.struct("size", "h", "row"))).over(alone))
        else:  # the one that goes beyond by less than what would be missing
            docs = docs.withColumn(f"p{k}", F.min(F.when(free & (F.col("size") < 2 * F.col("left")), F.struct("size", "h", "row"))).over(alone))
        docs = docs.withColumn("left", F.col("left") - F.coalesce(F.col(f"p{k}.size"), F.lit(0))).withColumn("taken", F.col("taken") | F.coalesce(F.col("row") == F.col(f"p{k}.row"), F.lit(False)))
        picks.append(F.col(f"p{k}.row"))
    return docs.groupBy("rank", "block").agg(F.first("last").alias("last"), F.first(F.array_compact(F.array(*picks))).alias("picks"))


def _measured() -> dict[str, Column]:
    """size, and h: what the draws are hashed from."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return {"size": size, "h": F.xxhash64(F.lit("doc"), F.col("doc_id").cast("string"), F.xxhash64("text"), F.col("text").isNull())}


def _placed(sized: DataFrame, shards: int, seed: int) -> DataFrame:
    """sized: doc_id, source, row, size, h. Returns row, doc_id, size, source_size, target, copies: (pass, shard, place) each."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("docs"))
    sources = targets(sizes)
    of = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    sources = sources.withColumn("whole", F.least(of, F.lit(REPEATS)).cast("int"))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("total")).cast("long"))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("docs") / BLOCK_DOCS)).withColumn("spans", F.ceil((REPEATS + 1) * F.col("n_blocks") / SPAN))
    sources = materialize(sources.select("source", "rank", "total", "target", "whole", "rest", "n_blocks", "spans"), "mix-targets")
    on = sized["source"].eqNullSafe(sources["source"])
    dealt = sized.join(_small(sources.select("source", "rank", "n_blocks")), on).drop("source")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "h"), F.col("n_blocks"))).drop("n_blocks")
    blocks = materialize(dealt.groupBy("rank", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    facts = _small(sources.select("rank", "whole", "rest", "spans", "total", "target"))
    known = blocks.join(facts, "rank")
    slot = lambda df, kind: df.withColumn("h", F.xxhash64(F.lit(seed), F.lit(kind), "rank", "block", "pass"))
    last = slot(known.where("rest > 0").withColumn("pass", F.col("whole")), "pass")
    last = _running(last, "words", "before").where(F.col("before") < F.col("rest")).withColumn("left", F.col("rest") - F.col("before"))
    last = materialize(last.select("rank", "block", "pass", "spans", (F.col("words") > F.col("left")).alias("edge"), "left"), "mix-last-pass")
    cut = _edges(dealt, last.where("edge").select("rank", "block", "left"))
    passes = known.where("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    slots = passes.select("rank", "block", "pass", "spans", F.lit(False).alias("edge")).unionByName(last.drop("left"))
    quotas = materialize(slots.groupBy("rank").agg(F.count(F.lit(1)).alias("blocks")), "mix-quotas")
    ends = _small(materialize(deal(quotas, shards, seed), "mix-shards"))
    one = slots.withColumn("one", F.lit(1))
    placed = _running(slot(one, "slot"), "one", "at").join(ends, "rank")
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    by_block = placed.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "edge"))).alias("slots"))
    by_block = by_block.join(cut, ["rank", "block"], "left")
    found = dealt.join(by_block, ["rank", "block"], "left").join(facts, "rank")
    mine = F.coalesce(F.struct("h", "row") <= F.col("last"), F.lit(False)) | F.coalesce(F.array_contains("picks", F.col("row")), F.lit(False))
    kept = F.filter(F.coalesce("slots", F.array().cast("array<struct<pass:int,shard:int,edge:boolean>>")), lambda s: ~s["edge"] | mine)
    place = lambda s: F.xxhash64(F.lit(seed), F.lit("place"), F.col("h"), s["pass"])
    copies = F.transform(kept, lambda s: F.struct(s["pass"].alias("pass"), s["shard"].alias("shard"), place(s).alias("place")))
    return found.select("row", "doc_id", "size", F.col("total").alias("source_size"), "target", copies.alias("copies"))


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, size (words), source_size, target (words its source should give), copies: for
    each time that the mix takes it, (pass, shard, place)."""
    known = need(docs, "doc_id", "source", "text").withColumns(_measured()).withColumn("row", F.monotonically_increasing_id())
    return _placed(materialize(known.drop("text"), "mix-sizes"), shards, seed).drop("row")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, all its columns kept, with mix_shard and mix_place (the order
    in the shard)."""
    need(docs, "doc_id", "source", "text")
    row, shard, place = (free_name(docs, n) for n in ("_row", "mix_shard", "mix_place"))
    whole = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    known = whole.select("doc_id", "source", F.col(row).alias("row"), *(c.alias(n) for n, c in _measured().items()))
    taken = _placed(materialize(known, "mix-sizes"), shards, seed).select(F.col("row").alias(row), F.explode("copies").alias("_copy"))
    return whole.join(taken.select(row, F.col("_copy.shard").alias(shard), F.col("_copy.place").alias(place)), row).drop(row)


def write_shards(mixed: DataFrame, path: str, shard: str = "mix_shard", place: str = "mix_place") -> None:
    """The mix as Parquet, a folder for each shard, in its shuffled order."""
    mixed.repartition(shard).sortWithinPartitions(shard, place).write.mode("overwrite").partitionBy(shard).parquet(path)
