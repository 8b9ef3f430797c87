"""Quality rules with robust multivariate outliers (operator 9), in DataFrame operations only.

Base statistics of each text are column expressions over its words and lines. Texts with fewer than 20 words, or with
more than 30 % of their words in repeated windows of eight words, fail at once. The statistics of the others are
transformed to near-normal scales; per language and source a minimum-covariance-determinant estimate gives centre and
spread of the bulk (`SUPPORT` of the rows), and a text is rejected when its squared Mahalanobis distance exceeds `CUT`.

The estimate: start from medians and median deviations, then concentration steps, each of which keeps the rows within
the group's distance quantile and estimates centre and covariance from them, until no group's determinant falls any more
(STEPS at most); of all steps a group keeps the one with the least determinant. Statistics count in thousandths, their
sums are exact, and quantiles are ranks among counted values, so verdicts do not depend on partitions or order. Each
variance has a floor (`FLOORS`), as most texts have no symbol or repeated line at all; each statistic can pass `CUT` alone. Distances are divided by how
much their median exceeds that of a chi-square with as many degrees of freedom. Groups with fewer than `LEAST_ROWS`
rows use the estimate of all such rows of their language, languages with fewer that of all rows so left.

Per step two aggregations by group with map-side combination (counts of distances on a fine scale, sums); a source with a
third of all rows sends a bounded number of partial rows per task. Centre and spread are joined back by broadcast while there are at most
`BROADCAST_GROUPS` groups, by key beyond.

Repeated windows are found by the 64-bit hashes of a text's windows, compared inside the text only.
Defined results: null text has no words and fails; null language or source is a group of its own; repeated rows are
judged alike, and so are rows of equal statistics, at the cut too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.common import SPACE_CHARS, materialize, need

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
WINDOW = 8
SUPPORT = 0.75
STEPS = 12
CUT = 30.0  # chi-square with 5 degrees of freedom: about 1 in 10^5
# The last two let repeats alone pass CUT: 20 % of the words (log 21 = 3.04), or lines of up to 8 words that all repeat
# (log 13.5 = 2.60), are more than sqrt(CUT) floors from a text without any.
FLOORS = (0.5, 0.12, 0.4, 0.45, 0.55)
LEAST_ROWS = 50
BROADCAST_GROUPS = 100_000
_MEDIAN_CHI2 = 4.351
_UNIT, _FINE = 1000, 2000
_P = len(FLOORS)
_WORD = r"[^\x20\x09-\x0D]+"


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of so many words that occur twice or more in the same array."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # positions whose hash equals a neighbour's in hash order, in text order
        twice = F.transform(
            F.array(ordered),
            lambda s: F.array_sort(
                F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
            ),
        )[0]
        # each repeated window covers its words up to the next one's beginning
        walk = F.aggregate(
            twice,
            F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last")),
            lambda a, i: F.struct((a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum"), i.alias("last")),
        )
        return walk["sum"]

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))[0]
    return F.when(n <= window, 0).otherwise(counted).cast("long")


def statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = need(docs, *dict.fromkeys([*keep, "text"])).select(
        *keep,
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    found = found.select(*keep, F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("_words")).alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features() -> list[Column]:
    """The transformed statistics in thousandths, whole numbers, in the order of FLOORS."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    values = [
        F.log(n + 1),
        F.log(chars / n),
        F.log(1 + 100 * F.col("n_symbols") / chars),
        F.log(1 + 100 * F.col("n_dup_lines") / n),
        F.log(1 + 100 * F.col("n_repeat_words") / n),
    ]
    return [F.round(v * _UNIT).cast("long") for v in values]


def _whitening(moments: DataFrame) -> DataFrame:
    """moments: key, m0.., c00.. (covariances). Adds w_ij, the inverse of the Cholesky factor: distance = |w (x - m)|; and
    size, the logarithm of the determinant's root."""
    df = moments
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    size = F.lit(0.0)
    for i in range(_P):
        size = size + F.log(f"l{i}{i}")
    df = df.withColumn("size", size)
    for j in range(_P):
        for i in range(j, _P):
            if i == j:
                df = df.withColumn(f"w{i}{j}", 1.0 / F.col(f"l{i}{i}"))
            else:
                total = F.lit(0.0)
                for k in range(j, i):
                    total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                df = df.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    return df.select("key", "size", *[f"m{i}" for i in range(_P)], *[f"w{i}{j}" for i in range(_P) for j in range(i + 1)])


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(_P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}{j}") * (F.col(f"x{j}") / float(_UNIT) - F.col(f"m{j}"))
        total = total + part * part
    return total


def _moments(rows: DataFrame) -> DataFrame:
    """key, m0.., c00..: means and covariances, from sums of whole numbers that no order of adding changes."""
    whole = lambda c: c.cast("decimal(20,0)")
    pairs = [(i, j) for i in range(_P) for j in range(i + 1)]
    sums = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)], *[F.sum(whole(F.col(f"x{i}") * F.col(f"x{j}"))).alias(f"p{i}{j}") for i, j in pairs],
    )
    n = F.col("n").cast("double")
    cov = [((whole(F.col("n")) * F.col(f"p{i}{j}") - whole(F.col(f"s{i}")) * whole(F.col(f"s{j}"))).cast("double") / (n * n * _UNIT**2)).alias(f"c{i}{j}") for i, j in pairs]
    return sums.select("key", *[(F.col(f"s{i}") / (n * _UNIT)).alias(f"m{i}") for i in range(_P)], *cov)


def _ranked(values: DataFrame, keys: list[str], share: float) -> DataFrame:
    """values: keys, v (whole numbers on a scale of bounded length). keys and v: the value at that share of the way through the key's
    values. Equal values are counted before they move."""
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    mine = Window.partitionBy(*keys)
    run = counts.select(*keys, "v", F.sum("n").over(mine.orderBy("v")).alias("upto"), F.sum("n").over(mine).alias("all"))
    return run.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*keys).agg(F.min("v").alias("v"))


def _medians(rows: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """key and the median of each column, as name0, name1..."""
    each = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in enumerate(columns)])).alias("e")).select("key", "e.i", "e.v")
    found = _ranked(each, ["key", "i"], 0.5)
    return found.groupBy("key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"{name}{i}") for i in range(_P)])


def _fine(distance: Column) -> Column:
    """A squared distance on a scale of _FINE steps a factor of e, beyond 1."""
    return F.floor(F.log1p(distance) * _FINE).cast("long")


def _joined(rows: DataFrame, small: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if groups <= BROADCAST_GROUPS else small, "key", how)


def estimates(rows: DataFrame, groups: int, steps: int = STEPS) -> DataFrame:
    """rows: key, x0... Returns per key centre, whitening and `scale` of the squared distances."""
    x = [F.col(f"x{i}") for i in range(_P)]
    middle = materialize(_medians(rows, x, "a"), "mcd-medians")
    off = _medians(_joined(rows, middle, groups), [F.abs(x[i] - F.col(f"a{i}")) for i in range(_P)], "d").join(middle, "key")
    start = off.select("key", *[(F.col(f"a{i}") / float(_UNIT)).alias(f"m{i}") for i in range(_P)], *[(F.pow(F.col(f"d{i}") * 1.4826 / _UNIT, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(_P) for j in range(i + 1)])
    now, best = materialize(_whitening(start), "mcd-start"), None
    for _ in range(steps):
        near = _joined(rows, now, groups).select("key", *x, _fine(_distance()).alias("v"))
        bulk = _joined(near, _ranked(near.select("key", "v"), ["key"], SUPPORT).withColumnRenamed("v", "limit"), groups).where("v <= limit")
        now = materialize(_whitening(_moments(bulk)), "mcd-step")
        if best is None:
            best = now
            continue
        both = now.withColumn("_late", F.lit(1)).unionByName(best.withColumn("_late", F.lit(0)))
        fell = now.select("key", F.col("size").alias("_new")).join(best.select("key", "size"), "key").where(F.col("_new") < F.col("size") - 1e-6)
        done = fell.isEmpty()
        least = both.groupBy("key").agg(F.min_by(F.struct(*now.columns), F.struct("size", "_late")).alias("_b"))
        best = materialize(least.select("_b.*"), "mcd-best")
        if done:
            break
    best = now if best is None else best
    medians = _ranked(_joined(rows, best, groups).select("key", _fine(_distance()).alias("v")), ["key"], 0.5)
    scale = F.greatest(F.lit(1.0), F.expm1(F.col("v") / float(_FINE)) / _MEDIAN_CHI2)
    return materialize(_joined(best, medians.select("key", scale.alias("scale")), groups), "mcd-estimates")


def judge(docs: DataFrame, id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """One row for each row of docs: doc_id, the base statistics, base_failed, distance (null if base_failed) and kept."""
    source = docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs
    for c in ("lang", "source"):
        if c not in source.columns:
            source = source.withColumn(c, F.lit(None).cast("string"))
    stats = materialize(statistics(source, ("doc_id", "lang", "source")), "rule-statistics")
    fine = stats.where(~F.col("base_failed")).select("lang", "source")
    own = F.concat_ws("\u0001", F.coalesce(F.col("lang"), F.lit("\u0000")), F.coalesce(F.col("source"), F.lit("\u0000")))
    sizes = fine.withColumn("own", own).groupBy("own", "lang").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS).groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "small_lang")
    keys = sizes.join(small, F.col("lang").eqNullSafe(F.col("small_lang")), "left").select(
        "own", F.when(F.col("n") >= LEAST_ROWS, F.col("own")).when(F.col("n_lang") >= LEAST_ROWS, F.concat_ws("\u0001", F.col("lang"), F.lit("\u0002"))).otherwise(F.lit("\u0002")).alias("key")
    )
    keys = materialize(keys, "rule-keys")
    groups = keys.count()
    keyed = stats.withColumn("own", own).join(F.broadcast(keys) if groups <= BROADCAST_GROUPS else keys, "own", "left").drop("own")
    rows = keyed.select("*", *[x.alias(f"x{i}") for i, x in enumerate(features())])
    model = estimates(rows.where(~F.col("base_failed")).select("key", *[f"x{i}" for i in range(_P)]), groups)
    judged = _joined(rows, model, groups, "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))).alias("kept"),
    )
