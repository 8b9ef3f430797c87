"""Language identification by interpolated Kneser-Ney character models (operator 1).

Per language one model of character n-grams is learned from labelled texts: all of a language with few, about
`FIT_ROWS` of one with more, those whose id has a small hash. Their n-grams of the highest order are counted in one
distributed pass, none left out; the lower orders follow as continuation counts, as Kneser and Ney define them. For each order the n-grams of all languages lie in one sorted array of
64-bit hashes beside a matrix of interpolated log probabilities, one column a language, so that a text is scored
with one binary search per character and order that it needs. The language with the lowest cross-entropy per
character is chosen. A text is rejected when that cross-entropy lies further above what the language's own texts
have than `REJECT_SD` standard deviations, with the deviation widened for short texts. Mean, deviation and widening
are learned for each language from rows that were not counted, if there are enough.

Defined results:
- null text, empty text and text without a letter: `und`, score 0, rejected (there is no language in it);
- no labelled rows at all: every text is `und`, score 0, rejected;
- ties between languages: the language first in alphabetical order;
- other columns of the input are ignored (or kept by keep_languages), whatever their names; repeated rows give repeated
  results, and an empty table none; very long texts are scored whole, in pieces that keep their context.

Size of the model, which is gathered and broadcast: the distinct n-grams of each order in the rows to learn from, with
8 bytes and 4 more a language each; so it is bounded by FIT_ROWS and the number of languages, not by the corpus. A language whose rows have no letter has no model; such rows are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_sample, free_name, materialize, need, struct_of, text_slices

UNKNOWN = "und"
ORDER = 4
FIT_ROWS = 20_000
CALIBRATION_ROWS, CALIBRATION_LEAST = 2_000, 20
PIECE = 40
LEAST_CHAR_VAR = 6.0
REJECT_SD = 8.0

_STEP = 500_000
_HELD = 500_000  # n-grams a task counts before it sends them on
_PLANES = 0x40000  # beyond are tags and private use
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _fold_table() -> np.ndarray:
    """For each code point of the planes that have letters: the lower-case letter's code point, or 0 where it is no letter."""
    table = np.zeros(_PLANES, dtype=np.uint32)
    for c in range(_PLANES):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: np.ndarray | None = None


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts on end, with one 0 for each run of other characters and one before each text.

    Returns the symbols, each text's first position, and each text's number of letters."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _fold_table()
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    folded = np.where(raw < _PLANES, _FOLD[np.minimum(raw, _PLANES - 1)], np.uint32(0))
    letter = folded > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[heads] = True
    at = np.cumsum(keep) - 1
    out = folded[keep]
    starts = at[heads]
    ends = np.append(starts[1:], len(out))
    n_letters = np.add.reduceat((out > 0).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    assert len(ends) == len(texts)
    return out, starts, n_letters


def ngram_hashes(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order up to this one the hash of the n-gram that ends at each symbol; what stands before its word counts as 0."""
    h = sym.astype(np.uint64)
    wide, alive, out = h, h != 0, [h * _WEIGHTS[0]]
    alive = np.ones(len(sym), dtype=bool)
    for k in range(1, order):
        h = out[-1].copy()
        part = wide[:-k] * _WEIGHTS[k]
        if k > 1:
            part *= alive[k:]
        h[k:] += part
        out.append(h)
        alive[k:] &= wide[:-k] != 0
        alive[:k] = False
    return out


class HashIndex:
    """Positions of 64-bit hashes in a sorted array: the top bits give where to begin, a few steps decide."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        tops = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(tops, np.arange(1 << self.bits)).astype(np.int32)
        self.steps = int(np.bincount(tops).max()) if len(keys) else 0
        self.padded = np.append(keys, np.zeros(max(self.steps, 1), np.uint64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it is there at all."""
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int32)]
        hit = self.padded[at] == h
        rest = np.flatnonzero(~hit)
        for _ in range(1, self.steps):
            if not len(rest):
                break
            at[rest] += 1
            there = self.padded[at[rest]] == h[rest]
            hit[rest[there]] = True
            rest = rest[~there]
        return at, hit & (at < len(self.keys))


def _counts(batches: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    """Per partition: each language's n-grams, as code points, with their counts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return _unique_rows(grams, n)

    def emit():
        for lang in sorted(held):
            grams, n = merged(held[lang])
            for a in range(0, len(n), 200_000):
                yield pd.DataFrame({"lang": lang, "gram": [g.tobytes() for g in grams[a : a + 200_000]], "n": n[a : a + 200_000]})

    for batch in batches:
        for lang, part in batch.groupby("lang", sort=True):
            texts = part["text"].tolist()
            for some in _slices(texts):
                sym, starts, _ = symbols(some)
                padded = np.concatenate([np.zeros(order - 1, np.uint32), sym])
                grams = np.lib.stride_tricks.sliding_window_view(padded, order)
                keep = np.ones(len(sym), dtype=bool)
                keep[starts] = False
                grams, n = _unique_rows(_own_starts(grams[keep], sym, starts, keep, order), None)
                held.setdefault(lang, []).append((grams, n))
                size += len(n)
        if size > _HELD:
            yield from emit()
            held, size = {}, 0
    yield from emit()


def _own_starts(grams: np.ndarray, sym: np.ndarray, starts: np.ndarray, keep: np.ndarray, order: int) -> np.ndarray:
    """Texts follow each other with a 0 between; what stands before that 0 becomes 0 as well."""
    grams = np.array(grams)
    for k in range(order - 2, 0, -1):
        gone = grams[:, k] == 0
        grams[gone, :k] = 0
    return grams


def _unique_rows(grams: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    grams = np.ascontiguousarray(grams)
    h = np.zeros(len(grams), dtype=np.uint64)
    for k in range(grams.shape[1]):
        h += grams[:, -1 - k].astype(np.uint64) * _WEIGHTS[k]
    if n is None:
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        return grams[first], n.astype(np.int64)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return grams[first], np.bincount(inverse, weights=n, minlength=len(first)).astype(np.int64)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about _STEP characters together, so that a batch of very long texts stays bounded."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class LanguageModel:
    """Interpolated models of all languages. levels[k]: (sorted hashes, log probabilities) of order k + 1;
    gaps[k]: (sorted hashes, log interpolation weights) of contexts of length k + 1."""

    langs: list[str]
    order: int
    floor: np.ndarray
    levels: list[tuple[HashIndex, np.ndarray]]
    gaps: list[tuple[HashIndex, np.ndarray]]
    mean: np.ndarray | None = None
    text_var: np.ndarray | None = None
    char_var: np.ndarray | None = None
    sharpness: float = 50.0

    def log_probs(self, sym: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol in each language, given the symbols of its word before it."""
        hashes = ngram_hashes(sym, self.order)
        out, todo = None, None
        for k in range(self.order - 1, -1, -1):
            index, table = self.levels[k]
            if todo is None:
                at, hit = index.find(hashes[k])
                out = table[np.where(hit, at, len(table) - 1)]
                todo = np.flatnonzero(~hit)
            else:
                at, hit = index.find(hashes[k][todo])
                out[todo[hit]] += table[at[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            if k:
                index, weights = self.gaps[k - 1]
                before = todo - 1
                ends_word = sym[np.maximum(before, 0)] == 0
                h = np.where(ends_word | (before < 0), np.uint64(0), hashes[k - 1][np.maximum(before, 0)])
                at, hit = index.find(h)
                out[todo[hit]] += weights[at[hit]]
        out[todo] += self.floor
        return out

    def entropies(self, texts: list[str], step: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, number of symbols scored, and number of letters."""
        n = len(texts)
        total, count, letters = np.zeros((n, len(self.langs))), np.zeros(n), np.zeros(n, dtype=np.int64)
        a = 0
        while a < n:
            b, size = a, 0
            while b < n and (b == a or size + len(texts[b]) < step):
                size += len(texts[b])
                b += 1
            sym, starts, letters[a:b] = symbols(texts[a:b])
            for c in range(0, len(sym), 4 * step):  # a very long text: piece by piece, with its context
                lo = max(0, c - 2 * self.order)
                logp = self.log_probs(sym[lo : c + 4 * step])[c - lo :]
                hi = c + len(logp)
                logp[starts[(starts >= c) & (starts < hi)] - c] = 0
                inside = starts[(starts > c) & (starts < hi)]
                first = np.searchsorted(starts, c, side="right") - 1
                cuts = np.concatenate([[0], inside - c]).astype(np.int64)
                total[a + first : a + first + len(cuts)] -= np.add.reduceat(logp, cuts, axis=0, dtype=np.float64)
            ends = np.append(starts[1:], len(sym))
            count[a:b] = ends - starts - 1
            a = b
        return total / np.maximum(count, 1)[:, None], count, letters

    def classify(self, texts: list[str]) -> pd.DataFrame:
        """lang, score, cross_entropy and rejected of each text."""
        n = len(texts)
        if not self.langs or not n:
            return pd.DataFrame({"lang": [UNKNOWN] * n, "score": np.zeros(n), "cross_entropy": np.zeros(n), "rejected": np.ones(n, dtype=bool)})
        ce, count, letters = self.entropies(texts)
        best = ce.argmin(axis=1)
        own = ce[np.arange(n), best]
        z = -(ce - own[:, None]) * np.minimum(count, self.sharpness)[:, None]
        score = 1.0 / np.exp(z).sum(axis=1)
        rejected = np.zeros(n, dtype=bool)
        if self.mean is not None:
            limit = self.mean[best] + REJECT_SD * np.sqrt(self.text_var[best] + self.char_var[best] / np.maximum(count, 1))
            rejected = own > limit
        none = letters == 0
        langs = np.array(self.langs, dtype=object)[best]
        langs[none] = UNKNOWN
        return pd.DataFrame({"lang": langs, "score": np.where(none, 0.0, score), "cross_entropy": np.where(none, 0.0, own), "rejected": rejected | none})


def build(counts: DataFrame, order: int = ORDER) -> LanguageModel:
    """The model of a table (lang, gram as little-endian code points, n), all of which counts.

    Probabilities, discounts and interpolation weights of each order are worked out by joins; what comes to the driver
    is the model itself, one row for each n-gram of any language."""
    tables = [counts]
    for k in range(order - 1, 0, -1):
        lower = tables[0].groupBy("lang", F.substring("gram", 5, 4 * k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables.insert(0, materialize(lower, "language-lower"))
    langs = sorted(r["lang"] for r in tables[0].select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], order, np.zeros(0, np.float32), [], [])
    levels, gaps = [], []
    floors = below = known = None

    def by_lang(value: Column) -> list[Column]:
        return [F.max(F.when(F.col("lang") == x, value)).alias(f"v{j}") for j, x in enumerate(langs)]

    for k, table in enumerate(tables):
        ones, twos = (F.sum((F.col("n") == x).cast("long")) for x in (1, 2))
        facts = table.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"), (1.0 / (F.count(F.lit(1)) + 1)).alias("even"))
        context = table.select("lang", "gram", "n", F.substring("gram", 1, 4 * k).alias("context"), F.substring("gram", 5, 4 * k).alias("suffix")).join(F.broadcast(facts), "lang")
        sums = context.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("discount") * F.count(F.lit(1)) / F.sum("n")).alias("gap"))
        rows = context.join(sums, ["lang", "context"])
        rows = rows.withColumn("below", F.col("even")) if not k else rows.join(below, ["lang", "suffix"])
        rows = rows.select("lang", "gram", "context", "suffix", "gap", "even", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("gap") * F.col("below")).alias("p"))
        rows = materialize(rows, "language-order")
        wide = rows.groupBy("gram", "context", "suffix").agg(*by_lang(F.log("p")))
        if not k:
            least = {r["lang"]: r["floor"] for r in rows.groupBy("lang").agg(F.max(F.log(F.col("gap") * F.col("even"))).alias("floor")).collect()}
            floors = np.array([least[x] for x in langs])
            wide = wide.select("gram", F.array(*[F.coalesce(f"v{j}", F.lit(float(x))) for j, x in enumerate(floors)]).alias("row"))
        else:
            weights = rows.groupBy("context").agg(*by_lang(F.log("gap"))).select("context", F.array(*[F.coalesce(f"v{j}", F.lit(0.0)) for j in range(len(langs))]).alias("weights"))
            weights = materialize(weights, "language-gaps")
            gaps.append(_hashed(weights.select(F.col("context").alias("gram"), F.col("weights").alias("row")), len(langs), k))
            wide = wide.join(weights, "context").join(known.select(F.col("gram").alias("suffix"), F.col("row").alias("lower")), "suffix")
            wide = wide.select("gram", F.array(*[F.coalesce(f"v{j}", F.col("weights")[j] + F.col("lower")[j]) for j in range(len(langs))]).alias("row"))
        known = materialize(wide, "language-rows")
        levels.append(_hashed(known, len(langs), k + 1))
        below = rows.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return LanguageModel(langs, order, floors.astype(np.float32), levels, gaps)


def _hashed(rows: DataFrame, columns: int, width: int) -> tuple[HashIndex, np.ndarray]:
    """rows: gram, row. The sorted hash array of the n-grams, and their rows in its order with a row of zeros after them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            grams = np.frombuffer(b"".join(batch["gram"]), dtype=np.uint32).reshape(-1, width)
            h = np.zeros(len(grams), dtype=np.uint64)
            for k in range(width):
                h += grams[:, width - 1 - k].astype(np.uint64) * _WEIGHTS[k]
            yield pd.DataFrame({"h": h.view(np.int64), **{f"v{j}": x for j, x in enumerate(np.stack(batch["row"].to_numpy()).astype(np.float32).T)}})

    found = rows.mapInPandas(run, "h long, " + ", ".join(f"v{j} float" for j in range(columns))).toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    table = np.zeros((len(h) + 1, columns), dtype=np.float32)
    for j in range(columns):
        table[:-1, j] = found[f"v{j}"].to_numpy()[order]
    return HashIndex(h[order]), table


def fit(labelled: DataFrame, order: int = ORDER, calibration_rows: int = CALIBRATION_ROWS, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from the columns doc_id, text and lang of `labelled`; rows without text or lang are left out.

    Counts come from about `fit_rows` rows of each language (every row of one with fewer), those with the smallest hashes of
    their id. Rejection and score are calibrated on at most `calibration_rows` rows, that are not counted: every tenth by
    another hash; of a language with fewer than CALIBRATION_LEAST such rows all rows are counted, and calibrate too."""
    rows = need(labelled, "doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))  # a row a language
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30))
    aside = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibrate")), F.lit(10)) == 0) & (F.col("_rows") >= 10 * CALIBRATION_LEAST)
    rows = rows.join(F.broadcast(sizes), "lang").where(part < F.lit(float(1 << 30) * fit_rows) / F.col("_rows"))
    rows = rows.withColumn("_aside", F.coalesce(aside, F.lit(False)))
    found = rows.where("NOT _aside").select("text", "lang").mapInPandas(lambda it: _counts(it, order), "lang string, gram binary, n long")
    found = materialize(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    model = build(found, order)
    if model.langs:
        sample = bounded_sample(rows.where(F.col("_aside") | (F.col("_rows") < 10 * CALIBRATION_LEAST)), "doc_id", calibration_rows).select("text", "lang").toPandas()
        _calibrate(model, sample)
    return model


def _calibrate(model: LanguageModel, sample: pd.DataFrame) -> None:
    """Mean and spread of each language's own cross-entropy, and the sharpness of the score that fits the labels best."""
    sample = sample[sample["lang"].isin(model.langs)]  # the others have no letter in any row
    ce, count, letters = model.entropies(sample["text"].tolist())
    code = {lang: j for j, lang in enumerate(model.langs)}
    truth = np.array([code[x] for x in sample["lang"]], dtype=int)
    n = len(model.langs)
    use = letters > 0
    own = ce[np.arange(len(truth)), truth]
    model.mean, model.text_var, model.char_var = np.full(n, np.log(100.0)), np.full(n, 0.04), np.full(n, 6.0)
    for j in range(n):
        mine = use & (truth == j) & (count >= 100)
        if mine.sum() >= 5:
            centre = float(np.median(own[mine]))
            model.mean[j] = centre
            model.text_var[j] = max(float(np.median((own[mine] - centre) ** 2)) / 0.455, 0.01)
            # pieces of PIECE letters say how much wider short texts spread
            texts = [t[len(t) // 2 :][:PIECE] for t in sample["text"][mine].tolist()[:200]]
            short, symbols_, some = model.entropies(texts)
            fit = some >= PIECE // 2
            if fit.sum() >= 5:
                spread = float(np.median((short[fit, j] - centre) ** 2)) / 0.455 - model.text_var[j]
                model.char_var[j] = max(spread * float(np.median(symbols_[fit])), LEAST_CHAR_VAR)
    best_loss = np.inf
    for sharp in (2.0, 5.0, 10.0, 20.0, 50.0):
        z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(count, sharp)[:, None]
        p = np.exp(z[np.arange(len(truth)), truth]) / np.exp(z).sum(axis=1)
        loss = float(-np.log(np.maximum(p[use], 1e-4)).mean()) if use.any() else 0.0
        if loss < best_loss - 1e-9:
            best_loss, model.sharpness = loss, sharp


def verdict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """lang_pred, score, cross_entropy and rejected of a text column, as one struct."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "cross_entropy": pa.float64(), "rejected": pa.bool_()}
        for batch in texts:
            found = [own.classify([t or "" for t in some]).rename(columns={"lang": "lang_pred"}) for some in text_slices(batch)]
            yield struct_of(found, kinds)

    return classify.asNondeterministic()(text)  # else Spark may run it once more for each use of a field


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs with lang_pred, score, cross_entropy and rejected; one row for each row of docs."""
    found = need(docs, *dict.fromkeys([*keep, "text"])).select(*keep, verdict(docs.sparkSession, model, F.col("text")).alias("_verdict"))
    return found.select(*keep, "_verdict.*")


def keep_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language is told, with all their columns."""
    name = free_name(docs, "_verdict")
    return docs.withColumn(name, verdict(docs.sparkSession, model, F.col("text"))).where(~F.col(name)["rejected"]).drop(name)
