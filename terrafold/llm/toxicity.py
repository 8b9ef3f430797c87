"""Toxicity by a lexicon under Levenshtein automata, weighed by the words around each hit (operator 2).

The lexicon is learned: words, and stems (beginnings of words), that mark labelled toxic texts and hardly ever
others; and families, stems that mark a text in which two or three different words begin with them, though one such word
says little. Words and stems lie in a trie whose last nodes say whether a whole word or a stem ends there. The Levenshtein
automaton of the lexicon is the set of pairs (trie node, edits spent) that a word's characters leave alive; it is
made deterministic on demand, one table entry for each set and character; a full table (`_ENTRIES`) is begun afresh. So a word costs one dictionary lookup a
character and most words leave the automaton after a few.

Each hit weighs as much as hits of its term and kind (exact, stem, one edit, two edits) are right in the labelled rows.
Words of the labelled rows that are one or two edits from a term but occur in harmless texts are never misspellings.
The window of `WINDOW` words around a hit tells quotation from abuse: quotation marks that enclose the hit, or a
quoted line, lower its weight, more so with a verb of saying nearby. A text's score is the noisy-or of its hits.

Learning reads at most `FIT_ROWS` labelled rows; of these all words count, whatever their number and length.

Defined results: null and empty texts score `BASE`; without labelled rows the lexicon is empty and every text
scores `BASE`; texts are read whole, however long; of equally good terms the one with fewer harmless texts, then the
longer one, then the first in order is taken; repeated rows give repeated results, an empty table none; other columns of
the input, whatever their names, are ignored (or kept by keep_harmless).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import discard, free_name, labelled_sample, materialize, need, text_slices

BASE = 0.01
FIT_ROWS = 20_000
WINDOW = 6
NEAR = {1: 0.8, 2: 0.6}
PRIOR_ROWS = 4
STEM_LENGTHS = range(4, 10)
THRESHOLD = 0.3
SURPRISE = 3.0
WORD_PRECISION = 0.9
STEM_PRECISION = 0.95
FAMILIES = {"d": 2, "t": 3}  # kinds of features: at least so many different words of a stem
FALSE_FAMILIES = 0.1
SKETCH = 256
BANDS = 12
COPY = 0.8
_CACHE = 200_000
_ENTRIES = 500_000
_HELD = 250_000  # features a task counts before it sends them on, a few hundred bytes each

_WORD = re.compile(r"[^\W_]+(?:['@$!|*+.\-_]+(?=[^\W_])[^\W_]+)*")
_JOINER = re.compile(r"[.\-_*+]+")
# Characters that stand for letters in disguised spellings.
_DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_RUNS = re.compile(r"(.)\1{2,}")
# Verbs of saying, in the languages at hand.
_SAYING = frozenset("said says say wrote writes called calls quoted quote quotes reported reports according dit disait écrit appelé cité selon dijo dice escribió llamó citó según sagte sagt schrieb nannte zitierte laut".split())
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}


def allowed_edits(term: str) -> int:
    """Edits that still count as a misspelling: none below 5 letters, 1 below 9, 2 from there."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Deterministic Levenshtein automaton of a trie, built as words are read."""

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = sorted({*words, *stems})
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.reach: list[int] = [0]
        is_word, is_stem = set(words), set(stems)
        for t, term in enumerate(self.terms):
            node = 0
            path = [0]
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = nxt
                path.append(node)
            edits = allowed_edits(term) if term in is_word else 0
            for p in path:
                self.reach[p] = max(self.reach[p], edits)
            if term in is_word:
                self.word_at[node] = t
            if term in is_stem:
                self.stem_at[node] = t
        self._afresh()

    def _afresh(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.entries = 0  # pairs of all states, and moves
        self.start = self._state({0: 0})

    def _closed(self, alive: dict[int, int]) -> dict[int, int]:
        """With what the word may leave out: a trie letter that is skipped costs one edit."""
        stack = list(alive.items())
        while stack:
            node, e = stack.pop()
            if alive.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < alive.get(child, 9):
                    alive[child] = e + 1
                    stack.append((child, e + 1))
        return alive

    def _state(self, alive: dict[int, int]) -> int:
        closed = self._closed(alive)
        key = frozenset(closed.items())
        if key in self.states:
            return self.states[key]
        at = self.states[key] = len(self.sets)
        self.sets.append(key)
        self.entries += len(key)
        self.moves.append({})
        found = [(e, self.word_at[n]) for n, e in closed.items() if n in self.word_at and e <= allowed_edits(self.terms[self.word_at[n]])]
        self.ends.append((min(found)[1], min(found)[0]) if found else None)
        stem = [self.stem_at[n] for n, e in closed.items() if not e and n in self.stem_at]
        self.stems.append(stem[0] if stem else -1)
        return at

    def _move(self, state: int, ch: str) -> int:
        """-1: no term is left."""
        alive: dict[int, int] = {}
        for node, e in self.sets[state]:
            nxt = self.children[node].get(ch)
            if nxt is not None and e <= self.reach[nxt] and e < alive.get(nxt, 9):
                alive[nxt] = e
            if e + 1 <= self.reach[node]:  # one letter too many
                if e + 1 < alive.get(node, 9):
                    alive[node] = e + 1
            for child in self.children[node].values():  # another letter
                if e + 1 <= self.reach[child] and e + 1 < alive.get(child, 9):
                    alive[child] = e + 1
        at = self._state(alive) if alive else -1
        self.moves[state][ch] = at
        self.entries += 1
        return at

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the word: an exact stem counts as 0 edits and wins over misspellings."""
        if self.entries > _ENTRIES:  # between words, so no state is in use
            self._afresh()
        state = self.start
        stem = -1
        moves, stems = self.moves, self.stems
        for ch in word:
            nxt = moves[state].get(ch)
            if nxt is None:
                nxt = self._move(state, ch)
            if nxt < 0:
                return (stem, 0) if stem >= 0 else None
            state = nxt
            if stems[state] >= 0 and stem < 0:
                stem = stems[state]
        end = self.ends[state]
        if stem >= 0 and (end is None or end[1]):
            return stem, 0
        return end


def spellings(word: str) -> list[str]:
    """The lower-cased word, and what it may disguise where that differs."""
    out = [word]
    plain = _JOINER.sub("", word).translate(_DISGUISES) if not word.isalpha() else word
    plain = _RUNS.sub(r"\1", plain)
    if plain != word and plain.isalpha():
        out.append(plain)
    return out


@dataclass
class ToxicityModel:
    """words, stems: term to the share of labelled texts with it that are toxic. near: the same for words that are (term,
    edits) away, where the labelled texts have such words. families: (stem, how many different words) to the share of
    toxic texts among those with so many of its words or more. harmless: words near a term that occur in harmless texts. quoted: factors for hits in quotation, without and with a verb of saying."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    near: dict[tuple[str, int], float] = field(default_factory=dict)
    families: dict[tuple[str, int], float] = field(default_factory=dict)
    harmless: frozenset = frozenset()
    quoted: tuple[float, float] = (0.6, 0.25)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(list(model.words), list(model.stems))
        self.cache: dict[str, float] = {}
        self.kin: dict[str, dict[int, float]] = {}
        for (stem, k), w in model.families.items():
            self.kin.setdefault(stem, {})[k] = w
        self.kin_lengths = sorted({len(x) for x in self.kin})

    def weight(self, word: str) -> float:
        """Of one lower-cased word; 0 where it is no hit."""
        found = self.cache.get(word)
        if found is not None:
            return found
        best = 0.0
        for form in spellings(word):
            hit = self.automaton.match(form)
            if hit is None:
                continue
            term, edits = self.automaton.terms[hit[0]], hit[1]
            if edits:
                w = 0.0 if form in self.model.harmless or word in self.model.harmless else self.model.near.get((term, edits), NEAR[edits])
            else:
                w = max(self.model.words.get(form, 0.0), self.model.stems.get(term, 0.0), self.model.words.get(term, 0.0) if form != word else 0.0)
            best = max(best, w)
        if len(self.cache) >= _CACHE:
            self.cache.clear()
        self.cache[word] = best
        return best

    def score(self, text: str | None) -> float:
        if not text or not (self.automaton.terms or self.kin):
            return BASE
        low = text.lower()
        cache, weight = self.cache, self.weight
        words = set(_WORD.findall(low))
        hot = {w for w in words if (cache[w] if w in cache else weight(w))}
        kin: dict[str, set[str]] = {}
        for n in self.kin_lengths:
            for w in words:
                if w[:n] in self.kin and len(w) > n:
                    kin.setdefault(w[:n], set()).add(w)
        kin = {stem: mine for stem, mine in kin.items() if len(mine) >= min(self.kin[stem])}
        left = 1 - BASE
        if hot or kin:
            spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low)]
            for i, (a, b, w) in enumerate(spans):
                if w in hot:
                    left *= 1 - self.weight(w) * self._context(low, spans, i)
            for stem, mine in kin.items():  # as bad as the worst of its words' places
                size = max(v for k, v in self.kin[stem].items() if k <= len(mine))
                left *= 1 - size * max(self._context(low, spans, i) for i, s in enumerate(spans) if s[2] in mine)
        return min(1.0, max(0.0, 1 - left))

    def _context(self, low: str, spans: list, i: int) -> float:
        """Factor for the hit at word i: 1 for abuse, less for quotation."""
        first, last = spans[max(0, i - WINDOW)], spans[min(len(spans) - 1, i + WINDOW)]
        before, after = low[max(first[0] - 2, 0) : spans[i][0]], low[spans[i][1] : last[1] + 2]
        line = low.rfind("\n", 0, spans[i][0]) + 1
        inside = low[line : line + 3].lstrip().startswith(">")
        for opening, closing in _QUOTES.items():
            if opening == closing:
                inside |= before.count(opening) % 2 == 1 and opening in after
            else:
                inside |= before.rfind(opening) > before.rfind(closing) and closing in after
        if not inside:
            return 1.0
        near = {s[2] for s in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
        return self.model.quoted[1 if near & _SAYING else 0]


def _grams(words: set[str]) -> set[tuple[str, str]]:
    """(kind, term) of a text's words: "w" words, "s" stems that a word goes on from, and FAMILIES."""
    kin = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) > n)
    out = {("w", w) for w in words} | {("s", s) for s in kin}
    return out | {(kind, s) for s, n in kin.items() if n > 1 for kind, k in FAMILIES.items() if n >= k}


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition: in how many toxic and harmless texts each word, each stem of a word, and each stem of two or three
    different words occurs."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            words = set(_WORD.findall((text or "").lower()))
            (toxic if label else clean).update(_grams(words))
        if len(toxic) + len(clean) > _HELD:
            yield _feature_rows(toxic, clean)
            toxic, clean = Counter(), Counter()
    if toxic or clean:  # Arrow makes no column of texts of a frame without rows
        yield _feature_rows(toxic, clean)


def _feature_rows(toxic: Counter, clean: Counter) -> pd.DataFrame:
    keys = list(toxic.keys() | clean.keys())
    return pd.DataFrame({"kind": [k[0] for k in keys], "term": [k[1] for k in keys], "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})


def _surprise(toxic: int, clean: int, rate: float) -> float:
    """Chernoff bound: minus the log of how likely this many toxic texts are if the term says nothing."""
    n = toxic + clean
    p = toxic / n
    if p <= rate:
        return 0.0
    return n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0))


def _sketch(text: str) -> np.ndarray:
    """The SKETCH least hashes of a text's words, in order."""
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(_WORD.findall(text.lower()))], dtype=np.uint32)
    return np.unique(hashes * np.uint32(0x9E3779B1))[:SKETCH]


def _near_copies(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the word sets of two sketches have a Jaccard similarity of COPY or more; of small sets it is exact."""
    union = np.union1d(a, b)[:SKETCH]
    return np.isin(union, a[np.isin(a, b)]).sum() >= COPY * len(union)


def _families(sketches: list[np.ndarray]) -> list[int]:
    """For each text the place of the first near copy of it that is near to none before, whatever the order of the rest.

    Texts meet by bands of two least hashes under different orders; each meeting is checked."""
    steps = np.random.default_rng(0).integers(0, 1 << 31, 2 * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    leaders: dict[tuple, list[int]] = {}
    out = []
    for i, s in enumerate(sketches):
        least = (s[None, :] * steps[:, None]).min(axis=1).tolist() if len(s) else [0] * (2 * BANDS)
        bands = [(k, least[2 * k], least[2 * k + 1]) for k in range(BANDS)]
        met = sorted({j for band in bands for j in leaders.get(band, ())})
        out.append(next((j for j in met if _near_copies(s, sketches[j])), i))
        if out[-1] == i:
            for band in bands:
                leaders.setdefault(band, []).append(i)
    return out


def _real_families(found: DataFrame, rate: float) -> list:
    """Families whose texts are toxic too often for chance: of those of one kind and length at most FALSE_FAMILIES of the
    chosen ones are expected to be false (Benjamini and Hochberg's rule, on Chernoff's bound of each one's chance)."""
    rows = found.where(F.col("kind").isin(*FAMILIES) & (F.col("toxic") + F.col("clean") >= 2))
    sizes = {(r["kind"], r["n"]): r["count"] for r in rows.groupBy("kind", F.length("term").alias("n")).count().collect()}  # kinds times lengths
    sure = {}
    for r in rows.where((F.col("toxic") >= 2) & (F.col("toxic") >= WORD_PRECISION * (F.col("toxic") + F.col("clean")))).collect():
        sure.setdefault((r["kind"], len(r["term"])), []).append((math.exp(-_surprise(r["toxic"], r["clean"], rate)), r["term"], r))
    out = []
    for stratum, mine in sure.items():
        mine.sort(key=lambda x: x[:2])
        last = max((i for i, x in enumerate(mine, 1) if x[0] <= FALSE_FAMILIES * i / sizes[stratum]), default=0)
        out += [x[2] for x in mine[:last]]
    return sorted(out, key=lambda r: (r["kind"], r["term"]))


def _chosen(sample: DataFrame, marks: list, rate: float, sure: float) -> ToxicityModel:
    """Of the terms that mark toxic texts those that explain texts which no better term explains.

    Else every rare word of a toxic text that has copies would be a term. Copies of one text count once. Families come
    first; the words that begin with a family's stem say little one by one and are no terms of their own."""
    terms = [(r["kind"], r["term"]) for r in marks]
    by_term = {t: i for i, t in enumerate(terms)}

    def hits(batches):
        for batch in batches:
            out = [sorted(by_term[g] for g in _grams(set(_WORD.findall(text.lower()))) if g in by_term) for text in batch["text"]]
            yield pd.DataFrame({"sketch": [_sketch(t).astype(">u4").tobytes() for t in batch["text"]], "hits": out})

    # at most FIT_ROWS sketches of SKETCH hashes; a family has the terms of all its texts
    toxic = sorted((bytes(r["sketch"]), r["hits"]) for r in sample.where(F.col("toxic") != 0).select("text").mapInPandas(hits, "sketch binary, hits array<int>").collect())
    same = _families([np.frombuffer(s, ">u4").astype(np.uint32) for s, _ in toxic])
    covers: dict[int, set[int]] = {}
    for copy, (_, got) in zip(same, toxic):
        for i in got:
            covers.setdefault(i, set()).add(copy)
    share = lambda r: (r["toxic"] + rate * 0.5) / (r["toxic"] + r["clean"] + 0.5)
    model = ToxicityModel()
    explained: set[int] = set()
    for of_families, least in ((True, 2), (False, max(3, math.ceil(0.002 * len(set(same)))))):
        some = {i: c for i, c in covers.items() if (terms[i][0] in FAMILIES) == of_families}
        stems = {stem for stem, _ in model.families}
        some = {i: c for i, c in some.items() if not any(terms[i][1].startswith(x) for x in stems)}
        while some:
            best = max(some, key=lambda i: (len(some[i] - explained), -marks[i]["clean"], len(some[i]), len(terms[i][1]) if of_families else terms[i][0] == "w", -i))
            gain = some.pop(best)
            if len(gain - explained) < least:
                break
            explained |= gain
            kind, term = terms[best]
            if kind in FAMILIES:
                model.families[term, FAMILIES[kind]] = share(marks[best])
            else:
                (model.words if kind == "w" else model.stems)[term] = share(marks[best])
        for i, cover in () if of_families else some.items():  # sure by distinct texts alone, though always beside others
            if terms[i][0] == "w" and _surprise(len(cover), marks[i]["clean"], rate) > sure:
                model.words[terms[i][1]] = share(marks[i])
    model.words, model.stems, model.families = (dict(sorted(x.items())) for x in (model.words, model.stems, model.families))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic), at most `rows` labelled documents, those with the least hash of their id."""
    sample = labelled_sample(docs, labels, "toxic", rows, "toxicity-sample")
    n = sample.agg(F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_all = int(n["t"] or 0), int(n["n"] or 0)
    if not n_toxic or n_toxic == n_all:
        return ToxicityModel()
    parts = max(2, sample.sparkSession.sparkContext.defaultParallelism)
    found = sample.select("text", "toxic").repartition(parts).mapInPandas(_features, "kind string, term string, toxic long, clean long")
    found = materialize(found.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")
    rate = n_toxic / n_all
    single = found.where(F.col("kind").isin("w", "s"))
    n_features = max(2, single.where(F.col("toxic") + F.col("clean") >= 3).count())  # terms that could pass at all
    sure = math.log(n_features) + SURPRISE
    # what passes is certain beyond chance, so its number stays far below that of the sample's words
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    clean_part = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    marks = single.where((F.col("toxic") >= 3) & (p > F.when(F.col("kind") == "w", WORD_PRECISION).otherwise(STEM_PRECISION)) & (n * (p * F.log(p / rate) + clean_part) > sure))
    marks = sorted(marks.collect(), key=lambda r: (-r["toxic"], r["kind"], r["term"])) + _real_families(found, rate)
    model = _chosen(sample, marks, rate, sure)
    if model.stems:  # the words of a stem stand beside it, for their misspellings
        begins = F.coalesce(*[F.when(F.substring("term", 1, n).isin([s for s in model.stems if len(s) == n]), F.substring("term", 1, n)) for n in STEM_LENGTHS])
        of_stem = found.where((F.col("kind") == "w") & (p > WORD_PRECISION)).select("term", begins.alias("stem")).where("stem is not null")
        for r in of_stem.collect():
            model.words[r["term"]] = max(model.words.get(r["term"], 0.0), model.stems[r["stem"]])
        model.words = dict(sorted(model.words.items()))
    if not model.words:
        return model
    automaton = LexiconAutomaton(list(model.words), list(model.stems))

    def near(batches):
        for batch in batches:
            hits = [automaton.match(t) or (0, 0) for t in batch["term"]]
            batch = batch.assign(edits=[h[1] for h in hits], hit=[automaton.terms[h[0]] for h in hits])
            yield batch[batch["edits"] > 0]

    nearby = found.where((F.col("kind") == "w") & (F.length("term") >= 4)).mapInPandas(near, "kind string, term string, toxic long, clean long, edits long, hit string")
    nearby = materialize(nearby, "toxicity-near")
    model.harmless = frozenset(r["term"] for r in nearby.where(F.col("clean") > F.col("toxic")).select("term").collect())
    # words met once stand for words never met
    once = nearby.where(F.col("toxic") + F.col("clean") == 1).groupBy("hit", "edits").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    for r in once.collect():  # terms times two
        model.near[(r["hit"], r["edits"])] = (r["toxic"] + PRIOR_ROWS * NEAR[r["edits"]]) / (r["toxic"] + r["clean"] + PRIOR_ROWS)
    discard(sample, found, nearby)
    return model


def verdict(spark: SparkSession, model: ToxicityModel, text: Column, threshold: float = THRESHOLD) -> Column:
    """score and predicted (1 from the threshold on) of a text column, as one struct."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("score double, predicted int")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value.scorer()
        for batch in texts:
            scores = [own.score(t) for some in text_slices(batch) for t in some]
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["score", "predicted"])

    return judge.asNondeterministic()(text)  # else Spark may run it once more for each use of a field


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of docs with score and predicted; one row for each row of docs."""
    found = need(docs, *dict.fromkeys([*keep, "text"])).select(*keep, verdict(docs.sparkSession, model, F.col("text"), threshold).alias("_verdict"))
    return found.select(*keep, "_verdict.*")


def keep_harmless(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    name = free_name(docs, "_verdict")
    return docs.withColumn(name, verdict(docs.sparkSession, model, F.col("text"), threshold)).where(F.col(name)["predicted"] == 0).drop(name)
