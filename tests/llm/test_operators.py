"""The text operators against brute-force versions, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import exact_dedup, jaccard_join, kd_sharding, language_id, packing, piece_bpe, quality_cnn, quality_rules, quotation, toxicity
from terrafold.llm.common import bounded_sample, held_out, tokenizer_file

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\t ", None, "x", "x y z", "　", "东京 都", "\U0001f600" * 3, "a  b\x00c", "ab " * 9000]


def table(spark, texts, **more):
    rows = [(i, t, *[v[i] if isinstance(v, list) else v for v in more.values()]) for i, t in enumerate(texts)]
    names = ", ".join(f"{k} string" for k in more)
    return spark.createDataFrame(rows, "doc_id long, text string" + (", " + names if names else ""))


def clash(df):
    """More columns, under names that operators use inside."""
    return df.withColumns({n: F.lit(7) for n in ("row", "group", "score", "n", "size", "token", "comp", "kept", "label", "key", "bytes", "rejected", "predicted", "lang_pred", "_row", "_verdict", "_ROW_", "block", "entries", "place", "kind")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts, order, context, symbol):
    """Interpolated probability by its definition, over words with an end mark 0 and padding 0."""
    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = [0] * (order - 1) + [ord(c) for c in w] + [0]
            for k in range(order - 1, len(s)):
                counts[tuple(s[k - order + 1 : k + 1])] += 1
    levels = [counts]
    for _ in range(order - 1):
        lower = Counter()
        for g in levels[0]:
            lower[g[1:]] += 1
        levels.insert(0, lower)

    def p(k, ctx, w):
        if k < 0:
            return 1 / (len(levels[0]) + 1)
        table = levels[k]
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        mine = {g: c for g, c in table.items() if g[:-1] == ctx}
        below = p(k - 1, ctx[1:], w)
        if not mine:
            return below
        total = sum(mine.values())
        return max(mine.get((*ctx, w), 0) - (d if (*ctx, w) in mine else 0), 0) / total + d * len(mine) / total * below

    return p(order - 1, context, symbol)


def test_language_model_is_kneser_ney(spark):
    texts = ["the then that thin.", "other mother the.", "that this thus."]
    model = language_id.fit(table(spark, texts, lang="en"), order=3)
    for word in ("the", "mob", "zz", "th"):
        sym, starts, _ = language_id.symbols([word])
        got = model.log_probs(sym)[1:, 0]
        padded = [0, 0] + [ord(c) for c in word] + ([0] if len(sym) > len(word) + 1 else [])
        want = [np.log(brute_kneser_ney(texts, 3, tuple(padded[k - 2 : k]), padded[k])) for k in range(2, 2 + len(got))]
        assert np.allclose(got, want, atol=1e-5), word


def test_language_id_held_out_and_odd(spark, docs):
    model = language_id.fit(docs.where(~held_out("doc_id", 4, 2)))
    got = language_id.identify(docs, model, keep=("doc_id", "lang")).where(held_out("doc_id", 4, 2)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["rejected"] for r in got)
    odd = {r["doc_id"]: r for r in language_id.identify(clash(table(spark, ODD)), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and all(odd[i]["rejected"] for i in range(4))
    far = language_id.identify(table(spark, ["东京都大阪府" * 60, "qxz jkq vvw zzx " * 40]), model).collect()
    assert all(r["rejected"] and r["lang_pred"] in model.langs for r in far)
    kept = language_id.keep_languages(clash(docs), model)
    assert kept.columns == clash(docs).columns and kept.count() == docs.count()
    assert language_id.identify(table(spark, ["a"]), language_id.fit(table(spark, [None], lang="en"))).first()["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_long_texts_score_as_short_ones(spark, docs):
    model = language_id.fit(docs)
    text = docs.orderBy(F.desc("n_chars")).first()["text"]
    whole, parts = model.entropies([text])[0], model.entropies([text], step=100)[0]
    assert np.allclose(whole, parts, atol=1e-4)


# 2 ------------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_with_full_tables_answers_the_same(monkeypatch):
    rng = random.Random(5)
    terms = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    words = [t[: rng.randrange(len(t) + 1)] + rng.choice("abcdex") + t[rng.randrange(len(t)) :] for t in rng.choices(terms, k=3000)]
    large = toxicity.LexiconAutomaton(terms[:40], terms[40:])
    want = [large.match(w) for w in words]
    monkeypatch.setattr(toxicity, "_ENTRIES", 500)
    small, most = toxicity.LexiconAutomaton(terms[:40], terms[40:]), 0
    longest = max(sum(len(s) for s in large.sets) // len(large.sets), 1)
    for w, hit in zip(words, want):
        assert small.match(w) == hit, w
        most = max(most, small.entries)
    assert large.entries > 5_000 and any(want) and not all(want)
    assert most <= 500 + 30 * (longest + 60), most  # what one word adds at most


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    words = ["moron", "worthless", "scum", "pathetic", "disgusting", "clown"]
    a = toxicity.LexiconAutomaton(words, [])
    for _ in range(4000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.4:
                w.insert(k, rng.choice("abcdeorst"))
            elif k < len(w):
                w[k : k + 1] = [] if rng.random() < 0.5 else [rng.choice("abcdeorst")]
        w = "".join(w)
        want = min((e, t) for t, e in ((i, edits(w, x)) for i, x in enumerate(a.terms)) if True) if w else None
        fits = [(edits(w, x), i) for i, x in enumerate(a.terms) if edits(w, x) <= toxicity.allowed_edits(x)]
        got = a.match(w)
        assert (got is None) == (not fits), w
        if fits:
            assert got[1] == min(fits)[0] and want is not None


def test_toxicity_catches_misspellings_and_spares_quotations():
    model = toxicity.ToxicityModel(words={"idiot": 0.95, "worthless": 0.95}, harmless=frozenset({"idiom"}))
    s = model.scorer()
    assert s.score("you are an idiot") > 0.9 and s.score("you are an 1di0t, really") > 0.3 and s.score("you are wort-hless") > 0.3
    assert s.score("a fine idiom of the language") < 0.1 and s.score("nothing here") == pytest.approx(toxicity.BASE)
    assert s.score('she wrote "he is an idiot" in her report') < 0.3 < s.score("he is an idiot")
    assert s.score(None) == s.score("") == toxicity.BASE


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    got = toxicity.score(clash(docs), model).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(clash(table(spark, ODD)), model).where("score < 0 or score > 1").count() == 0
    assert toxicity.fit(docs, labels.limit(0)).words == {}
    kept = toxicity.keep_harmless(clash(docs), model)
    assert kept.columns == clash(docs).columns


# 3 ------------------------------------------------------------------------------------------------------------------


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there friend, how are you?\nI have a question."), (1, 1, "assistant", "> Hello there friend, how are you?\nFine, thanks a lot indeed."),
        (1, 2, "user", "Another topic now"), (1, 3, "user", "On Monday X wrote:\n> > Hello there friend,   how are you?\n> Fine, thanks a lot indeed.\nGood"),
        (1, 4, "assistant", ">Another topic NOW\n\nyes"), (2, 0, "user", ">Another topic NOW\nfar"), (2, 1, "user", None), (2, 1, "user", "again"), (2, 2, None, ""), (None, 1, "user", "> x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).withColumn("lines", F.lit(2))
    got = {(r["conv_id"], r["turn"], r["body"]): r for r in quotation.format_conversations(df).collect()}
    assert len(got) == 10
    assert got[(1, 3, "Good")]["reply_to_turn"] == 1 and got[(1, 3, "Good")]["n_quotes"] == 2 and got[(1, 3, "Good")]["thread_turn"] == 0
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["reply_order"])] == [0, 1, 3, 2, 4]
    assert (got[(2, 0, "far")]["reply_to_conv"], got[(2, 0, "far")]["reply_to_turn"]) == (1, 2)
    assert got[(2, 1, None)]["n_quotes"] == 0
    assert quotation.format_conversations(df.limit(0)).count() == 0


def test_long_threads_and_common_lines(spark):
    n = 60
    rows = [(5, k, "user", f"unique statement number {k}\ncommon closing line" if not k else f"> unique statement number {k - 1}\nunique statement number {k}\ncommon closing line") for k in range(n)]
    got = sorted(quotation.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["turn"])
    assert [r["reply_depth"] for r in got] == list(range(n)) and {r["thread_turn"] for r in got} == {0} and [r["reply_order"] for r in got] == list(range(n))


# 4 ------------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(5, 400))) for _ in range(3000)] + ["same text of a hot group " * 8] * 1500 + ["pair"] * 2 + [None, ""]
    df = clash(table(spark, texts, lang=[None if i % 7 == 0 else "en" if i % 3 else "de" for i in range(len(texts))], source="s").withColumn("n_chars", F.length("text")))
    got = kd_sharding.shard(df, shards=10).collect()
    assert len(got) == len(texts)
    total, slots = Counter(), {}
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes"
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(total.values()) / 10
    assert len(total) == 10 and max(total.values()) < 1.03 * mean and min(total.values()) > 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    at = {r["doc_id"]: r["shard"] for r in got}
    assert at[4500] == at[4501] and len({at[i] for i in range(3000, 4500)}) <= 9
    assert kd_sharding.shard(df.limit(0)).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_plan_fills_bins():
    rng = random.Random(2)
    for counts in ({1024: 3}, {1: 5}, {600: 4, 424: 4}, {513: 7}, {k: rng.randrange(1, 40) for k in range(1, 1025, 7)}, {}):
        bins = packing.plan(counts)
        used = Counter()
        for combination, times in bins:
            assert sum(combination) <= 1024
            for n in combination:
                used[n] += times
        assert used == Counter(counts)
        bound = -(-sum(n * c for n, c in counts.items()) // 1024)
        assert sum(t for _, t in bins) <= max(bound * 1.02 + 1, 7 if counts == {513: 7} else 0)
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.cut(1030, 1024) == [(0, 6), (6, 1024)] and packing.cut(0, 8) == []


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = [r["text"] for r in docs.limit(60).collect()] + ODD + ["a <|endoftext|> b"]
    got = packing.pack(clash(table(spark, texts))).collect()
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        mine = sorted(pieces[i])
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert sum((p[2] for p in mine), []) == ids and [p[0] for p in mine] == list(range(len(mine)))
        assert [p[1] for p in mine] == [sum(len(q[2]) for q in mine[:k]) for k in range(len(mine))] and all(len(p[2]) == 1024 for p in mine[1:])
    for slots in places.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    t = quality_cnn._Trainer(1)
    v = {k: a.astype(np.float64) for k, a in t.values.items()}
    data = np.frombuffer(("Some bytes to score, and some more of them! " * 9).encode(), np.uint8)

    def loss():
        m = quality_cnn.QualityModel(v["table"], v["bias"], v["weight"], float(v["offset"][0]), 0.5)
        p = 1 / (1 + np.exp(-(m.features(data) @ v["weight"] + v["offset"][0])))
        return -np.log(p)

    grads = {k: np.zeros_like(a) for k, a in v.items()}
    quality_cnn._add_gradient(v, grads, data, 1.0, 1.0)
    for name in v:
        flat, g = v[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g), 5):
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-6 - g[k]) < 1e-4 + 1e-3 * abs(g[k]), name


def test_quality_held_out_and_odd(spark, docs, labels):
    model = quality_cnn.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    got = quality_cnn.score(clash(docs), model).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    odd = quality_cnn.score(clash(table(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_cnn.score(docs.limit(5), quality_cnn.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    long = "word and word " * 100_000
    whole = model.features(np.frombuffer(long.encode(), np.uint8))
    assert np.isfinite(whole).all()


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    fold = {c: c + 32 for c in range(65, 91)}
    for t in texts:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, base, n, edits_):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits_)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, width, percent):
    rng = random.Random(width)
    word = lambda: f"v{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(4):
        texts += near_copies(rng, [word() for _ in range(rng.randrange(20, 120))], 25, 6)
    texts += [" ".join([*passage, *[word() for _ in range(rng.randrange(5, 60))]]) for _ in range(70)]
    texts += ["A b C d", "a B c D", "a b c", "A B C", "a b c d e", *[t for t in ODD if t is None or len(t) < 100], texts[0].upper().replace("V", "v").replace("W", "w")]
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(clash(table(spark, texts)), width=width, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width, percent)


def test_jaccard_family_that_does_not_link(spark, monkeypatch):
    """Near copies below the threshold, a few of which link, beside one that all documents with a passage are near."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(5000)}"
    base = [word() for _ in range(60)]
    texts = near_copies(rng, base, 220, 5) + [" ".join([*base[:30], *[word() for _ in range(30)]]) for _ in range(40)]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "ASKS", 16)
    asked = []
    kept = jaccard_join._opened
    monkeypatch.setattr(jaccard_join, "_opened", lambda queries, blocks: asked.append((queries.count(), blocks.count(), blocks.select("block").distinct().count())) or kept(queries, blocks))
    for limit in (jaccard_join.BROADCAST_ROWS, 0):  # lists broadcast, or joined by key
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", limit)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(table(spark, texts), width=4, percent=85).collect()}
        want = brute_components(texts, 4, 85)
        assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) > 60
    for queries, rows, blocks in asked:  # a document asks blocks, not documents
        assert blocks < rows / 6 and queries <= rows * blocks


def test_jaccard_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(5, "one two three four five six"), (5, "one two three four five six"), (3, "something else altogether than that"), (None, "one two three four five six"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.join(df).collect()), key=str)
    assert len(got) == 5 and (9, 0, 9) in got and (3, 1, 3) in got and got.count((5, 2, 5)) == 2 and (None, 2, 5) in got
    assert jaccard_join.join(df.limit(0)).count() == 0
    assert jaccard_join.drop_near_copies(df.withColumn("row", F.lit(1))).count() == 3


# 8 ------------------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ab") for _ in range(3000))
    texts = ["a b c", "abc", "ab  c ", "abd", long, long[:-1] + "x", long + " ", " " + long, "", None, " \n", "éé", "é é", "　"] + ["hot copy"] * 40
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(clash(table(spark, texts))).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, t in enumerate(texts):
        same = [j for j in range(len(texts)) if norm[j] == norm[i]]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(same), keep == i, hashlib.sha256(norm[i].encode()).hexdigest())
    repeated = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, "y")], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup.deduplicate(repeated).collect()) == [False, False, True, True]
    assert exact_dedup.drop_copies(clash(repeated)).count() == 2 and exact_dedup.deduplicate(repeated.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    rng = random.Random(5)
    texts = [r["text"] for r in docs.collect()] + ODD + [" ".join(rng.choice("abc") for _ in range(200)), "same line here\n" * 30, "q " * 8, "r " * 9, "%$ " * 50]
    df = clash(table(spark, texts, lang=[None if i % 9 == 0 else "en" for i in range(len(texts))], source=[f"s{i % 3}" for i in range(len(texts))]))
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.judge(table(spark, ["a b"])).count() == 1


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(2)
    whole = np.rint(rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * 3000).astype(int)
    x = whole / 1000
    rows = spark.createDataFrame([("k", *r) for r in whole.tolist()], "key string, x0 long, x1 long, x2 long, x3 long, x4 long").withColumn("row", F.monotonically_increasing_id())
    white = quality_rules._whitening(quality_rules._moments(rows))
    got = np.array([r["d"] for r in rows.join(white, "key").select("row", quality_rules._distance().alias("d")).orderBy("row").collect()])
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
    c = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)
    assert np.allclose(got, want, rtol=1e-6)


def determinant(x, support):
    """Of the covariance, with its floors, of a part of the rows."""
    return np.linalg.slogdet(np.cov(x[support].T, bias=True) + np.diag(np.square(quality_rules.FLOORS)))[1] / 2


def random_starts(x, share, starts=60, steps=15):
    """The least determinant that concentration from random subsets finds."""
    rng, h, best = np.random.default_rng(1), int(np.ceil(share * len(x))), np.inf
    for _ in range(starts):
        support = rng.choice(len(x), 8, replace=False)
        for _ in range(steps):
            c = x - x[support].mean(axis=0)
            cov = np.cov(x[support].T, bias=True) + np.diag(np.square(quality_rules.FLOORS))
            support = np.argsort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))[:h]
        best = min(best, determinant(x, support))
    return best


def test_estimate_is_near_the_least_determinant(spark):
    """Against concentration from many random starts, for a bulk with far rows, one with a second group, and one with ties."""
    rng = np.random.default_rng(6)
    bulk = lambda n: rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 2
    groups = {"far": np.vstack([bulk(240), rng.normal(25, 1, (40, 5))]), "two": np.vstack([bulk(200), bulk(60) + 12]), "ties": np.vstack([np.repeat(bulk(30), 8, axis=0), rng.normal(-30, 3, (20, 5))])}
    groups = {k: np.rint(v * 1000) / 1000 for k, v in groups.items()}
    data = [(k, *map(int, np.rint(r * 1000))) for k, x in groups.items() for r in x]
    rows = spark.createDataFrame(data, "key string, x0 long, x1 long, x2 long, x3 long, x4 long")
    found = {r["key"]: r for r in quality_rules.estimates(rows, 3).collect()}
    for k, x in groups.items():
        assert found[k]["size"] <= random_starts(x, quality_rules.SUPPORT) + (0.2 if k == "ties" else 0.1)  # rows that tie at the limit all count
    again = {r["key"]: r for r in quality_rules.estimates(rows.repartition(7, "x1"), 3).collect()}
    assert again == found  # to the last digit, whatever the partitions


def test_outliers_are_rejected_and_the_bulk_is_kept(spark):
    rng = random.Random(8)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300))) for _ in range(300)]
    bad = [" ".join(w + "%$#" for w in t.split()) for t in clean[:20]]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(table(spark, clean + bad, lang="en", source="s")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 320))


# 10 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(piece_bpe.MODEL))


def test_codec_equals_the_library(pieces):
    own = piece_bpe.codec(tokenizer_file(piece_bpe.MODEL))
    rng = random.Random(6)
    letters = list("abcdefgh ▁ .,;:\n\t(){}[]=-_/\\\"'éüñß東京\U0001f6000123456789ABCthe") + [" "] * 6
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [" " * n for n in range(40)]
    for t in texts:
        n, ids, decoded = own.encode_text(t)
        want = pieces.encode(t)
        assert [int(x) for x in ids.split()] == want + [2] and n == len(want) + 1
        assert decoded == pieces.decode(want) == own.decode(want + [2])


def test_pairs_equal_merging():
    own = piece_bpe.codec(tokenizer_file(piece_bpe.MODEL))
    rng = random.Random(7)
    ids = [i for i in own.ids.values() if piece_bpe.SPACE not in own.pieces[i] and (own.formed[i] >= 0 or len(own.pieces[i]) == 1)]
    for _ in range(20_000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        assert own._meet(a, b) == (own._merged(own.pieces[a] + own.pieces[b]) == [a, b])


def test_piece_round_trip(spark, pieces, docs):
    texts = [r["text"] for r in docs.limit(50).collect()] + ODD
    got = {r["doc_id"]: r for r in piece_bpe.round_trip(clash(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = pieces.encode(t or "")
        assert got[i]["ids"] == " ".join(map(str, [*want, 2])) and got[i]["decoded"] == pieces.decode(want) and got[i]["n_tokens"] == len(want) + 1
    assert piece_bpe.round_trip(docs.limit(0)).count() == 0


# the rest -----------------------------------------------------------------------------------------------------------


def test_sample_does_not_depend_on_partitions(spark, docs):
    pick = lambda n: sorted(r["doc_id"] for r in bounded_sample(docs.repartition(n), "doc_id", 20).collect())
    assert pick(1) == pick(5) and len(pick(1)) == 20


def test_model_file_of_another_kind_is_refused(tmp_path, monkeypatch):
    with pytest.raises(Exception):
        piece_bpe.read_model(str(tmp_path / "none.model"))
