"""Cases that text operators once lost, each against a plain version of the same decision."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.llm import common, jaccard_join, kd_sharding, language_id, packing, quality_cnn, quality_rules, quotation, toxicity
from terrafold.llm.common import held_out
from tests.llm.test_operators import table

# 1 ------------------------------------------------------------------------------------------------------------------


def test_no_count_of_a_rare_language_is_left_out(spark):
    texts = ["the quick brown fox " * 5, "der schnelle braune fuchs " * 5, "zwyx", "12 34 ..."]
    model = language_id.fit(table(spark, texts, lang=["en", "de", "rare", "letterless"]))
    assert model.langs == ["de", "en", "rare"]
    got = language_id.identify(table(spark, ["zwyx", "fox", "fuchs"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["rare", "en", "de"]


def test_what_is_no_letter_has_no_language(spark):
    model = language_id.fit(table(spark, ["the quick brown fox " * 5], lang="en"))
    odd = ["\U000f0000\U000f0001 \U0010fffd", "\U000e0041\U000e0042", "12 \U0001f600", "\ue000"]
    got = language_id.identify(table(spark, [*odd, "\U00020000\U0002a6d6"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 4 + ["en"]


# 2 ------------------------------------------------------------------------------------------------------------------


def test_texts_that_share_a_word_are_not_near_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [[*[word() for _ in range(60)], "the", "anly"] for _ in range(40)]
    copies = [[*t[:-3], word(), *t[-2:]] for t in texts[:5]]  # one word of 62 is another
    sketches = [toxicity._sketch(" ".join(t)) for t in texts + copies]
    family = toxicity._families(sketches)
    assert len(set(family[:40])) == 40 and family[40:] == family[:5]


def test_misspelled_words_of_a_stem_are_caught(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    ends = ["oi", "on", "ou"]
    texts = [" ".join([*[word() for _ in range(30)], *(["zugrew" + ends[k % 3]] if k % 5 == 0 else [])]) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, texts), labels)
    assert model.stems
    scorer = model.scorer()
    assert all(scorer.score(f"well {w} then") > 0.5 for w in ("zugrewoi", "zugrewon", "zugrewus"))
    assert all(scorer.score(f"well {w} then") > 0.3 for w in ("zukrewoi", "zugewon", "zzugrewou"))


def test_toxicity_held_out_recall_where_labels_suffice(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    got = toxicity.score(docs, model).join(labels.where(held_out("doc_id", 4, 2)), "doc_id").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in got)
    assert caught >= 0.9 * sum(r["toxic"] for r in got) and caught >= 0.9 * sum(r["predicted"] for r in got)


def test_families_need_several_words_of_a_stem(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    kin = lambda n: ["zugrew" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n)]
    texts = [" ".join([*[word() for _ in range(30)], *(kin(4) if k % 10 == 0 else kin(1) if k % 3 == 0 else [])]) for k in range(300)]
    model = toxicity.fit(table(spark, texts), spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "doc_id long, toxic int"))
    assert any("zugrew".startswith(stem) or stem.startswith("zugrew") for stem, _ in model.families)
    scorer = model.scorer()
    assert scorer.score("so zugrewabc and zugrewhhh and zugrewfgf") > 0.5 and scorer.score("so zugrewabc and nothing else") < 0.3


# 3 ------------------------------------------------------------------------------------------------------------------


def test_quotes_link_to_the_latest_message_that_holds_most(spark, monkeypatch):
    monkeypatch.setattr(quotation, "SPAN", 4)
    long, short = "this is the longer line of the two", "and a shorter one"
    rows = [
        (1, 3, "a body that is said twice"), (1, 9, "a body that is said twice"), (1, 10, "> a body that is said twice\nyes"),
        (2, 0, f"{long}\nsomething else"), (2, 5, f"before\n{long}\n{short}\nafter"), (2, 6, f"{long}\nmore"), (2, 7, f"{short}\nless"), (2, 8, f"> {long}\n> {short}\nso"),
        (3, 1, "> a late body of its own\nhm"), (3, 9, "a late body of its own"), (4, 2, "a late body of its own"), (5, 0, "a late body of its own"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to_conv"], r["reply_to_turn"]) for r in quotation.format_conversations(df).collect()}
    assert (got[1, 10], got[2, 8], got[3, 1]) == ((1, 9), (2, 5), (4, 2))


def test_two_short_lines_and_the_fuller_message(spark):
    rows = [
        (1, 0, "no"), (1, 1, "yes\nno\nnot sure"), (1, 2, "no"), (1, 3, "> yes\n> no\nok"),
        (2, 0, "line A here"), (2, 1, "zzz"), (2, 2, "line A here\nline B here\nline C here"), (2, 3, "> line A here\n> line B here\nfine"),
        (3, 0, "> said elsewhere\nhm"), (3, 4, "said elsewhere"), (4, 1, "said elsewhere"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to_conv"], r["reply_to_turn"]) for r in quotation.format_conversations(df).collect()}
    assert (got[1, 3], got[2, 3], got[3, 0]) == ((1, 1), (2, 2), (4, 1))


def plain_links(messages):
    """messages: (conv, turn) to text. (passages, linked ones, target) of each message, by looking at every other one."""
    fold = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    bodies, quotes = {}, {}
    for place, text in messages.items():
        own, runs, last = [], [], -1
        for at, line in enumerate(text.split("\n")):
            marks = re.match(quotation.MARKS, line)
            level, content = (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)
            if level == 0:
                own.append(content)
            elif level == last:
                runs[-1][2].append(content)
            else:
                runs.append((level, at, [content]))
            last = level
        bodies[place] = "\n".join(own).strip()
        quotes[place] = [r for r in runs if fold("\n".join(r[2]))]
    units = {p: {fold(x) for x in [b, *re.split(r"\n\s*\n", b), *b.split("\n")]} - {""} for p, b in bodies.items()}
    out = {}
    for (conv, turn), runs in quotes.items():
        found = []
        for level, _, lines in runs:
            text, parts = fold("\n".join(lines)), {fold(x) for x in lines} - {""}
            earlier = [t for c, t in messages if c == conv and t < turn]
            whole = [t for t in earlier if text in units[conv, t]]
            held = {t: sum(len(x) for x in parts & units[conv, t]) for t in earlier}
            best = max(whole, default=None)
            if best is None and any(held.values()):
                best = max(earlier, key=lambda t: (held[t], t))
            if best is not None:
                found.append((level, False, -best, conv, best))
                continue
            far = min(((c, t) for c, t in messages if c != conv and bodies[c, t] and fold(bodies[c, t]) == text), default=None)
            if far:
                found.append((level, True, -far[1], *far))
        out[conv, turn] = (len(runs), len(found), min(found)[3:] if found else (None, None))
    return out


def test_links_equal_a_plain_search(spark):
    rng = random.Random(17)
    lines = ["ok", "yes", "no", "thanks a lot", "the cat sat on the mat", "and then it rained", "a much longer line that is said now and then", *[f"remark {k}" for k in range(30)]]
    messages = {}
    for conv in range(12):
        for turn in range(14):
            said = [rng.choice(lines) for _ in range(rng.randrange(1, 5))]
            text = "\n".join(said if rng.random() < 0.8 else [said[0], "", *said[1:]])
            if turn and rng.random() < 0.7:
                old = messages[conv if rng.random() < 0.85 else rng.randrange(conv + 1), rng.randrange(turn)].split("\n")
                a = rng.randrange(len(old))
                part = old[a : a + rng.randrange(1, 4)]
                text = "\n".join([*[(">" if x.startswith(">") else "> ") + x for x in part], text])
            messages[conv, turn] = text
    df = spark.createDataFrame([(c, t, "user", x) for (c, t), x in messages.items()], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], (r["reply_to_conv"], r["reply_to_turn"])) for r in quotation.format_conversations(df).collect()}
    want = plain_links(messages)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert sum(w[1] for w in want.values()) > 60


# 4 ------------------------------------------------------------------------------------------------------------------


def test_shards_and_slots_do_not_follow_the_partitions(spark):
    rng = random.Random(3)
    df = table(spark, [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["copy " * 20] * 60, lang="en")
    one, other = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in kd_sharding.shard(x, shards=7).collect()) for x in (df.coalesce(1), df.repartition(9)))
    assert one == other


# 5 ------------------------------------------------------------------------------------------------------------------


def test_ids_and_their_checksums_are_placed_alike(spark):
    texts = ["word " * k for k in (1, 3, 400, 2000, 7)] + [None, "", "word " * 3]
    whole, sums = (sorted(packing.pack(table(spark, texts), with_ids=x).collect(), key=lambda r: (r["doc_id"], r["piece"])) for x in (True, False))
    assert [(r["doc_id"], r["piece"], r["length"], zlib.crc32(r["ids"])) for r in whole] == [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in sums]


# 7 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_least_overlap_of_a_range_of_sizes(percent):
    for n in range(1, 90):
        sizes = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
        each = jaccard_join._least_overlap(np.full(len(sizes), n), sizes, percent)
        for a in range(len(sizes)):
            hi = sizes[a:]
            got = jaccard_join._least_of_sizes(np.full(len(hi), n), np.full(len(hi), sizes[a]), hi, percent)
            assert got.tolist() == np.minimum.accumulate(each[a:]).tolist()


def test_query_between_sizes_is_asked():
    # B = b1..b17; q = B, q1 links m = B, u1, u2 (17 of 20). k = B, u1, u2, u3 and l = b1..b15, u1, u2, u3 are in m's
    # group. In the order u1, u2, q1, b1, u3, b2.. the prefixes of q and the group have b1 alone in common.
    q, m, k, l_ = 1, 2, 3, 4
    # entries: block, its size, least and greatest size and component of the members with the token
    entries = np.array([1, 1, 18, 18, q, q, 2, 3, 18, 20, m, m])
    part = pd.DataFrame({"row": [q], "n": [18], "comp": [q], "block": [1], "size": [1], "entries": [entries]})
    got = jaccard_join._asked(part, 85)
    assert (q, 2) in set(zip(got["row"], got["block"]))


# 9 ------------------------------------------------------------------------------------------------------------------


def test_repeats_alone_are_rejected(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = ["\n".join(line(rng.randrange(3, 12)) for _ in range(rng.randrange(10, 40))) for _ in range(300)]
    bad = []
    for share in range(21, 30):  # a passage that stands twice
        passage = [word() for _ in range(share)]
        bad.append(" ".join([*passage, *[word() for _ in range(200 - 2 * share)], *passage]))
    for n in range(3, 9):  # lines that stand in the text again and again, never after the same one
        pool = [line(n) for _ in range(12)]
        order = [x for step in (1, 5, 7, 11) for x in (k * step % 12 for k in range(12))]
        bad.append("\n".join(pool[k] for k in order))
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, clean + bad, lang="en", source="s")).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert [i - 300 for i in range(300, len(got)) if got[i]["kept"]] == []
    assert sum(not got[i]["base_failed"] for i in range(300, len(got))) >= 11


# the rest -----------------------------------------------------------------------------------------------------------


def test_intermediate_tables_need_a_shared_folder(spark):
    class Conf(dict):
        pass

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_folder(Session).startswith("file://") and not Session.conf
    Session.conf["spark.checkpoint.dir"] = "viewfs://store/shared/"
    assert common.shared_folder(Session) == "viewfs://store/shared"


def test_written_tables_and_settings_do_not_stay(spark):
    before = {k: spark.conf.get(k, None) for k in (common._CLEAN_UP, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.checkpoint.dir")}
    t = common.materialize(spark.range(5).repartition(2), "some")
    assert t.count() == 5
    common.discard(t)
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.schema("id long").parquet(t._written).count()
    assert before == {k: spark.conf.get(k, None) for k in before}
    assert common.free_name(spark.range(1).selectExpr("id AS _Row"), "_row") == "_row_"


# 3, 6 ---------------------------------------------------------------------------------------------------------------


def test_common_lines_do_not_multiply(spark, tmp_path):
    """Every message says and quotes the same two common lines, and one of its own: rows stay in proportion."""
    n = 3000
    rows = [(1, t, "user", f"> first common line\n> second common line\n> own {t - 1}\nsay {t}\n\nown {t}\nfirst common line\nsecond common line") for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = quotation.parse(df)
    found = common.materialize(quotation.passages(parsed.where("quoted").select("conv_id", "turn", "lines", "quoted")), "test-passages")
    written = {}
    keep = common.materialize

    def watched(table, name, *more):
        out = keep(table, name, *more)
        written[name] = out.count()
        return out

    quotation.materialize = watched
    try:
        got = {r["turn"]: r["source_turn"] for r in quotation.link(parsed, found).collect()}
    finally:
        quotation.materialize = keep
    assert got == {t: t - 1 if t else None for t in range(n)}
    assert max(written.values()) <= 8 * n


def test_slices_of_a_text_win_alike(monkeypatch):
    """Training in slices finds the same greatest answers and places as at once."""
    rng = np.random.default_rng(1)
    table, bias = rng.normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS, np.float32)
    for size in (128, 129, 700, 4096, 5000):
        data = rng.integers(0, 256, size).astype(np.uint8)
        whole = quality_cnn._winners(table, bias, data)
        monkeypatch.setattr(quality_cnn, "_SLICE", 256)
        for a, b in zip(quality_cnn._winners_of(table, bias, data), whole):
            assert np.array_equal(a, b)


def test_convolution_by_its_definition():
    """The forward pass against loops over filters, places and chunks."""
    rng = np.random.default_rng(2)
    table, bias = rng.normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), rng.normal(0, 1, quality_cnn.FILTERS).astype(np.float32)
    weight = rng.normal(0, 0.1, 3 * quality_cnn.FILTERS)
    model = quality_cnn.QualityModel(table, bias, weight, 0.2, 0.5)
    text = "".join(rng.choice(list("abcdef é.\n"), 400))
    data = text.encode()
    answers = np.array([[sum(table[k, data[i + k], f] for k in range(quality_cnn.WIDTH)) for f in range(quality_cnn.FILTERS)] for i in range(len(data) - quality_cnn.WIDTH + 1)])
    half = quality_cnn.CHUNK // 2
    halves = [np.maximum(answers[a : a + half].max(axis=0) + bias, 0) for a in range(0, len(answers), half)]
    chunks = np.array([np.maximum(a, b) for a, b in zip(halves, halves[1:])])
    x = np.concatenate([chunks.mean(axis=0), chunks.min(axis=0), chunks.max(axis=0)])
    assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(x @ weight + 0.2))), abs=1e-5)


# 1 ------------------------------------------------------------------------------------------------------------------


def test_large_languages_are_learned_from_a_bounded_part(spark):
    """A language with many rows gives about fit_rows of them, a rare one all; calibration rows are not counted."""
    rng = random.Random(1)
    words = {"big": "abcde", "rare": "vwxyz"}
    text = lambda lang: " ".join("".join(rng.choice(words[lang]) for _ in range(4)) for _ in range(30))
    langs = ["big"] * 1500 + ["rare"] * 15
    df = table(spark, [text(x) for x in langs], lang=langs)
    seen = {}
    keep = language_id.materialize

    def watched(rows, name, *more):
        out = keep(rows, name, *more)
        if name == "language-counts":
            seen.update({r["lang"]: r["n"] for r in out.groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect()})
        return out

    language_id.materialize = watched
    try:
        model = language_id.fit(df, fit_rows=300)
    finally:
        language_id.materialize = keep
    per_text = 30 * 5 - 1  # four letters and an end of each word, but for the last end
    assert seen["rare"] == 15 * per_text
    assert 150 * per_text < seen["big"] < 400 * per_text
    got = language_id.identify(df, model, ("lang",)).collect()
    assert all(r["lang"] == r["lang_pred"] and not r["rejected"] for r in got)


# pipeline -----------------------------------------------------------------------------------------------------------


class _Sizes(language_id.LanguageModel):
    """Says of each text how many characters it is asked about together with."""

    def classify(self, texts):
        return pd.DataFrame({"lang": str(sum(map(len, texts))), "score": 0.5, "cross_entropy": 1.0, "rejected": [False] * len(texts)})


def test_a_batch_is_scored_in_slices(spark):
    """Whatever the batches that a session sends, a worker makes strings of about a megabyte at a time."""
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 100_000).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(60, None), (61, "")], "doc_id long, text string")).coalesce(1)
    model = _Sizes([], 4, np.zeros(0, np.float32), [], [])
    got = language_id.identify(docs, model).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(62))
    assert max(int(r["lang_pred"]) for r in got) <= 1 << 20
    assert {r["score"] for r in toxicity.score(docs, toxicity.ToxicityModel()).collect()} == {toxicity.BASE}
    texts = ["é" * 3, None, "", "x" * 50, "y"]
    assert list(common.text_slices(pa.array(texts), 10)) == [texts[:3], texts[3:4], texts[4:]]
    assert [t for some in common.text_slices(pa.array(texts).slice(1, 3), 10) for t in some] == texts[1:4]
    assert not list(common.text_slices(pa.array([], pa.string()))) and not len(common.struct_of([], {"a": pa.string()}))


def test_counts_are_sent_on_before_they_fill_a_task(monkeypatch):
    """Also where the last batch is the one that fills the tables: an empty frame would stop the run."""
    monkeypatch.setattr(toxicity, "_HELD", 0)
    batches = [pd.DataFrame({"text": [f"some words {i}"], "toxic": [i % 2]}) for i in range(3)]
    parts = list(toxicity._features(iter(batches)))
    assert len(parts) == 3 and all(len(p) for p in parts)
    assert pd.concat(parts).query("kind == 'w' and term == 'words'")[["toxic", "clean"]].sum().tolist() == [1, 2]
    monkeypatch.setattr(language_id, "_HELD", 0)
    texts = [pd.DataFrame({"text": ["ab ab"], "lang": ["x"]}) for _ in range(3)]
    counts = list(language_id._counts(iter(texts), 2))
    assert len(counts) == 3 and pd.concat(counts)["n"].sum() == 3 * 5
