"""The pipeline's stages on small tables, against what each should do to its own input."""

import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import toxicity
from terrafold.llm.common import held_out
from tests.llm.test_operators import ODD, brute_components, clash, edits

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        out.append((name, docs))
    return out


def test_stages_on_odd_rows_and_empty_tables(spark, stages):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' own names."""
    docs, labels = stages[0][1], spark.read.parquet(f"{DATA}/labels.parquet")
    some = docs.limit(40)
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string")
    rows = clash(some.unionByName(some.limit(5)).unionByName(odd, allowMissingColumns=True))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, DATA)
        assert after.columns == rows.columns and after.count() <= rows.count(), name
        assert stage(spark, rows.limit(0), DATA).count() == 0, name
        rows = after.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, DATA)
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count() and labels.count()


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages] == ["input", "language_id", "toxicity", "exact_dedup", "jaccard_join", "packing"]
    assert all(d.columns == stages[0][1].columns for _, d in stages[:-1])


def plain_toxicity(model, text):
    """A plain version of the verdict: every word against every term by edit distance, families by counting."""
    low = (text or "").lower()
    words = {w: spelled for w in set(toxicity._WORD.findall(low)) if (spelled := toxicity.spellings(w))}
    sure, quoted = [], [*model.quoted, 1.0]
    for w, forms in words.items():
        for form in forms:
            for term, share in model.words.items():
                far = abs(len(form) - len(term)) > 2 or edits(form, term)
                if far is not True and far <= toxicity.allowed_edits(term) and not (far and {form, w} & model.harmless):
                    sure.append(share if not far else model.near.get((term, far), toxicity.NEAR[far]))
            sure += [share for stem, share in model.stems.items() if form.startswith(stem)]
    for (stem, k), share in model.families.items():
        if sum(w.startswith(stem) and w != stem for w in words) >= k:
            sure.append(share)
    return bool(sure), max(sure, default=0) * min(quoted) >= toxicity.THRESHOLD


def test_toxic_texts_go_and_clean_ones_stay(spark, stages):
    before, named, harmless = (d for _, d in stages[:3])
    assert named.count() == before.count()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    gone = named.join(harmless, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 1
    model = toxicity.fit(named, labels.where(~held_out("doc_id", 4, 2)))
    stays = {r["doc_id"] for r in harmless.select("doc_id").collect()}
    for r in named.select("doc_id", "text").collect():
        hit, sure = plain_toxicity(model, r["text"])
        assert not (sure and r["doc_id"] in stays) and (hit or r["doc_id"] in stays), r["doc_id"]


def test_copies_and_near_copies_go(stages):
    harmless, single, far = (d for _, d in stages[2:5])
    texts = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in harmless.collect()}
    assert single.count() == len(set(texts.values()))
    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    want = {rows[i][0] for i, (_, c) in enumerate(brute_components([t for _, t in rows], 5, 80)) if c == i}
    assert {r["doc_id"] for r in far.collect()} == want


def test_packed_sequences_hold_every_token(stages):
    far, packed = stages[4][1], stages[5][1]
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in far.collect()}
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in rows)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
