"""Conversation repair against all edits tried out, and source mixing against plain targets and counts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import source_mixing, turn_repair
from terrafold.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, text string"


# 11 -----------------------------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, hash) by trying all edits, with a rising limit of the cost."""
    seen, faults = set(), []
    for role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    found = []

    def go(i, cost, audit, turns, limit):
        initials = "".join(r[:1] or "-" for r, _ in turns)
        if cost > limit or not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            found.append((cost, audit, tuple(turns)))
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*turns, (role, "")], limit)
        if i < len(rows):
            role, text = rows[i]
            more = faults[i] == "truncated"
            go(i + 1, cost + 3, audit + "D", turns, limit)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)], limit)
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*turns, (other, text)], limit)

    limit = 0
    while not found:
        go(0, 0, "", [], limit)
        limit += 1
    cost = min(x[0] for x in found)
    audit = min(x[1] for x in found if x[0] == cost)
    (turns,) = {x[2] for x in found if x[:2] == (cost, audit)}
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), Counter(faults)


def damaged(rows):
    """conv_id to its rows, by the rules of damage."""
    out = defaultdict(list)
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for k, v in out.items()}


def test_repair_takes_the_cheapest_edits(spark):
    rng = random.Random(11)
    texts = ["Hello.", "Well", "no!", "", None, " \n", "é?", "Hello.", "odd . ", "\U0001f600"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    rows = [(c if c else None, rng.choice([t, t, t, 0, None]), rng.choice(roles), rng.choice(texts)) for c in range(90) for t in range(rng.randint(1, 5))]
    got = {r["conv_id"]: r for r in turn_repair.repair(spark.createDataFrame(rows, CONV).withColumns({"block": F.lit(1), "at": F.lit(2), "kinds": F.lit("")})).collect()}
    assert set(got) == {r[0] for r in rows}
    known = damaged(rows)
    for conv, row in got.items():
        own = known.get(conv, [])
        if len(own) > 6:
            continue
        cost, audit, sha, faults = cheapest([x[1:] for x in own])
        turns = [x[0] for x in own if x[0] is not None]
        initials = [x[1][:1] for x in own]
        assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, audit, sha)
        assert [row[k] for k in ("blank", "duplicate", "truncated")] == [faults[k] for k in ("blank", "duplicate", "truncated")]
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_blocks_of_a_large_conversation_meet(spark, monkeypatch):
    """The same result whatever the length of blocks and the number of partitions."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", "", f"text {t}."])) for t in range(700)] + [(8, 0, "user", "x.")]
    df = spark.createDataFrame(rows, CONV)
    whole = sorted(map(tuple, turn_repair.repair(df).collect()))
    monkeypatch.setattr(turn_repair, "BLOCK", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(tuple, turn_repair.repair(df).collect())) == whole
        assert turn_repair.blocks_of(turn_repair.faulted(turn_repair.ordered(turn_repair.damage(df)))).where("conv = '=7'").count() > 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_conversation_has_one_row_of_each_kind(spark):
    """Many rows that repeat each other lie in several partitions, and all but one go."""
    rows = [(None, None, "user", "hi.")] * 5000
    (got,) = turn_repair.repair(spark.createDataFrame(rows, CONV), spark.createDataFrame(rows, CONV)).collect()
    assert (got["duplicate"], got["cost"], got["illegal"], got["gaps"]) == (4999, 3 * 4999 + 2, 4999, 0)
    assert got["audit"] == "K" + "D" * 4999 + "I"


def test_repair_of_nothing(spark):
    assert turn_repair.repair(spark.createDataFrame([], CONV)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (got,) = turn_repair.repair(spark.createDataFrame([(gone, 0, "user", "x.")], CONV)).collect()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="role"):
        turn_repair.repair(spark.createDataFrame([(1, 1)], "conv_id long, turn long"))


def test_repair_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op11_turn_repair"])
    names = [c[0] for c in found.description]
    got = QUERIES["op11_turn_repair"](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


# 12 -----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Shares by weight, the excess over three times a source's size shared again until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            out[s] += unit * weight[s]
        left = sum(max(0.0, out[s] - 3 * sizes[s]) for s in names)
        for s in names:
            out[s] = min(out[s], 3.0 * sizes[s])
        open_ = [s for s in names if out[s] < 3 * sizes[s]]
    return out


def sources_table(spark, n=3000):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 8 + ["b", "ä", None, "tiny" if i % 40 == 0 else "c", "\U0001f600", "Z"])
        rows.append((i, source, rng.choice([None, "", " \t"]) if i % 50 == 0 else " ".join(["w"] * (1 if source == "tiny" else rng.randint(1, 60)))))
    return spark.createDataFrame(rows, DOCS), rows


def test_mix_comes_near_its_targets(spark):
    df, rows = sources_table(spark)
    sizes, of = Counter(), {}
    for i, source, text in rows:
        of[i] = (source, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
        sizes[source] += of[i][1]
    aims = plain_targets(sizes)
    assert any(aims[s] == 3 * sizes[s] for s in sizes)  # one of them stops
    got = source_mixing.plan(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    taken = Counter()
    for r in got:
        source, size = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and r["target"] == pytest.approx(aims[source], rel=1e-9)
        assert len({c["pass"] for c in r["copies"]}) == len(r["copies"]) <= 3
        whole = int(aims[source] / sizes[source] + 1e-9)
        assert len(r["copies"]) in (whole, whole + 1)
        taken[source] += size * len(r["copies"])
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= 1
    assert sum(aims.values()) == pytest.approx(sum(sizes.values()))


def test_mix_is_the_same_again_and_in_other_partitions(spark):
    df, _ = sources_table(spark, 600)
    one = sorted(map(str, source_mixing.plan(df).collect()))
    assert one == sorted(map(str, source_mixing.plan(df.repartition(7, "text")).collect()))
    assert one != sorted(map(str, source_mixing.plan(df, seed=13).collect()))


def test_blocks_go_to_shards_by_their_quotas(spark, monkeypatch):
    """Many small blocks: each shard has its number of blocks to one, and a block of a pass is in one shard."""
    monkeypatch.setattr(source_mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(source_mixing, "SPAN", 8)
    df, _ = sources_table(spark, 1500)
    found = source_mixing.plan(df, shards=5).select("doc_id", "target", F.explode("copies").alias("c")).select("doc_id", "target", "c.*").toPandas()
    assert set(found["shard"]) == set(range(5))
    assert not found.duplicated(["doc_id", "pass"]).any()
    mixed = source_mixing.mix(df.withColumns({"mix_shard": F.lit("x"), "_row": F.lit(1), "h": F.lit(2), "size": F.lit(3)}), shards=5)
    assert mixed.columns[:7] == ["doc_id", "source", "text", "mix_shard", "_row", "h", "size"] and {"mix_shard_", "mix_place"} <= set(mixed.columns)
    assert Counter(r["mix_shard_"] for r in mixed.collect()) == Counter(found["shard"])


@pytest.mark.parametrize("width", [64, 3])
def test_tree_deals_exact_quotas(spark, monkeypatch, width):
    """All blocks are dealt, each shard gets as many to one, also when sources are split in groups first."""
    monkeypatch.setattr(source_mixing, "WIDTH", width)
    blocks = [500, 0, 33, 7, 1, 260, 90, 90, 12, 4, 1]
    ends = {r["rank"]: r["ends"] for r in source_mixing.deal(spark.createDataFrame(list(enumerate(blocks)), "rank long, blocks long"), 6).collect()}
    dealt = np.array([np.diff([0, *ends[k]]) for k in range(len(blocks))])
    assert (dealt >= 0).all() and dealt.sum(axis=1).tolist() == blocks
    assert dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 1
    spread = np.sqrt(500 * (1 / 6) * (5 / 6))
    assert (abs(dealt[0] - 500 / 6) < 5 * spread).all() and len(set(dealt[0])) > 1


@pytest.mark.parametrize("total,marked,drawn", [(50, 20, 25), (10, 10, 4), (9, 0, 5), (0, 0, 0), (7, 3, 7), (100000, 30000, 50000)])
def test_hypergeometric_draws(spark, total, marked, drawn):
    """Quantiles of the exact distribution."""
    big = lambda x: F.lit(x).cast("long")
    got = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u")).select("u", source_mixing.hypergeometric(big(total), big(marked), big(drawn), F.col("u")).alias("k")).collect()
    lo, hi = max(0, drawn - (total - marked)), min(marked, drawn)
    k = np.arange(lo, hi + 1)
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 2)))])
    choose = lambda n, r: lf[n] - lf[r] - lf[n - r]
    cdf = np.cumsum(np.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn)))
    want = [int(k[min(np.searchsorted(cdf, r["u"]), len(k) - 1)]) for r in got]
    assert sum(a != r["k"] for a, r in zip(want, got)) <= 1  # rounding at a step


def test_mix_of_odd_tables(spark):
    assert source_mixing.plan(spark.createDataFrame([], DOCS)).count() == 0
    assert source_mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    empty = source_mixing.plan(spark.createDataFrame([(1, None, None), (None, "a", " "), (1, None, None)], DOCS)).collect()
    assert [(r["size"], r["source_size"], r["target"], len(r["copies"])) for r in empty] == [(0, 0, 0.0, 0)] * 3
    (long_,) = source_mixing.plan(spark.createDataFrame([(1, "a", "w " * 300_000)], DOCS)).collect()
    assert (long_["size"], long_["target"], len(long_["copies"])) == (300_000, 300_000.0, 1)


def test_shards_are_written_in_their_order(spark, tmp_path):
    df, _ = sources_table(spark, 300)
    mixed = source_mixing.mix(df, shards=3)
    source_mixing.write_shards(mixed, f"file://{tmp_path}/mix")
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    assert back.count() == mixed.count() and {r["mix_shard"] for r in back.select("mix_shard").distinct().collect()} == {0, 1, 2}
