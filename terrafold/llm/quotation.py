"""Chat formatting by quotation linking (operator 3), in DataFrame operations only.

Lines that begin with quote marks (`>`, nested by repetition) are parsed into levels; runs of lines of one level are a
passage. A passage is normalised (marks off, lower case, white space collapsed) and hashed, as a whole and line by
line, and joined by hash to the bodies, paragraphs and lines of the earlier messages of its conversation; the source
is the latest message that holds the whole passage, else the one that holds most of its lines' characters, the latest
of equals. Passages without a source there are joined by the hash of the whole passage to the first message of any
other conversation with that body. A message replies to
the source of its outermost passages. Following replies to their first message gives threads; a conversation is
ordered by thread, then by turn, so that each message comes after what it answers. Quoted lines, and the attribution
line before them, are left out of the body.

Skew: whole passages, and the most common line of each other passage, meet the latest message with that hash alone, so
a common line does not multiply; of a passage's other lines, those by which a message could still win meet every message
with them, once for all passages of the conversation that have the same lines. Far links join by hash against
one row per hash; positions come from a range partitioning and per-partition offsets, so a conversation that holds a third of
all messages is ordered in many tasks. Threads are followed by pointer doubling (rounds: logarithm of the depth).

Defined results: lines of any length link, empty ones do not; null text has a null body and no quotes; very long texts
are parsed whole, in one row each; a body of quotes alone is empty; messages that repeat a
(conversation, turn) are separate rows and share their place's links, taken from the least text; null ids are not
linked and stand alone; an empty table gives no rows; other columns are kept aside (ignored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.common import materialize, need

MARKS = r"^(?:[ \t]*>)+[ \t]?"
# How lines end that say who is quoted, in the languages at hand.
ATTRIBUTION = r"(?i)(?:wrote|said|schrieb|sagte|a écrit|escribió|dijo)\s*:\s*$"
SPAN = 1_000


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Array of (level, content) of a text's lines; level 0 is the author's own."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct(
            (F.length(F.regexp_extract(x, MARKS, 0)) - F.length(F.translate(F.regexp_extract(x, MARKS, 0), ">", ""))).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("content"),
        ),
    )


def _body(lines: Column) -> Column:
    """The author's own lines, without attributions of the quotes after them."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")


def parse(messages: DataFrame) -> DataFrame:
    """messages with body, quoted (whether it has quote lines) and lines (null without any)."""
    text = F.col("text")
    quoted = F.coalesce(text.rlike(r"(?m)^[ \t]*>"), F.lit(False))
    found = messages.withColumn("quoted", quoted).withColumn("lines", F.when(F.col("quoted"), _lines(text)))
    return found.withColumn("body", F.when(F.col("quoted"), _body(F.col("lines"))).otherwise(F.regexp_replace(text, r"^\s+|\s+$", "")))


def passages(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, passage (its first line's number), level, text and lines (normalised) of each quoted passage."""
    lines = parsed.where("quoted").select("conv_id", "turn", F.posexplode("lines").alias("at", "line")).select("conv_id", "turn", "at", "line.level", "line.content")
    order = Window.partitionBy("conv_id", "turn").orderBy("at")
    runs = lines.withColumn("new", (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = runs.where("level > 0").groupBy("conv_id", "turn", "run", "level").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("rows"))
    return runs.select(
        "conv_id", "turn", F.col("rows")[0]["at"].alias("passage"), "level",
        normalized(F.array_join(F.transform("rows", lambda x: x["content"]), "\n")).alias("text"),
        F.transform("rows", lambda x: normalized(x["content"])).alias("lines"),
    ).where(F.length("text") > 0)


def _units(parsed: DataFrame) -> DataFrame:
    """What passages can quote: hashes of bodies, paragraphs and lines, with every message that has them."""
    parts = F.concat(F.array(F.col("body")), F.split("body", r"\n\s*\n"), F.split("body", "\n"))
    units = parsed.where(F.length("body") > 0).select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normalized))).alias("unit"))
    return units.where(F.length("unit") > 0).select("conv_id", "turn", F.xxhash64("unit").alias("hash"))


def _before(facts: DataFrame, asks: DataFrame) -> DataFrame:
    """facts: conv_id, hash, turn, value; for each (conv_id, hash, turn) of asks the greatest value with that hash at an
    earlier turn, where there is one.

    Turns go by spans of SPAN: one window inside a span, one over the spans, so that no task holds all of a common line."""
    asks = asks.select("conv_id", "hash", "turn").distinct()
    both = facts.select("conv_id", "hash", "turn", "value", F.lit(False).alias("asks"))
    both = both.unionByName(asks.withColumn("value", F.lit(None).cast(facts.schema["value"].dataType)).withColumn("asks", F.lit(True)))
    both = both.withColumn("span", F.floor(F.col("turn") / SPAN))
    earlier = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max("value").over(earlier)).where("asks").select("conv_id", "hash", "turn", "span", "near")
    spans = both.groupBy("conv_id", "hash", "span").agg(F.max("value").alias("value"))
    before = Window.partitionBy("conv_id", "hash").orderBy("span").rangeBetween(Window.unboundedPreceding, -1)
    far = spans.withColumn("far", F.max("value").over(before)).select("conv_id", "hash", "span", "far")
    found = inside.join(far, ["conv_id", "hash", "span"])
    value = F.greatest("near", "far")  # NULL counts for nothing
    return found.select("conv_id", "hash", "turn", value.alias("value")).where(F.col("value").isNotNull())


def _latest(units: DataFrame, asks: DataFrame) -> DataFrame:
    """For each (conv_id, hash, turn) of asks the latest earlier turn with that hash, as source_turn, where there is one."""
    return _before(units.select("conv_id", "hash", "turn", F.col("turn").alias("value")), asks).withColumnRenamed("value", "source_turn")


def _by_lines(rest: DataFrame, units: DataFrame) -> DataFrame:
    """conv_id, turn, passage, source_turn: the earlier message that holds most characters of a passage's lines, the latest
    of equals.

    Passages of a conversation with the same lines ask together, as one set, so a set of lines meets each message once
    however often it is quoted; a passage then takes the greatest score before it, and the latest message with that
    score. Of a set's lines, from the rarest on, only those meet all messages with them that a message without any rarer
    line could still win by; the most common one only proposes the latest message with it, which is the best of those
    that hold no other line."""
    place, group = ["conv_id", "turn", "passage"], ["conv_id", "set"]
    by_line = F.array_sort(F.array_distinct(F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).cast("long").alias("chars")))))
    asked = rest.select(*place, by_line.alias("keys")).withColumn("set", F.xxhash64(F.transform("keys", lambda x: x["hash"])))
    sets = asked.groupBy(*group).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.first("keys").alias("keys"))
    lines = sets.select(*group, "first", "last", F.explode("keys").alias("key")).select(*group, "first", "last", "key.hash", "key.chars")
    lines = lines.join(units.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n")), ["conv_id", "hash"])
    rarest = Window.partitionBy(*group).orderBy("n", "hash")
    lines = lines.select(
        "*", F.row_number().over(rarest).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("of"),
        F.sum("chars").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("from_here"),
    )
    lines = materialize(lines.withColumn("common", F.col("rank") == F.col("of")), "quote-lines")
    has = units.select("conv_id", "hash", F.col("turn").alias("source_turn"))

    def credit(candidates: DataFrame, some: DataFrame) -> DataFrame:
        """The characters of those lines that each candidate (conv_id, set, source_turn) holds, a row a line."""
        held = candidates.join(some.select(*group, "hash", "chars"), group).join(has, ["conv_id", "hash", "source_turn"])
        return held.select(*group, "source_turn", "chars")

    # what every passage of a set reaches at least: the latest message with its rarest or its most common line before all of them
    asks = lines.where("rank = 1 OR common").select(*group, "hash", F.col("first").alias("turn"))
    sure = asks.join(_latest(units, asks), ["conv_id", "hash", "turn"]).select(*group, "source_turn").distinct()
    reached = credit(sure, lines).groupBy(*group, "source_turn").agg(F.sum("chars").alias("chars")).groupBy(*group).agg(F.max("chars").alias("reached"))
    lines = lines.join(reached, group, "left").withColumn("asks", ~F.col("common") & ((F.col("rank") == 1) | (F.col("from_here") >= F.coalesce("reached", F.lit(0)))))
    lines = materialize(lines, "quote-sets")
    met = lines.where("asks").join(has, ["conv_id", "hash"]).where(F.col("source_turn") < F.col("last")).select(*group, "source_turn", "chars")
    met = materialize(met, "quote-met")
    scored = met.unionByName(credit(met.select(*group, "source_turn").distinct(), lines.where("NOT asks")))
    scored = scored.groupBy(*group, "source_turn").agg(F.sum("chars").alias("chars"))
    scored = materialize(scored.select("conv_id", F.col("set").alias("hash"), F.col("source_turn").alias("turn"), F.col("chars").alias("value")), "quote-scores")
    ours = asked.select(*place, "set").join(lines.where("common").select(*group, F.col("hash").alias("common"), F.col("chars").alias("common_chars")), group)
    ours = materialize(ours, "quote-asked")
    last = _latest(units, ours.select("conv_id", F.col("common").alias("hash"), "turn")).select("conv_id", F.col("hash").alias("common"), "turn", F.col("source_turn").alias("of_common"))
    best = _before(scored, ours.select("conv_id", F.col("set").alias("hash"), "turn")).select("conv_id", F.col("hash").alias("set"), "turn", F.col("value").alias("score"))
    best = materialize(best, "quote-best")
    with_score = scored.select("conv_id", F.xxhash64("hash", "value").alias("hash"), "turn")
    at_best = _latest(with_score, best.select("conv_id", F.xxhash64("set", "score").alias("hash"), "turn")).select("conv_id", F.col("hash").alias("key"), "turn", F.col("source_turn").alias("of_best"))
    best = best.withColumn("key", F.xxhash64("set", "score")).join(at_best, ["conv_id", "key", "turn"]).drop("key")
    found = ours.join(last, ["conv_id", "common", "turn"], "left").join(best, ["conv_id", "set", "turn"], "left")
    score, common = F.coalesce("score", F.lit(0)), F.when(F.col("of_common").isNotNull(), F.col("common_chars")).otherwise(0)
    source = F.when(score > common, F.col("of_best")).when(score < common, F.col("of_common")).otherwise(F.greatest("of_best", "of_common"))
    return found.select(*place, source.alias("source_turn")).where(F.col("source_turn").isNotNull())


def link(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """found: passages. Returns conv_id, turn, passage, level, source_conv, source_turn; null where no source is known."""
    place = ["conv_id", "turn", "passage"]
    hashed = found.select(*place, "level", "lines", F.xxhash64("text").alias("hash"))
    asked = hashed.select("conv_id", F.explode(F.concat(F.array("hash"), F.transform("lines", lambda x: F.xxhash64(x)))).alias("hash")).distinct()
    units = materialize(_units(parsed).join(asked, ["conv_id", "hash"], "left_semi").distinct(), "quote-units")
    # a message with the whole passage holds all its characters
    whole = materialize(hashed.join(_latest(units, hashed), ["conv_id", "hash", "turn"], "left"), "quote-whole")
    lines = _by_lines(whole.where("source_turn is null"), units).withColumnRenamed("source_turn", "by_lines")
    linked = whole.join(lines, place, "left").select(*place, "level", "hash", F.coalesce("source_turn", "by_lines").alias("source_turn"))
    linked = materialize(linked, "quote-linked")
    open_ = linked.where("source_turn is null").select("hash").distinct()
    bodies = parsed.where(F.length("body") > 0).select("conv_id", "turn", F.xxhash64(normalized(F.col("body"))).alias("hash")).join(open_, "hash", "left_semi")
    # the first body of each of the two first conversations: one of them is not the passage's own
    each = bodies.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    each = materialize(each, "quote-bodies")
    first = each.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("one"))
    second = each.join(first, "hash").where(F.col("conv_id") != F.col("one.conv_id")).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("two"))
    first = first.join(second, "hash", "left")
    out = linked.join(first, "hash", "left").withColumn("first", F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two")))
    outside = F.col("first").isNotNull()
    return out.select(
        "conv_id", "turn", "passage", "level",
        F.when(F.col("source_turn").isNotNull(), F.col("conv_id")).when(outside, F.col("first.conv_id")).alias("source_conv"),
        F.coalesce("source_turn", F.when(outside, F.col("first.turn"))).alias("source_turn"),
    )


def threads(links: DataFrame) -> DataFrame:
    """links: conv_id, turn, reply_to_turn (an earlier turn of the conversation). Adds thread_turn, the first message
    that replies lead to, and reply_depth."""
    now = links.select("conv_id", "turn", "reply_to_turn", F.col("reply_to_turn").alias("up"), F.lit(1).cast("long").alias("steps"))
    while not now.isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        nxt = now.join(above, ["conv_id", "up"], "left")
        nxt = nxt.select("conv_id", "turn", "reply_to_turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved"))
        nxt = materialize(nxt, "quote-threads")
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return now.select("conv_id", "turn", "reply_to_turn", F.col("up").alias("thread_turn"), F.col("steps").alias("reply_depth"))


def reply_order(rows: DataFrame, keys: list[str], group: str, name: str) -> DataFrame:
    """rows with `name`, the position of each row in its group by keys: no task holds a whole group."""
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "reply-order")
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the number of partitions
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    global_ = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_pos", F.col("_start") + inside)
    heads = global_.groupBy(group).agg(F.min("_pos").alias("_head"))
    return global_.join(heads.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_pos") - F.col("_head")).cast("long")).drop("_at", "_part", "_start", "_pos", "_head", "_group")


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, body (without quotes), n_quotes, n_linked, reply_to_conv,
    reply_to_turn, thread_turn, reply_depth (0: answers nothing), reply_order (from 0 in its conversation)."""
    parsed = parse(need(messages, "conv_id", "turn", "role", "text"))
    parsed = materialize(parsed.drop("text"), "quote-parsed")
    known = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = known.where("quoted")
    # of rows that repeat a place the one with the least text speaks for it
    speakers = quoting.groupBy("conv_id", "turn").agg(F.min("lines").alias("lines")).withColumn("quoted", F.lit(True))
    found = materialize(passages(speakers), "quote-passages")
    links = materialize(link(known, found), "quote-links")
    outer = links.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("source_turn").alias("n_linked"),
        F.min(F.when(F.col("source_turn").isNotNull(), F.struct("level", (F.col("source_conv") != F.col("conv_id")).alias("far"), (-F.col("source_turn")).alias("late"), F.col("source_conv").alias("conv"), F.col("source_turn").alias("source")))).alias("to"),
    ).select("conv_id", "turn", "n_quotes", "n_linked", F.col("to.conv").alias("reply_to_conv"), F.col("to.source").alias("reply_to_turn"))
    chains = threads(outer.where(F.col("reply_to_conv") == F.col("conv_id")).select("conv_id", "turn", "reply_to_turn"))
    facts = outer.join(chains.drop("reply_to_turn"), ["conv_id", "turn"], "left")
    rows = parsed.join(facts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to_conv", "reply_to_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
    )
    return reply_order(rows, ["conv_id", "thread_turn", "turn", "role", "body"], "conv_id", "reply_order")
