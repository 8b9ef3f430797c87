"""N-gram Jaccard self-join by a token-group matrix (operator 7).

A document is the set of its distinct word shingles, as 64-bit hashes. Documents link at a Jaccard similarity of
`percent` / 100 or more; the result names each document's component under links. Steps:

1. Equal sets form one class each; one representative goes on.
2. Representatives with a least hash (MinHash, two orders) in common are compared in blocks, breadth first against what
   is not reached yet, so that near copies cost about one comparison a member. Components found so far are known links.
3. Prefix tokens: of a set of n shingles that links to another one, the first n - ceil(n * percent / 100) + 1 in a fixed
   order must meet the other's. The order puts frequent shingles (counted over all documents) last, so that shared
   passages meet nobody. Tokens that only one component has are dropped, and documents without any token left are done.
4. Groups of similar documents: a component joins the group of the prefix token that most documents share among all that
   its members have. A group is cut into blocks of about `BLOCK` members or `BLOCK_TOKENS` shingles; components stay
   whole, and those of more than half a block get blocks of their own. So near copies that do not link to each other
   still lie together, and a group of them makes a few blocks, not as many groups as documents.
5. The token-group matrix has an entry for each prefix token and block, with the least and greatest size and component of
   the block's members that have the token. A document is a query against a block (its own too) when it has as many
   tokens in common with the block's token union as a link to a member of any size there would need; entries whose
   members are all in the document's own component count for nothing. Of two blocks the smaller one's members ask.
6. A block that is asked is opened: its members' shingle sets come to one task with at most about `ASKS` queries, which
   the bound of the whole token union thins out further, and components that link are joined there. A block and a
   component that are joined already are not compared again.

The outcome is exact: a link between components has common prefix tokens, enough of them, in entries that hold the other
component, so one of the two asks the other's block. What leaves a task is a query for each document and block, and at
most one edge for each component in a block, never a pair of documents; a family of m near copies that do not link makes
m queries for each of its m / BLOCK blocks. Lists of row numbers are broadcast below `BROADCAST_ROWS` rows of at most
four numbers (about 16 MB) and joined by key beyond; the list of frequent tokens has `MAX_FREQUENT` entries (8 MB) at
most and only orders tokens, any list gives the same result. Frequent tokens are dealt with a salt, others have few rows.

Defined results: null texts and texts without a word have no shingles and are components of themselves; a text with
fewer words than a shingle is one shingle; ids that repeat are separate rows, component_id is the least id of any row
in the component; an empty table gives no rows; other columns, whatever their names, are ignored (or kept by
drop_near_copies). Texts are read whole, long ones in slices; ties need no rule, as components have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import by_group, discard, materialize, need, with_row

WIDTH = 5
PERCENT = 80
BLOCK = 2048
BLOCK_TOKENS = 1_000_000
ASKS = 4096
SALTS = 64
FREQUENT = 50
MAX_FREQUENT = 1_000_000
BROADCAST_ROWS = 500_000
_SLICE = 500_000
_ENTRY = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3, 0x2545F4914F6CDD1D, 0xCA5A826395121157, 0x9FB21C651E98DF25], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
for _upper in range(ord("A"), ord("Z") + 1):
    _BYTE[_upper] = _BYTE[_upper + 32]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SLICE + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _some_sets(texts: list[str], width: int) -> list[np.ndarray]:
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts), np.int64, len(texts))
    heads = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    words = _mix((sums[end] - sums[begin]) * down[begin])
    first = np.searchsorted(begin, heads)
    last = np.append(first[1:], len(begin))
    place = _PLACE[np.arange(width) % len(_PLACE)] + np.arange(width, dtype=np.uint64) * np.uint64(2)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += words[k : k + n] * place[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * place[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, in order, worked out for about _SLICE characters at a time."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield from _some_sets(held, width)
            held, size = [], 0
    if held:
        yield from _some_sets(held, width)


def prefix_length(n: np.ndarray | int, percent: int):
    """How many of a set's first tokens must meet those of any set it links to."""
    return n - (n * percent + 99) // 100 + 1


def _linked(both: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return (both > 0) & (100 * both >= percent * (n + m - both))


def _long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class _Block:
    """Sets in order of their size, for counting overlaps with those in a range of sizes."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.ids = np.asarray(ids)[order]
        self.sets = [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        self._index()

    def _index(self) -> None:
        joined = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.union, self.token = np.unique(joined, return_inverse=True)
        self.owner = np.repeat(np.arange(len(self.sets)), self.n)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(len(self.union) + 1, dtype=bool)

    def overlap(self, tokens: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
        """First set whose size may link to so many tokens, and the overlaps from there on."""
        m = len(tokens)
        at = np.minimum(np.searchsorted(self.union, tokens), max(len(self.union) - 1, 0))
        at = at[self.union[at] == tokens] if len(self.union) else at[:0]
        lo = int(np.searchsorted(self.n * 100, m * percent))
        hi = int(np.searchsorted(self.n * percent, m * 100, side="right"))
        # the bound: what the union does not hold no member holds
        if lo >= hi or 100 * len(at) < percent * m:
            return lo, np.zeros(0, np.int64)
        self.mark[at] = True
        a, b = self.start[lo], self.start[hi]
        hit = self.mark[self.token[a:b]]
        out = np.bincount(self.owner[a:b][hit] - lo, minlength=hi - lo)
        self.mark[at] = False
        return lo, out

    def components(self, percent: int) -> np.ndarray:
        """For each set the place of the first one of its component, by search among those not reached yet."""
        root = np.full(len(self.sets), -1)
        rest = np.arange(len(self.sets))
        block = self
        while len(rest):
            queue = [0]
            found = np.zeros(len(rest), dtype=bool)
            found[0] = True
            searched = 0
            while queue:
                q = queue.pop()
                searched += 1
                lo, both = block.overlap(block.sets[q], percent)
                near = np.flatnonzero(_linked(both, block.n[lo : lo + len(both)], len(block.sets[q]), percent)) + lo
                new = near[~found[near]]
                found[new] = True
                queue += new.tolist()
                if found.all():
                    break
            root[rest[found]] = rest[0]
            keep = np.flatnonzero(~found)
            rest = rest[keep]
            if len(rest):
                inner = _Block.__new__(_Block)
                inner.ids, inner.sets, inner.n = block.ids[keep], [block.sets[i] for i in keep], block.n[keep]
                if found.sum() > 1 or len(keep) < 64:
                    inner._index()
                else:  # one set less: shorten the arrays instead of sorting again
                    cut = block.n[0]
                    inner.union, inner.token, inner.owner = block.union, block.token[cut:], block.owner[cut:] - 1
                    inner.start, inner.mark = block.start[1:] - cut, block.mark
                block = inner
        return root


def _facts(rows: DataFrame, width: int) -> DataFrame:
    """row, n, two signatures of the set, and its two least hashes under different orders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in shingle_sets(batch["text"].tolist(), width):
                if len(s):
                    other = s * np.uint64(0xD6E8FEB86659FD93)
                    out.append((len(s), int(_long(s).sum()), int(_long(_mix(s)).sum()), int(_long(s[:1])[0]), int(_long(other.min(keepdims=True))[0])))
                else:
                    out.append((0, 0, 0, 0, 0))
            frame = pd.DataFrame(out, columns=["n", "s1", "s2", "k1", "k2"])
            yield frame.assign(row=batch["row"].to_numpy())

    return rows.mapInPandas(run, "n long, s1 long, s2 long, k1 long, k2 long, row long")


def _frequent(rows: DataFrame, width: int, percent: int) -> np.ndarray:
    """The shingles that more than FREQUENT documents have among half again their prefix, MAX_FREQUENT at most: sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [s[: 3 * prefix_length(len(s), percent) // 2] for s in shingle_sets(batch["text"].tolist(), width) if len(s)]
            if parts:
                token, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"token": _long(token), "n": n})

    counts = rows.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    counts = materialize(counts, "jaccard-frequent")
    top = counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    discard(counts)
    return np.sort(top.view(np.uint64))


def _prefix_tokens(rows: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, row, common): each document's first tokens in the order that puts frequent ones (common) last."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = shared.value
        for batch in batches:
            tokens, owners, commons = [], [], []
            for row, s in zip(batch["row"], shingle_sets(batch["text"].tolist(), width)):
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    rare = s[~common][:p]
                    s = np.concatenate([rare, s[common][: p - len(rare)]])
                else:
                    s = rare = s[:p]
                tokens.append(s)
                owners.append(np.full(len(s), row, dtype=np.int64))
                commons.append(np.arange(len(s)) >= len(rare))
            if tokens:
                yield pd.DataFrame({"token": _long(np.concatenate(tokens)), "row": np.concatenate(owners), "common": np.concatenate(commons)})

    return rows.mapInPandas(run, "token long, row long, common boolean")


def _not_alone(tokens: DataFrame) -> DataFrame:
    """(token, row) of tokens that are common or that more than one row has: neighbours in a sort by token and row, read as
    a stream. Common tokens, which many rows may have, go through as they are, dealt over SALTS tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, int, bool] | None = None  # the last row so far: token, row, whether it goes on
        for batch in batches:
            if batch.empty:
                continue
            token, row, common = batch["token"].to_numpy(), batch["row"].to_numpy(), batch["common"].to_numpy(bool)
            same = token[1:] == token[:-1]
            met = common | np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if held is not None:
                if held[0] == token[0]:
                    met[0], held = True, (*held[:2], True)
                if held[2]:
                    yield pd.DataFrame({"token": [held[0]], "row": [held[1]]})
            yield pd.DataFrame({"token": token[:-1][met[:-1]], "row": row[:-1][met[:-1]]})
            held = (int(token[-1]), int(row[-1]), bool(met[-1]))
        if held is not None and held[2]:
            yield pd.DataFrame({"token": [held[0]], "row": [held[1]]})

    salt = F.when(F.col("common"), F.pmod(F.hash("row"), F.lit(SALTS))).otherwise(0)
    return tokens.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token", "row").select("token", "row", "common").mapInPandas(run, "token long, row long")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist(), width))
            yield pd.DataFrame({"row": batch["row"], "tokens": [s.tobytes() for s in sets]})

    return rows.mapInPandas(run, "row long, tokens binary")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns (node, label), label the least node of the component, for every node that has an edge."""
    both = materialize(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct(), "component-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "component-labels")
    while True:
        # the least label among a node's neighbours, then the label of that label
        seen = both.join(labels.select("node", "label"), F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("low"))
        lower = materialize(lower, "component-step")
        jump = lower.select(F.col("node").alias("at"), F.col("low").alias("next"))
        moved = lower.join(jump, lower["low"] == jump["at"], "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("next", "low")).alias("label"))
        moved = materialize(moved, "component-labels")
        done = moved.where("old <> label").isEmpty()
        discard(lower, labels)
        labels = moved
        if done:
            discard(both)
            return moved.select("node", "label")


def _group_edges(rows: DataFrame, percent: int) -> DataFrame:
    """rows: group, row, tokens. Inside each group, edges from each member to the first one of its local component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in by_group(batches, "group"):
            if len(part) < 2:
                continue
            block = _Block(part["row"].to_numpy(), [np.frombuffer(t, np.uint64) for t in part["tokens"]])
            root = block.components(percent)
            yield pd.DataFrame({"u": block.ids, "v": block.ids[root]})

    return rows.repartition("group").sortWithinPartitions("group", "row").mapInPandas(run, "u long, v long")


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix tokens two sets of sizes n and m that link must have in common, at least.

    Of the set whose prefix ends first at most (size - overlap) tokens are missing in the other, wherever they stand."""
    overlap = -(-(percent * (n + m)) // (100 + percent))
    return np.maximum(1, overlap + 1 - (percent * np.maximum(n, m) + 99) // 100)


def _least_of_sizes(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> np.ndarray:
    """The minimum of _least_overlap over all sizes from lo to hi.

    Up to n it grows with the size. Beyond n it falls, but for rounding: a size so many steps below hi that the fall is 1
    without rounding cannot have less than hi has."""
    least = _least_overlap(n, lo, percent)
    for k in range(-(-100 * (100 + percent) // percent**2)):
        least = np.minimum(least, _least_overlap(n, np.maximum(lo, hi - k), percent))
    return least


def _asked(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """part: row, n, comp, block, size (of the block), entries: of each of the row's tokens, and each block that has the
    token, six numbers: block, its size, least and greatest size and component of its members with the token.

    Returns (row, block): which of them each row has to ask."""
    lengths = part["entries"].map(len).to_numpy(np.int64) // _ENTRY
    if not lengths.sum():
        return pd.DataFrame({"row": np.zeros(0, np.int64), "block": np.zeros(0, np.int64)})
    entries = np.concatenate(part["entries"].to_list()).reshape(-1, _ENTRY)
    q = np.repeat(np.arange(len(part)), lengths)
    row, n, comp, block, size = (part[c].to_numpy(np.int64)[q] for c in ("row", "n", "comp", "block", "size"))
    e_block, e_size, low, high, comp_low, comp_high = entries.T
    lo, hi = np.maximum(low, -(-(n * percent) // 100)), np.minimum(high, n * 100 // percent)
    larger = (e_size > size) | ((e_size == size) & (e_block >= block))
    ok = np.flatnonzero(larger & (lo <= hi) & ((comp_low != comp) | (comp_high != comp)))
    least = _least_of_sizes(n[ok], lo[ok], hi[ok], percent)
    order = np.lexsort((e_block[ok], q[ok]))
    q, e_block, row, least = q[ok][order], e_block[ok][order], row[ok][order], least[order]
    heads = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (e_block[1:] != e_block[:-1])])) if len(q) else np.zeros(0, np.int64)
    if not len(heads):
        return pd.DataFrame({"row": row, "block": e_block})
    fine = heads[np.diff(np.append(heads, len(q))) >= np.minimum.reduceat(least, heads)]
    return pd.DataFrame({"row": row[fine], "block": e_block[fine]})


def _queries(entries: DataFrame, percent: int) -> DataFrame:
    """entries: one row a document, as _asked() reads them. Returns (row, block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _asked(batch, percent)

    return entries.mapInPandas(run, "row long, block long")


def _of_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose number is in wanted, a written table."""
    return rows.join(_small(wanted), "row", "left_semi")


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast while it has BROADCAST_ROWS rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """rows: place, kind (0 member, 1 member that asks, 2 other document that asks), row, comp, tokens. Members come
    first; edges (u, v) between components that link, or are joined by what the place has shown so far, once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in by_group(batches, "place"):
            kind, comps = part["kind"].to_numpy(), part["comp"].to_numpy(np.int64)
            inside = np.flatnonzero(kind < 2)
            asks = np.flatnonzero(kind > 0)
            if not len(inside) or not len(asks):
                continue
            sets = [np.frombuffer(t, np.uint64) for t in part["tokens"]]
            block = _Block(inside, [sets[i] for i in inside])
            names, root = np.unique(comps, return_inverse=True)  # root: of each row the component it is joined to here
            u, v = [], []
            for i in asks.tolist():
                if (root[block.ids] == root[i]).all():
                    continue
                lo, both = block.overlap(sets[i], percent)
                near = np.flatnonzero(_linked(both, block.n[lo : lo + len(both)], len(sets[i]), percent)) + lo
                for other in np.unique(root[block.ids[near]]).tolist():
                    mine = root[i]
                    if other != mine:
                        u.append(names[mine])
                        v.append(names[other])
                        root[root == other] = mine
            if u:
                yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return rows.repartition("place").sortWithinPartitions("place", "kind", "row").mapInPandas(run, "u long, v long")


def _blocks(active: DataFrame) -> DataFrame:
    """active: row, n, comp, lead (documents with the component's most shared token, that token). Returns row, n, comp,
    block and size, its number of members."""
    comps = active.groupBy("comp").agg(F.max("lead.token").alias("leader"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    comps = materialize(comps, "jaccard-comps")
    parts = F.ceil(F.greatest(F.sum("members") / BLOCK, F.sum("tokens") / BLOCK_TOKENS))
    own = F.greatest(F.col("members") / BLOCK, F.col("tokens") / BLOCK_TOKENS)
    groups = materialize(comps.where(own <= 0.5).groupBy("leader").agg(parts.alias("parts")), "jaccard-groups")
    placed = comps.where(own <= 0.5).join(_small(groups), "leader").select("comp", F.xxhash64("leader", F.pmod(F.xxhash64("comp"), "parts")).alias("block"), F.lit(1).cast("long").alias("parts"))
    placed = placed.unionByName(comps.where(own > 0.5).select("comp", F.xxhash64("comp", F.lit(-1)).alias("block"), F.ceil(own).alias("parts")))
    placed = materialize(placed, "jaccard-comp-blocks")
    block = F.when(F.col("parts") > 1, F.xxhash64("block", F.pmod(F.xxhash64("row"), "parts"))).otherwise(F.col("block"))
    rows = materialize(active.join(_small(placed), "comp").select("row", "n", "comp", block.alias("block")), "jaccard-row-blocks")
    sizes = materialize(rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "jaccard-sizes")
    out = materialize(rows.join(_small(sizes), "block").select("row", "n", "comp", "block", "size"), "jaccard-blocks")
    discard(comps, groups, placed, rows, sizes)
    return out


def _asking(tokens: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """tokens: token, row; blocks: as _blocks() returns them. The token-group matrix, and from it (row, block): queries."""
    placed = materialize(tokens.join(_small(blocks), "row").select("token", "row", "n", "comp", "block", "size"), "jaccard-placed")
    cells = placed.groupBy("token", "block").agg(F.max("size").alias("size"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "comp") for f in (F.min, F.max)])
    entry = F.array("block", "size", "min_n", "max_n", "min_comp", "max_comp")
    matrix = materialize(cells.groupBy("token").agg(F.flatten(F.collect_list(entry)).alias("entries")), "jaccard-matrix")
    of_row = placed.join(matrix, "token").groupBy("row").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    found = materialize(_queries(of_row.join(_small(blocks), "row"), percent), "jaccard-queries")
    discard(placed, matrix)
    return found


def _opened(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, kind, row, comp): the members of each block that is asked, and who asks it, in places of about ASKS queries."""
    about = _small(blocks)
    asks = materialize(queries.withColumnRenamed("block", "asked").join(about, "row").select("row", "n", "comp", "asked", (F.col("asked") == F.col("block")).alias("own")), "jaccard-asks")
    own = asks.where("own").select(F.col("asked").alias("block"), F.lit(0).cast("long").alias("slice"), F.lit(1).alias("kind"), "row", "comp")
    slices = F.ceil(F.greatest(F.count(F.lit(1)) / ASKS, F.sum("n") / BLOCK_TOKENS)).alias("slices")
    outside = materialize(asks.where("not own").groupBy(F.col("asked").alias("block")).agg(slices), "jaccard-asked")
    others = asks.where("not own").select(F.col("asked").alias("block"), "row", "comp").join(_small(outside), "block")
    others = others.select("block", F.pmod(F.xxhash64("row"), "slices").alias("slice"), F.lit(2).alias("kind"), "row", "comp")
    members = blocks.select("block", "row", "comp").join(_small(outside), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "row", "comp")
    # who asks the own block is a member of it: once, as one that asks
    inside = own.unionByName(members).groupBy("block", "slice", "row", "comp").agg(F.max("kind").alias("kind"))
    out = materialize(inside.unionByName(others).select(F.xxhash64("block", "slice").alias("place"), "kind", "row", "comp"), "jaccard-opened")
    discard(asks, outside)
    return out


def classes_of(numbered: DataFrame, row_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """numbered: docs with row_col, a number that tells rows apart. Returns row, n (size of its set), comp (the least row
    that links reach)."""
    rows = numbered.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    facts = materialize(_facts(rows, width), "jaccard-facts")
    classes = facts.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("rep"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    classes = materialize(classes, "jaccard-classes")

    # known links: inside blocks of one least hash
    reps = classes.select(F.col("rep").alias("row"), "n")
    keyed = classes.select(F.col("rep").alias("row"), "n", F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("k1").alias("k")), F.struct(F.lit(2).alias("o"), F.col("k2").alias("k")))).alias("key"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), parts.alias("parts")).where("size > 1")
    grouped = materialize(keyed.join(crowded, "key").select("row", F.xxhash64("key", F.pmod(F.xxhash64("row"), "parts")).alias("group")), "jaccard-grouped")
    listed = materialize(grouped.select("row").distinct(), "jaccard-listed")
    sets = materialize(_sets(_of_rows(rows, listed), width), "jaccard-sets", "uncompressed")
    first = materialize(_group_edges(_small(grouped).join(sets, "row").select("group", "row", "tokens"), percent), "jaccard-edges")
    labels = components(first)
    named = materialize(reps.join(labels, reps["row"] == labels["node"], "left").select("row", "n", F.coalesce("label", "row").alias("comp")), "jaccard-named")
    discard(grouped, listed, sets, first)

    # prefix tokens that more than one component has
    frequent = _frequent(rows, width, percent)
    tokens = materialize(_not_alone(_prefix_tokens(rows, frequent, width, percent)), "jaccard-tokens")
    owned = materialize(tokens.join(_small(named), "row").select("token", "row", "n", "comp"), "jaccard-owned")
    mixed = owned.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token", "documents")
    mixed = materialize(mixed, "jaccard-mixed")
    shared = materialize(owned.join(_small(mixed), "token"), "jaccard-shared")
    discard(tokens, owned, mixed)
    lead = F.max(F.struct("documents", "token")).alias("lead")
    of_comp = materialize(shared.groupBy("comp").agg(lead), "jaccard-leaders")
    active = shared.select("row", "n", "comp").distinct().join(_small(of_comp), "comp")
    blocks = _blocks(active)
    queries = _asking(shared.select("token", "row"), blocks, percent)
    opened = _opened(queries, blocks)
    listed = materialize(opened.select("row").distinct(), "jaccard-listed")
    sets = _sets(_of_rows(rows, listed), width)
    second = materialize(_open(_small(opened).join(sets, "row").select("place", "kind", "row", "comp", "tokens"), percent), "jaccard-links")
    merged = components(second)
    final = named.join(merged, named["comp"] == merged["node"], "left").select(F.col("row").alias("rep"), F.coalesce("label", "comp").alias("comp"))
    of_class = materialize(classes.select("n", "s1", "s2", "rep").join(final, "rep").select("n", "s1", "s2", "comp"), "jaccard-final")
    discard(shared, of_comp, blocks, queries, opened, listed, second, named, classes)
    return facts.select("row", "n", "s1", "s2").join(_small(of_class), ["n", "s1", "s2"], "left").select("row", "n", F.coalesce("comp", "row").alias("comp"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least id that links reach)."""
    numbered, row, unique = with_row(need(docs, id_col, text_col), id_col, "jaccard-rows")
    found = classes_of(numbered, row, text_col, width, percent)
    if unique:
        kind = docs.schema[id_col].dataType
        return found.select(F.col("row").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").cast(kind).alias("component_id"))
    found = found.join(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id")), "row")
    least = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the least id (or number, where ids repeat), with all its columns."""
    numbered, row, _ = with_row(docs, id_col, "jaccard-rows")
    found = classes_of(numbered, row, text_col, width, percent)
    gone = materialize(found.where("row <> comp").select(F.col("row").alias(row)), "jaccard-dropped")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
