"""Packing of token sequences by minimum bin slack (operator 5).

Documents become token ids with an end id; longer ones are cut into pieces of the sequence length, of which the first
may be shorter. What the packing needs of the corpus is one number for each piece length, so the histogram of lengths
(as many entries as a sequence has tokens) is gathered, and bins are planned on it: a bitset of the sums that subsets
of the available lengths reach, one shift for each length and power of two of its count, tells the fullest feasible
bin; walking back through the bitsets gives a combination. It is taken as often as its lengths last, so each plan
entry uses up a length and their number is bounded by twice the sequence length, whatever the corpus.

Each plan entry owns a range of sequences; each piece finds its place from its rank among the pieces of its length.
Ranks come from counts per (length, part of the input), so no length, however frequent, is gathered in one task.

Defined results: null text is empty, a piece of the end id alone; ids that repeat are separate documents; an empty
table gives no rows; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.common import materialize, need, tokenizer_file

LENGTH = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
BROADCAST_ROWS = 500_000
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary, as its file for the tokenizers library defines them.

    Ordinary text goes through the ranks of the same vocabulary, several times as fast; a text that holds the special
    token's string goes through the tokenizers library, which reads it as one token."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        with open(tokenizer_file(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def ids(self, text: str) -> np.ndarray:
        if _SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(tokenizer_file(f"{self.vocabulary}.json"))
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of the full length but the first, which may be shorter."""
    first = n % length or min(n, length)
    return [(0, first)] + [(a, length) for a in range(first, n, length)] if n else []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32 bits) or their ids_crc32, and part, rank: the
    task that made the piece and its rank there among the pieces of its length."""
    source = need(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        seen = np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(enc.ids(text if isinstance(text, str) else ""), np.uint32(end_id)).astype("<u4")
                for k, (a, n) in enumerate(cut(len(ids), length)):
                    data = ids[a : a + n].tobytes()
                    out.append((doc, k, a, n, data if with_ids else zlib.crc32(data), part, int(seen[n])))
                    seen[n] += 1
                    held += n
                if held > 1_000_000:
                    yield _frame(out, with_ids)
                    out, held = [], 0
            yield _frame(out, with_ids)

    payload = "ids binary" if with_ids else "ids_crc32 long"
    return source.mapInPandas(run, f"doc_id {id_type}, piece int, start long, length long, {payload}, part int, rank long")


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "part", "rank"])


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, how many such bins)] for so many pieces of each length: minimum bin slack."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= length for n in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    out: list[tuple[list[int], int]] = []
    whole = (1 << (length + 1)) - 1
    while left:
        # the longest piece left opens the bin, as every bin must hold some piece and long ones fit worst
        top = max(left)
        room = length - top
        steps: list[tuple[int, int, int]] = []  # (length, copies, sums before)
        sums = 1
        for n in sorted((n for n in left if n <= room), reverse=True):
            have = min(left[n] - (n == top), room // n)
            k = 1
            while have > 0 and not sums >> room & 1:
                k = min(k, have)
                steps.append((n, k, sums))
                sums |= sums << (n * k) & whole
                have -= k
                k *= 2
            if sums >> room & 1:
                break
        best = (sums & ((1 << (room + 1)) - 1)).bit_length() - 1
        combination = [top]
        for n, k, before in reversed(steps):
            if not before >> best & 1:
                combination += [n] * k
                best -= n * k
        need_of: dict[int, int] = {}
        for n in combination:
            need_of[n] = need_of.get(n, 0) + 1
        times = min(left[n] // k for n, k in need_of.items())
        for n, k in need_of.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((combination, times))
    return out


def slots(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """One row for each kind of piece in each plan entry: pieces of `length` with ranks from `rank` to `rank` + `n` - 1
    go to sequences from `sequence` on, `each` of them in one, at offset `offset` + place * length."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for combination, times in bins:
        offset = 0
        i = 0
        while i < len(combination):
            n = combination[i]
            each = 1
            while i + each < len(combination) and combination[i + each] == n:
                each += 1
            rows.append((n, used.get(n, 0), each * times, sequence, each, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
            i += each
        sequence += times
    frame = pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "each", "offset"])
    return frame.sort_values(["length", "rank"], ignore_index=True)


def place(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """found: a written table as pieces() returns it. Adds sequence_id and offset."""
    spark = found.sparkSession
    per_part = materialize(found.groupBy("length", "part").count(), "packing-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(plan(histogram, length))
    starts = per_part.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    if per_part.count() <= BROADCAST_ROWS:  # of four numbers each; beyond, a join by key
        starts = F.broadcast(starts)
    ranked = found.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table.columns})

    @F.pandas_udf("sequence_id long, offset long")
    def spot(lengths: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = shared.value
        keys = (t["length"] << 48) + t["rank"]  # lengths and ranks in one number: ranks stay below 2^48
        for length_, rank_ in lengths:
            n, rank = length_.to_numpy(np.int64), rank_.to_numpy(np.int64)
            at = np.searchsorted(keys, (n << 48) + rank, side="right") - 1
            inside = rank - t["rank"][at]
            yield pd.DataFrame({"sequence_id": t["sequence"][at] + inside // t["each"][at], "offset": t["offset"][at] + inside % t["each"][at] * n})

    # Python sees two numbers of each piece; ids stay where they are
    columns = [c for c in ranked.columns if c != "rank"]
    return ranked.withColumn("_spot", spot.asNondeterministic()("length", "rank")).select(*columns, "_spot.sequence_id", "_spot.offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (or ids_crc32), sequence_id, offset."""
    found = materialize(pieces(docs, id_col, text_col, length, end_id, vocabulary, with_ids), "packing-pieces", "zstd")
    return place(found, length)
