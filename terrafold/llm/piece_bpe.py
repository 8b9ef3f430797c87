"""Encoding and decoding with a SentencePiece BPE model by a table of last tokens (operator 10).

For every prefix of a text the merges lead to one encoding, so each prefix has one last token. An automaton over the
vocabulary gives the pieces that end at each place; the one that may follow the last token of the prefix before it is
the prefix's last token. Two tokens may stand next to each other when merging their text alone gives just these two.
The ids are recovered backwards from the end of the table.

Merges never cross a place where no piece has the two characters at hand side by side (nor a word's beginning, when
only runs of the space mark hold it elsewhere than in front; both are read off the model). So a text falls apart into
units that are encoded by themselves, and each worker process remembers those it has met, up to a fixed number.
Runs of space marks merge last, equal scores from the left, as the library does.

Defined results: null and empty texts give the end id alone and decode to the empty text; characters without a piece
become byte pieces; U+2581 reads as a space, as in the library; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from terrafold.llm.common import need, tokenizer_file

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_WORDS = 300_000
_UNITS = 400_000
_LONG = 48


def read_model(path: str) -> dict:
    """The pieces, scores and types of a model file, and what of its normalisation matters here."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, trainer = model.normalizer_spec, model.trainer_spec
    if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and trainer.byte_fallback):
        raise ValueError("only BPE models with byte pieces, a dummy prefix and no other normalisation are read")
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not read")
    return {"pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "types": [p.type for p in model.pieces]}


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick

        m = read_model(path)
        self.pieces: list[str] = m["pieces"]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.end_id = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        for i, (piece, score, kind) in enumerate(zip(m["pieces"], m["scores"], m["types"])):
            if kind == 6:
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif kind == 1:
                self.rank[piece], self.ids[piece] = -score, i
        self.control = {i for i, kind in enumerate(m["types"]) if kind in (2, 3)}
        inner = [p for p in self.rank if SPACE in p[1:]]
        if any(set(p) != {SPACE} for p in inner):
            raise ValueError("a piece has a space mark inside: words cannot be told apart")
        self.runs = {len(p): self.ids[p] for p in [SPACE, *inner] if p in self.ids}
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.formed: list[float] = [-1.0] * len(self.pieces)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p not in inner and self._merged(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
                if len(p) > 1:
                    self.formed[i] = self.rank[p]
                    self.halves[i] = self._last_merge(p)
        self.automaton.make_automaton()
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.units: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str, bool]] = {}
        self.old_words: dict[str, tuple[int, str, str, bool]] = {}
        self.run_ids: dict[int, list[int]] = {}

    def _last_merge(self, piece: str) -> tuple[int, int]:
        """The two tokens whose merge makes the piece."""
        left, right = self._merged(piece, 2)
        return left, right

    def _merged(self, text: str, until: int = 1) -> list[int]:
        """Ids by merging itself, down to so many parts, for a text of a few characters."""
        parts = list(text)
        rank = self.rank
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the text of both gives just both: no merge across the place between them comes before the
        merges that hide its two sides. These are undone from the last; of equal merges the left one comes first."""
        key = first << 32 | second
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self._meet(first, second)
        return found

    def _meet(self, a: int, b: int) -> bool:
        rank, pieces, formed, halves = self.rank, self.pieces, self.formed, self.halves
        limit, shared = float("inf"), False
        while True:
            across = rank.get(pieces[a] + pieces[b])
            if across is not None and (across < limit or shared and across == limit):
                return False
            x, y = formed[a], formed[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, shared, a = x, False, halves[a][1]
            else:
                limit, shared, b = y, True, halves[b][0]

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit: last token of each prefix, then backwards."""
        n = len(unit)
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [0] * (n + 1)
        done = 0
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(unit):
            end += 1
            if end <= done:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | token)
                if not (self.compatible(before, token) if ok is None else ok):
                    continue
            last[end], size[end], done = token, length, end
        if last[n] < 0:
            out = self._bytes(unit) if n == 1 else self._by_parts(unit, last)
        else:
            back, at = [], n
            while at:
                back.append(last[at])
                at -= size[at]
            out = tuple(reversed(back))
        return out

    def _unit(self, unit: str) -> tuple[int, str, str]:
        """Of a unit: number of ids, the ids as text, their decoded text. A unit never ends inside a character."""
        found = self.units.get(unit)
        if found is None:
            ids = self.encode_unit(unit)
            decimal, shown = self.decimal, self.shown
            text = self._pieces_text(ids) if any(i in self.byte_of for i in ids) else "".join([shown[i] for i in ids])
            found = (len(ids), " ".join([decimal[i] for i in ids]), text)
            if len(unit) <= _LONG:
                if len(self.units) >= _UNITS:
                    self.units.clear()
                self.units[unit] = found
        return found

    def _bytes(self, unit: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in unit.encode("utf-8", "replace"))

    def _by_parts(self, unit: str, last: list[int]) -> tuple[int, ...]:
        """A unit whose prefix has no last token holds a character without a piece of its own."""
        for k, ch in enumerate(unit):
            if ch not in self.ids:
                head = self.encode_unit(unit[:k]) if k else ()
                tail = self.encode_unit(unit[k + 1 :]) if k + 1 < len(unit) else ()
                return head + self._bytes(ch) + tail
        raise AssertionError(f"no encoding of {unit!r}")

    def _word(self, word: str) -> tuple[int, str, str, bool]:
        """Of a space mark with the characters after it: as _unit, and whether the mark stands alone."""
        text = SPACE + word
        joined = self.joined
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in joined]
        alone = self.decimal[self.runs[1]]
        if not cuts:
            n, ids, shown = self._unit(text)
        else:
            parts = [self._unit(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
            n, ids, shown = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), "".join([p[2] for p in parts])
        return n, ids, shown, ids.startswith(alone + " ") or ids == alone

    def run(self, n: int) -> list[int]:
        """Ids of n space marks on end: equal scores, so the leftmost pair that forms a piece merges first."""
        found = self.run_ids.get(n)
        if found is None:
            found = self._run(n)
            if len(self.run_ids) < 10_000:
                self.run_ids[n] = found
        return found

    def _run(self, n: int) -> list[int]:
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        score = {len(p): self.rank[p] for p in self.rank if set(p) == {SPACE}}
        heap: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and size[a] + size[b] in self.runs:
                heapq.heappush(heap, (score[size[a] + size[b]], a, b, size[a], size[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if size[a] != x or size[b] != y or nxt[a] != b:
                continue
            size[a], size[b], nxt[a] = x + y, 0, nxt[b]
            if nxt[a] < n:
                prev[nxt[a]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        return [self.runs[s] for s in size if s]

    def decode(self, ids) -> str:
        """The text of ids; control ids have none, byte pieces on end are read as UTF-8."""
        text = self._pieces_text(ids)
        return text[1:] if text.startswith(" ") else text

    def _pieces_text(self, ids) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def _entry(self, word: str) -> tuple[int, str, str, bool]:
        """Of a word that is not in the younger half of the cache; what was met since the last turn stays."""
        found = self.old_words.get(word) or self._word(word)
        if len(word) <= _LONG:
            if len(self.words) >= _WORDS:
                self.old_words = dict(self.words)
                self.words.clear()
            self.words[word] = found
        return found

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, all ids in decimal with spaces between, and the decoded text."""
        n, ids, decoded = 1, [], []
        if text:
            words, entry = self.words, self._entry
            spaces = 0
            for word in text.replace(SPACE, " ").split(" "):
                if not word:
                    spaces += 1
                    continue
                found = words.get(word) or entry(word)
                if spaces:
                    count, own, shown, alone = found
                    run = self.run(spaces + alone)
                    n += len(run) + count - alone
                    ids += map(str, run)
                    decoded.append(self._pieces_text(run))
                    if alone:
                        own, shown = own[own.index(" ") + 1 :], shown[1:]
                    ids.append(own)
                    decoded.append(shown)
                    spaces = 0
                else:
                    n += found[0]
                    ids.append(found[1])
                    decoded.append(found[2])
            if spaces:
                run = self.run(spaces)
                n += len(run)
                ids += map(str, run)
                decoded.append(self._pieces_text(run))
        ids.append(str(self.end_id))
        return n, " ".join(ids), "".join(decoded)[1:] if decoded else ""

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text)[1].split(" ")]


def _utf8(data: bytearray) -> str:
    return bytes(data).decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (decimal, one space between, the end id last), decoded."""
    source = need(docs, id_col, text_col).withColumnsRenamed({id_col: "doc_id", text_col: "text"})
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(tokenizer_file(model))
        for batch in batches:
            done = [own.encode_text(t if isinstance(t, str) else "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [d[0] for d in done], "ids": [d[1] for d in done], "decoded": [d[2] for d in done]})

    return source.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, n_tokens long, ids string, decoded string")
