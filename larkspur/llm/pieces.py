"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no vocabulary piece can cross (a run of spaces with the characters that
follow it, a line end), and these are cut again where two characters are neighbours in no piece. The
distinct segments of a batch that are not remembered are encoded together: flat symbol arrays, the least
pair rank of each segment by a segmented minimum, its leftmost pairs of that rank merged at once, arrays
compacted, until no segment has a pair left. One pair at a time is what the library does, and a merge can
form a pair that goes before the next one of the round's rank: where that happens, the segment's merges of
the round end there. Segments of any length take the same way. A text's decoded form is put together from
the surfaces of its ids.

Defined cases: a null or empty text has no ids and decodes to the empty string; a null doc_id stays
null; repeated rows give repeated rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import tune

SPACE = "▁"
CACHED = 100_000  #: segments a generation of a Python worker's memory holds
NONE = np.int64(1 << 30)


class PairTable:
    """(rank, merged symbol) by pair number: hashed slots, what collides going to a next table."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        key = np.array(sorted(pairs), np.int64)
        value = np.array([pairs[k] for k in key.tolist()], np.int64).reshape(-1, 2)
        self.bits = max(10, int(len(key) * 8).bit_length())
        self.levels = []
        odd = 0x9E3779B97F4A7C15
        while len(key):
            slot = self.slots(key, odd)
            _, first = np.unique(slot, return_index=True)
            keys = np.full(1 << self.bits, -2, np.int64)
            values = np.zeros((1 << self.bits, 2), np.int32)
            keys[slot[first]], values[slot[first]] = key[first], value[first]
            self.levels.append((odd, keys, values))
            rest = np.setdiff1d(np.arange(len(key)), first)
            key, value, odd = key[rest], value[rest], odd * 0xD1342543DE82EF95 & (1 << 64) - 1 | 1

    def slots(self, key: np.ndarray, odd: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank NONE where a pair does not merge; negative keys are no pairs."""
        rank, merged = np.full(len(key), NONE), np.full(len(key), -1, np.int64)
        todo = np.flatnonzero(key >= 0)
        for odd, keys, values in self.levels:
            slot = self.slots(key[todo], odd)
            held = keys[slot]
            hit = held == key[todo]
            got = values[slot[hit]]
            rank[todo[hit]], merged[todo[hit]] = got[:, 0], got[:, 1]
            todo = todo[~hit & (held != -2)]  # an empty slot ends the search
            if not len(todo):
                break
        return rank, merged


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in normal):
            raise ValueError("the model has pieces that go on after a space")
        piece = {names[i]: i for i in normal}
        chars = sorted({c for p in piece for c in p})
        #: symbols: every character of a piece, then every longer piece
        self.symbols = chars + [p for p in piece if len(p) > 1]
        number = {s: k for k, s in enumerate(self.symbols)}
        self.char = {c: number[c] for c in chars}
        self.ids = [piece.get(s, -1) for s in self.symbols]
        scores = sorted({lib.get_score(piece[s]) for s in self.symbols if len(s) > 1}, reverse=True)
        rank = {x: k for k, x in enumerate(scores)}
        pairs = {}
        for s in self.symbols[len(chars) :]:
            for cut in range(1, len(s)):
                a, b = number.get(s[:cut]), number.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a * len(number) + b] = (rank[lib.get_score(piece[s])], number[s])
        self.n = len(number)
        self.table = PairTable(pairs)
        beside = {number[p[i]] * len(chars) + number[p[i + 1]] for p in piece for i in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)  # characters that are neighbours in some piece
        self.n_chars = len(chars)
        self.surface = {i: s.replace(SPACE, " ").encode() for s, i in piece.items()} | {i: bytes([x]) for x, i in self.bytes.items()}
        self.surface_size = np.zeros(n, np.int64)
        for i, x in self.surface.items():
            self.surface_size[i] = len(x)
        self.id_text = [str(i) for i in range(n)]
        self.id_of = np.array(self.ids, np.int64)
        self.symbol_of = np.full(0x110000, -1, np.int64)
        self.symbol_of[[ord(c) for c in chars]] = [self.char[c] for c in chars]
        line = "" if "\n" in self.char else "\\n"
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))
        self.new: dict[str, tuple[str, str]] = {}  # segments in use, their ids in decimal and what these decode to
        self.old: dict[str, tuple[str, str]] = {}  # those of the generation before

    # ------------------------------------------------------------ merging

    def rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every segment (runs of equal ``word``; negative symbols never merge) until none has a pair."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pair(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.table.find(np.where(ok & (left >= 0) & (right >= 0), left * self.n + right, -1))

        def paired(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nxt = np.minimum(at + 1, len(sym) - 1)
            return pair(sym[at], sym[nxt], (word[nxt] == word[at]) & (nxt != at))

        rank, merged = paired(np.arange(len(sym)))
        while len(sym):
            starts = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            if not going.all():
                keep = np.repeat(going, sizes)
                done.append((word[~keep], sym[~keep]))
                sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
                best, sizes = best[going], sizes[going]
            if not len(sym):
                break
            # every other position of a run of best pairs, from its left
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            first = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            pos = hit[(hit - first) % 2 == 0]
            pos = pos[self.in_order(pos, sym, word, rank, merged, pair)]
            sym[pos] = merged[pos]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            pos = pos - np.arange(len(pos))
            for at in (pos, pos[pos > 0] - 1):
                rank[at], merged[at] = paired(at)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (word, sym)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    @staticmethod
    def in_order(pos: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray, pair) -> np.ndarray:
        """Which merges of a round go: a segment's, from the left, up to one that forms a pair of the same or a better rank."""
        w = word[pos]
        new = np.r_[True, w[1:] != w[:-1]]
        go = np.ones(len(pos), bool)
        some = np.flatnonzero(~new | np.r_[~new[1:], False])  # merges of segments with several
        if not len(some):
            return go
        p = pos[some]
        before = np.maximum(p - 1, 0)
        joined = np.r_[False, p[1:] == p[:-1] + 2] & ~new[some]  # the symbol before has just been merged
        left = np.where(joined, np.r_[0, merged[p[:-1]]], sym[before])
        after = np.minimum(p + 2, len(sym) - 1)
        a, _ = pair(left, merged[p], (p > 0) & (word[before] == word[p]))
        b, _ = pair(merged[p], sym[after], (after == p + 2) & (word[after] == word[p]))
        stops = np.minimum(a, b) <= rank[p]
        ended = np.cumsum(stops) - stops  # stops before each
        begin = np.maximum.accumulate(np.where(new[some], np.arange(len(some)), 0))
        go[some] = ended == ended[begin]
        return go

    # ------------------------------------------------------------ encode, decode

    def encode_flat(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments laid end to end, and each id's segment number."""
        sizes = np.array([len(x) for x in segments], np.int64)
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.symbol_of[code]
        sym = np.where(sym < 0, -1 - code, sym)  # a character in no piece never merges
        word = np.repeat(np.arange(len(segments)), sizes)
        key = sym[:-1] * self.n_chars + sym[1:]
        k = np.minimum(np.searchsorted(self.beside, key), max(0, len(self.beside) - 1))
        whole = (word[1:] == word[:-1]) & (sym[:-1] >= 0) & (sym[1:] >= 0) & (self.beside[k] == key if len(self.beside) else False)
        part = np.cumsum(np.r_[0, ~whole])[: len(sym)]
        of = word[np.flatnonzero(np.r_[True, ~whole])] if len(sym) else word
        sym, part = self.rounds(sym, part)
        word = of[part]
        ids = np.where(sym < 0, -1, self.id_of[np.maximum(sym, 0)])
        bad = np.flatnonzero(ids < 0)
        if len(bad):  # bytes in place of characters that have no piece
            spelled = [np.array([self.bytes[x] for x in (chr(-1 - v) if v < 0 else self.symbols[v]).encode()]) for v in sym[bad].tolist()]
            count = np.ones(len(ids), np.int64)
            count[bad] = [len(x) for x in spelled]
            where = np.repeat(ids < 0, count)
            ids, word = np.repeat(ids, count), np.repeat(word, count)
            ids[where] = np.concatenate(spelled)
        return ids, word

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the space that encoding puts in front."""
        return b"".join([self.surface.get(i, b"") for i in ids]).decode(errors="replace").removeprefix(" ")

    def split(self, text: str) -> list[str]:
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, segments: set[str]) -> None:
        """Remember the decimal ids of all these segments, and what these ids decode to.

        Once the new generation is full it becomes the old one, so segments in use stay.
        """
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        fresh = []
        for x in segments:
            if x and x not in new:
                known = old.get(x)
                if known is None:
                    fresh.append(x)
                else:
                    new[x] = known
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            ids, word = self.encode_flat(part)
            cut = np.searchsorted(word, np.arange(len(part) + 1))
            surface = b"".join([self.surface[i] for i in ids.tolist()])
            edge = np.r_[0, np.cumsum(self.surface_size[ids])][cut].tolist()
            cut = cut.tolist()
            text = [self.id_text[i] for i in ids.tolist()]
            for k, x in enumerate(part):
                new[x] = ",".join(text[cut[k] : cut[k + 1]]), surface[edge[k] : edge[k + 1]].decode(errors="replace")

    def forget(self) -> None:
        """Empty the memory: an idle Python worker would hold it while other stages run."""
        self.old, self.new = {}, {}

    def encode_text(self, segments: list[str]) -> tuple[str, str]:
        """Decimal ids of a split and learnt text, and what they decode to."""
        known = list(map(self.new.__getitem__, segments))
        return ",".join([x[0] for x in known]), "".join([x[1] for x in known]).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        segments = self.split(text)
        return self.encode_flat(segments)[0].tolist() if segments else []


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns of ``keep``; ``with_ids`` adds ids."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for b in batches:
                split = [m.split(t or "") for t in b.column("text").to_pylist()]
                m.learn(set().union(*split))
                n, ids_hash, text_hash, all_ids = [], [], [], []
                for segments in split:
                    ids, text = m.encode_text(segments)
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols + [b.column(c) for c in keep], names + list(keep))
        finally:
            m.forget()

    base = docs.select("doc_id", "text", *keep)
    kinds = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids, *(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)]
    return base.mapInArrow(run, ", ".join(kinds))
