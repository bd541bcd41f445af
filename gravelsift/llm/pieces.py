"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes U+2581 + text with every space as U+2581, cut where such a mark follows another character: no piece
of a merge-type vocabulary reaches over that border (checked when the model is read), so each run is merged alone and
the result of a run can be reused, once it has been compared with the library's. A run is a linked list of symbols; an agenda holds each adjacent pair that forms a
piece, ordered by score and then from the left; the best one is merged and its new neighbours are added. Short runs of an
Arrow batch are worked off side by side, long ones on a heap. A symbol
that is no piece ends as its UTF-8 bytes.

Null text: as an empty one (the end id alone). Empty table: no rows. Repeated rows and ids: a row each. Further columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import bounded_batches

MARK = "▁"
#: A run's number of ids, its ids as decimals joined by a space, and its ids.
Run = tuple[int, str, tuple[int, ...]]
#: A worker keeps at most so many runs; it then starts anew. Runs over SHORT characters aren't kept.
KEPT_RUNS, SHORT = 600_000, 32
#: So many texts are cut into runs at a time.
TEXTS = 1000
NEVER = np.iinfo(np.int32).max
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class PieceModel:
    """The vocabulary of a model file and the runs merged so far in this worker."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.path, self.library, self.end, self.unknown = path, sp, sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(m[1], 16): i for i in range(n) if sp.is_byte(i) and (m := _BYTE.match(self.pieces[i]))}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.order = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.digits = [str(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the space mark after another character: runs can't be merged alone")
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.cache: dict[str, Run] = {}
        ranks = {o: k for k, o in enumerate(sorted(set(self.order.values())))}
        pairs = {
            self.ids[p[:k]] * n + self.ids[p[k:]]: (ranks[self.order[p]], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        }
        self.n = n
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair_keys.tolist()], dtype=np.int64)

    def merge(self, run: str) -> list[int]:
        """The ids of one run, by the agenda. A symbol is its start and its length; the length is 0 once merged away."""
        get, n = self.order.get, len(run)
        size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(s, i, 2) for i in range(n - 1) if (s := get(run[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, length = heappop(agenda)
            j, own = right[i], size[i]
            if not own or j >= n or own + size[j] != length:
                continue  # one side has been merged since
            size[i], size[j] = length, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := get(run[i : i + length + size[k]])) is not None:
                    heappush(agenda, (s, i, length + size[k]))
            if (h := left[i]) >= 0 and (s := get(run[h : i + length])) is not None:
                heappush(agenda, (s, h, i + length - h))
        out: list[int] = []
        ids, i = self.ids, 0
        while i < n:
            symbol = run[i : i + size[i]]
            if (got := ids.get(symbol)) is not None:
                out.append(got)
            else:
                out += [self.bytes[b] for b in symbol.encode()]
            i += size[i]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no piece) and piece of the pairs of symbols a, b; a symbol below 0 is in no pair."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_rank[at], NEVER), self.pair_piece[at]

    def merge_many(self, runs: list[str]) -> list[list[int]]:
        """The ids of runs of one length: the agendas of all of them, as rows of ranks, are worked off side by side."""
        length = len(runs[0])
        points = np.frombuffer("".join(runs).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)
        chars, back = np.unique(points, return_inverse=True)
        own = np.array([self.ids.get(chr(c), -1 - int(c)) for c in chars.tolist()], dtype=np.int64)
        symbols = own[back.reshape(points.shape)]
        left = np.full(len(runs), length)
        if length > 1:
            rank, _ = self._pairs(symbols[:, :-1], symbols[:, 1:])
            rank = np.concatenate([rank, np.full((len(runs), 1), NEVER, dtype=np.int32)], axis=1)
            places = np.arange(length)
            live = np.flatnonzero(rank.min(axis=1) < NEVER)
            while len(live):
                r, s = rank[live], symbols[live]
                row, at = np.arange(len(live)), r.argmin(axis=1)
                s[row, at] = self._pairs(s[row, at], s[row, at + 1])[1]
                gone = places[None, :-1] > at[:, None]
                s[:, :-1] = np.where(gone, s[:, 1:], s[:, :-1])
                s[:, -1] = np.iinfo(np.int64).min
                r[:, :-1] = np.where(gone | (places[None, :-1] == at[:, None]), r[:, 1:], r[:, :-1])
                r[:, -1] = NEVER
                more = at + 1 < left[live] - 1
                r[row, at] = np.where(more, self._pairs(s[row, at], s[row, np.minimum(at + 1, length - 1)])[0], NEVER)
                some = np.flatnonzero(at > 0)
                r[some, at[some] - 1] = self._pairs(s[some, at[some] - 1], s[some, at[some]])[0]
                left[live] -= 1
                rank[live], symbols[live] = r, s
                live = live[r.min(axis=1) < NEVER]
        out = [row[:n] for row, n in zip(symbols.tolist(), left.tolist(), strict=True)]
        if (own < 0).any():
            out = [[x for i in row for x in ([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode()])] for row in out]
        return out

    def learn(self, runs: set[str]) -> None:
        """Merge the runs that aren't known yet: short ones side by side, by length, long ones one by one."""
        fresh = runs - self.cache.keys()
        if len(self.cache) + len(fresh) > KEPT_RUNS:
            self.cache, fresh = {}, runs
        by_length: dict[int, list[str]] = defaultdict(list)
        for run in fresh:
            if len(run) <= SHORT:
                by_length[len(run)].append(run)
        for group in by_length.values():
            made = self.merge_many(group)
            self.compare(group, made)
            for run, ids in zip(group, made, strict=True):
                self.cache[run] = self.entry(ids)

    def compare(self, runs: list[str], made: list[list[int]]) -> None:
        """Raise an error unless the library gives these runs the same ids: a text's ids are those of its runs."""
        own = self.library.encode([run[1:].replace(MARK, " ") for run in runs], num_threads=1)  # it puts the first mark itself
        for run, ids, other in zip(runs, made, own, strict=True):
            if ids != (other if run != MARK else [self.library.piece_to_id(MARK)]):  # it puts no mark before an empty text
                raise ValueError(f"these ids are not the library's: {run[:80]!r}")

    def entry(self, ids: list[int]) -> Run:
        digits = self.digits
        return len(ids), " ".join([digits[i] for i in ids]), tuple(ids)

    def runs(self, text: str) -> list[str]:
        if not text:
            return []
        return _RUN.findall(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> Iterator[list[Run]]:
        """The runs of each text; the end id isn't among their ids."""
        for k in range(0, len(texts), TEXTS):
            cut = [self.runs(t) for t in texts[k : k + TEXTS]]
            self.learn(set().union(*cut))
            for runs in cut:
                got = list(map(self.cache.get, runs))
                if None in got:
                    long = [r for g, r in zip(got, runs, strict=True) if g is None]
                    made = [self.merge(r) for r in long]
                    self.compare(long, made)
                    entries = map(self.entry, made)
                    got = [g or next(entries) for g in got]
                yield got

    def decode(self, ids: list[int]) -> str:
        """The text of ids: what they spell, without the leading space."""
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text

    def spelled(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8 (a wrong byte: U+FFFD), marks as spaces."""
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is None or i in self.silent:
                continue
            out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)


_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _utf8(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no whole character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, the end id last) of every whole text; its runs are compared with the library as in round_trip."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for frame in frames:
            ids = [[*(i for g in got for i in g[2]), model.end] for got in model.encode(frame.text.tolist())]
            yield pd.DataFrame({"doc_id": frame.doc_id, "ids": ids})

    return _texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "text": [model.decode([] if i is None else list(i)) for i in frame.ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def hashed(frames: Iterator[pd.DataFrame], model: PieceModel) -> Iterator[pd.DataFrame]:
    """The rows of round_trip for Arrow batches of doc_id and text."""
    for frame in frames:
        counts, ids_hash, text_hash = [], [], []
        for got in model.encode(frame.text.tolist()):
            ids = [i for g in got for i in g[2]]
            ids.append(model.end)
            counts.append(len(ids))
            digits = " ".join([*(g[1] for g in got), model.digits[model.end]])
            ids_hash.append(hashlib.sha256(digits.encode()).hexdigest())
            text_hash.append(hashlib.sha256(model.library.decode(ids).encode()).hexdigest())
        yield pd.DataFrame({"doc_id": frame.doc_id, "n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": text_hash})


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Encodes and decodes in one pass, keeping no ids.

    The ids come from the agenda and go back to text through the library's decode(ids). Every run of every text is compared
    with the library when a worker first merges it, all new ones of an Arrow batch at once, so all documents are checked for
    the price of the different runs; other ids than the library's raise an error.
    """
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return hashed(frames, piece_model(model_path))

    return _texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
