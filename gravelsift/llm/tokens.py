"""Token ids of whole texts, as the tokenizers library gives them, at the speed that whole corpora need.

The library spends most of its time on offsets that nobody here reads. A merge vocabulary file is therefore turned
into byte ranks for tiktoken, whose merges are the same as long as the file's merges stand in the order of their ids and
its other rules are the ones that are followed here: both are checked when a file is read, and any other file raises. In
the vocabulary of words each character is compared with the library, alone and between others, when a worker first meets
it; texts with one on which both differ, with a special token's string, with a run of white space too long for tiktoken
or in another normal form than NFC go to the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The pattern by which byte-level vocabularies of this kind cut a text (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's pattern gives up on runs of about a million white-space characters; longer runs than this go to the library.
LONG_RUN = 100_000
#: A worker keeps the ids of so many words; it then starts anew. Longer words than SHORT aren't kept.
KEPT_WORDS, SHORT = 500_000, 48


def byte_symbols() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def check_merges(model: dict, path: str) -> None:
    """Merges must make different tokens with rising ids: then the lowest id among neighbours is the first merge."""
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: merges can't be taken in the order of ids")


def has_long_run(text: str) -> bool:
    """Whether text holds more than LONG_RUN white-space characters on end."""
    return len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in re.finditer(r"\s+", text))


class ByteTokenizer:
    """A byte-level merge vocabulary without word ends."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            data = json.load(file)
        check_merges(data["model"], path)
        cut = data["pre_tokenizer"] or {}
        if data["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True) or data["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a byte-level vocabulary without normalizer, prefix space and word ends")
        of = byte_symbols()
        ranks = {bytes(of[c] for c in t): i for t, i in data["model"]["vocab"].items()}
        self.special = [t["content"] for t in data["added_tokens"]]
        self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids as unsigned 32-bit integers."""
        if any(s in text for s in self.special) or has_long_run(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def lower_chunks(text: str) -> list[str]:
    """What stands between white space, lower-cased character by character, as the library does: lower() alone writes a
    capital sigma at a word's end as another letter."""
    return text.replace("Σ", "σ").lower().split()


class WordTokenizer:
    """A byte-level merge vocabulary with word ends, lower case and no white space.

    The word end is written as a zero byte, which merges with the byte before it ahead of all else.
    """

    END = "</w>"

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            data = json.load(file)
        check_merges(data["model"], path)
        rules = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        cuts = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        if rules != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or not cuts[0]["invert"] or data["model"]["end_of_word_suffix"] != self.END:
            raise ValueError(f"{path}: not a lower-case vocabulary of words with word ends")
        of, vocab = byte_symbols(), data["model"]["vocab"]
        ranks = {bytes(of[c] for c in t.removesuffix(self.END)) + b"\0" * t.endswith(self.END): i for t, i in vocab.items()}
        ranks[b"\0"] = max(vocab.values()) + 1000
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.END)]] = True
        self.special = [t["content"] for t in data["added_tokens"]]
        self.words = regex.compile(cuts[0]["pattern"]["Regex"])
        self.fast = tiktoken.Encoding("ranks", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.alike: set[str] = set()
        self.latin = bytes(c for c in range(256) if self.agrees(chr(c)))

    def agrees(self, c: str) -> bool:
        """Whether a character's ids are the library's, alone and between letters, digits, signs and spaces."""
        if c == "\0":  # the mark of a word's end
            return False
        around = [t for t in (c, f"a{c}b", f"1{c}2", f".{c}!", f"é {c} x", f"{c}'s", f"{c}{c}") if unicodedata.is_normalized("NFC", t)]
        own = [b"".join(self.of_chunks(lower_chunks(t))) for t in around]
        return own == [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(around, add_special_tokens=False)]

    def follows(self, text: str) -> bool:
        """Whether the library's ids can be found without it."""
        try:
            odd = text.encode("latin-1").translate(None, self.latin)
        except UnicodeEncodeError:
            odd = set(text) - self.alike
            if odd:
                self.alike |= {c for c in odd if self.agrees(c)}
                odd -= self.alike
            odd = odd or not unicodedata.is_normalized("NFC", text)
        return not odd and not any(s in text for s in self.special)

    def learn(self, chunks: set[str]) -> None:
        fresh = list(chunks - self.cache.keys())
        if len(self.cache) + len(fresh) > KEPT_WORDS:
            self.cache = {}
            fresh = list(chunks)
        fresh = [c for c in fresh if len(c) <= SHORT]
        if fresh:
            self.cache.update(zip(fresh, self.of_chunks(fresh), strict=True))

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of lower-case chunks without white space: all their words in one call, cut again at word ends."""
        words = [self.words.findall(c) for c in chunks]
        flat = [w for ws in words for w in ws]
        if not flat:
            return [b""] * len(chunks)
        ids = self.fast.encode_to_numpy("\0".join(flat) + "\0", disallowed_special=()).astype("<u4")
        after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        cut = after[np.concatenate([[0], np.cumsum([len(ws) for ws in words])])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [lower_chunks(text) if self.follows(text) else None for text in texts]
        self.learn(set().union(*(c for c in cut if c)))
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            got = list(map(self.cache.get, chunks))
            if None in got:
                got = [self.of_chunks([c])[0] if g is None else g for g, c in zip(got, chunks, strict=True)]
            out.append(b"".join(got))
        return out


@lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
