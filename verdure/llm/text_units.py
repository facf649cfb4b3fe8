"""Exact and fast encoding with byte-pair vocabularies.

``ByteEncoder`` serves byte-level vocabularies that keep white space,
``WordEncoder`` those that drop it and mark word ends.  Both read the
tokenizers library's file, apply its merges through tiktoken's engine (merge
order equals id order in such files, which is checked) and give the ids that
the library gives; what the fast way does not cover goes to the library.  Ids
are bytes of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: How byte-level vocabularies without a pattern of their own cut text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How the word vocabulary cuts lower-case text; its white space is Unicode's (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
_PLAIN = re.compile("[\0-\x1d\x1f-ɏ]*")  # composed, stable characters; 0x1E marks word ends
_UNIT = re.compile("[^ \t-\r]+")
#: Unicode's white space, as the byte vocabulary's pattern takes it, in runs that are long for a backtracking engine.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_END = b"\x1e"


def byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: other bytes follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Spec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model, names = self.spec["model"], byte_names()
        tail = model.get("end_of_word_suffix") or ""
        self.ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            mark = tail and token.endswith(tail) and len(token) > len(tail)
            body = token[: -len(tail)] if mark else token
            self.ranks[bytes(map(names.__getitem__, body)) + (_END if mark else b"")] = i
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][m] for m in merges]
        if model["type"] != "BPE" or model.get("dropout") or order != sorted(order) or any(p["normalized"] or p["lstrip"] or p["rstrip"] or p["single_word"] for p in self.spec["added_tokens"]):
            raise ValueError("this vocabulary needs another encoder")
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()


class ByteEncoder:
    """Whole texts through the engine, special tokens included.

    The engine's pattern goes back over a run of white space, which it can't do
    for some 400 000 characters.  Texts that may hold such a run are cut by the
    pattern's own rule, which gives the same pieces: a run is one piece, without
    its last character if other text follows.
    """

    def __init__(self, path: str):
        own = _Spec(path)
        if own.spec["normalizer"] or own.spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("this vocabulary needs another encoder")
        self.engine = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens=own.special)
        self.special = own.special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(own.special, key=len, reverse=True))) + ")") if own.special else None

    def encode(self, text: str) -> bytes:
        if len(text) > 100_000 and _LONG_SPACE.search(text):
            return np.array(self._pieces(text), "<u4").tobytes()
        return self.engine.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            at = 0
            for run in _LONG_SPACE.finditer(part):
                end = run.end() - (run.end() < len(part))
                out += self.engine.encode_ordinary(part[at : run.start()]) + self.engine._encode_single_piece(part[run.start() : end])
                at = end
            out += self.engine.encode_ordinary(part[at:])
        return out


def is_plain(text: str, marks: tuple[str, ...]) -> bool:
    """Whether lower case and ``lower_pattern`` cut a text as the library does."""
    return (("\x1e" not in text) if text.isascii() else _PLAIN.fullmatch(text) is not None) and not ("<" in text and any(m in text for m in marks))


def lower_pattern() -> re.Pattern:
    """``WORDS`` for lower-cased texts of ``_PLAIN`` characters, with its classes written out for a faster engine."""
    held = sorted({c for n in range(0x250) for c in chr(n).lower()})
    of = lambda kind: "".join(re.escape(c) for c in held if regex.match(kind, c))
    letters, numbers = of(r"\p{L}"), of(r"\p{N}")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")


class WordEncoder:
    """Remembers the ids of words, and of units (runs without white space) of odd characters; at most ``most`` each, so memory stays bounded."""

    def __init__(self, path: str, most: int = 400_000):
        own = _Spec(path)
        self.tokenizer, self.most = own.tokenizer, most
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x1e]*\x1e", mergeable_ranks=own.ranks, special_tokens={})
        self.ends = np.zeros(max(own.ranks.values()) + 1, bool)
        self.ends[[i for t, i in own.ranks.items() if t.endswith(_END)]] = True
        self.marks = tuple(own.special)
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.pattern = lower_pattern()

    def _ids(self, memory: dict[str, bytes], cut: list[list[str]], learn) -> list[bytes]:
        """The ids of each list of parts; what the memory lacks is learnt together."""
        parts = set().union(*cut)
        new = [x for x in parts if x not in memory]
        if new:
            if len(memory) + len(new) > self.most:
                memory.clear()
                new = list(parts)
            memory.update(zip(new, learn(new), strict=True))
        return [b"".join(map(memory.__getitem__, own)) for own in cut]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        ids = self.engine.encode_to_numpy("\x1e".join(words) + "\x1e").astype("<u4")
        raw, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn_units(self, units: list[str]) -> list[bytes]:
        plain = [u for u in units if is_plain(u, self.marks)]
        own = dict(zip(plain, self._ids(self.words, [self.pattern.findall(u.lower()) for u in plain], self._learn_words), strict=True))
        return [own[u] if u in own else np.asarray(self.tokenizer.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in units]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of all texts as little-endian 32-bit integers."""
        plain = [i for i, t in enumerate(texts) if is_plain(t, self.marks)]
        out = dict(zip(plain, self._ids(self.words, [self.pattern.findall(texts[i].lower()) for i in plain], self._learn_words), strict=True))
        odd = [i for i in range(len(texts)) if i not in out]
        out |= zip(odd, self._ids(self.units, [_UNIT.findall(texts[i]) for i in odd], self._learn_units), strict=True)
        return [out[i] for i in range(len(texts))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[tuple, object] = {}


def encoder(path: str, keeps_space: bool):
    """One encoder a process and vocabulary."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = (ByteEncoder if keeps_space else WordEncoder)(path)
    return _encoders[key]
