"""BPE encoding and decoding by depth-first traversal of a prefix trie.

The distinct words of a batch go into a trie of their symbols.  The last
token of the encoding of a prefix fixes the whole encoding: it is the one
token t that ends the prefix, whose own encoding is t, and that may stand
next to the last token of what precedes it.  A depth-first walk therefore
finds one last token a node, from those of its ancestors, and words with a
common prefix share that work.  Two tokens may stand side by side when
merging their joined symbols gives just these two again; results are
remembered.

Text becomes words as the vocabulary's own normaliser and pre-tokeniser say
(called once for each distinct unit); special tokens are cut out first.
Decoding joins the tokens' strings with blanks where the vocabulary has no
decoder, as the library does, and else calls it.

Edge cases: null and empty texts have no ids and decode to an empty string.
Ids (null or repeated) are passed through; an empty table gives an empty
result.  Very long texts cost memory in proportion to themselves only.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdure.llm import common, text_units

_UNIT = re.compile("[^ \t-\r]+")
#: The rule in the tokenizer file that ``text_units.WORDS`` mirrors (fixed value).
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Vocabulary:
    """Tokens, merge ranks and the side-by-side test of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("this vocabulary needs another encoder")
        self.ids: dict[str, int] = model["vocab"]
        self.tail: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.tokenizer = Tokenizer.from_file(path)
        self.has_decoder = spec["decoder"] is not None
        self.spaces_matter = not any(p.get("type") == "Split" and p["behavior"] == "Removed" for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []))
        if self.spaces_matter:
            raise ValueError("this vocabulary encodes white space; units are cut for those that drop it")
        self.known_beside: dict[tuple[str, str], bool] = {}
        self.byte_name = {b: c for c, b in text_units.byte_names().items()}
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        #: the vocabulary whose cutting ``text_units.WORDS`` mirrors
        self.is_word_kind = kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern") == {"Regex": _WORD_RULE}

        self.stable = {t for t in self.ids if self.merged(self.symbols(t)) == [t]}  # tokens whose own encoding they are

    def symbols(self, token: str) -> list[str]:
        """The starting symbols of a token; only its last may carry the word-end mark."""
        if self.tail and token.endswith(self.tail) and len(token) > len(self.tail):
            body = token[: -len(self.tail)]
            return [*body[:-1], body[-1] + self.tail]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Applies the lowest-ranked merge, leftmost first, until none is left."""
        parts = list(parts)
        while len(parts) > 1:
            least, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, left: str, right: str) -> bool:
        """Whether merging the joined symbols of two tokens gives these two again; remembered."""
        if len(self.known_beside) > 1_000_000:
            self.known_beside.clear()
        out = self.known_beside[left, right] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return out


class TrieEncoder:
    """Encodes sets of words; remembers the ids of the words and units of text it has met."""

    def __init__(self, path: str, most: int = 500_000):
        self.vocabulary = Vocabulary(path)
        self.most = most
        self.longest = max(map(len, self.vocabulary.ids))
        self.words: dict[str, list[int]] = {}
        self.states: dict[str, tuple[str, int]] = {}  # of prefixes: the last token and where it begins
        self.ids: dict[str, bytes] = {}  # of units
        self.texts: dict[str, str] = {}
        self.word_ids: dict[str, bytes] = {}  # of the words of plain texts
        self.word_texts: dict[str, str] = {}
        self.pattern = text_units.lower_pattern() if self.vocabulary.is_word_kind else None
        self.blank = False  # whether some unit has no ids
        marks = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of distinct words by one depth-first walk over their trie."""
        v, longest, tail = self.vocabulary, self.longest, self.vocabulary.tail
        ids, stable, known, beside = v.ids, v.stable, v.known_beside, v.beside
        root: dict = {}
        for word in words:
            node = root
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node[word[-1], tail] = word  # the last symbol carries the word-end mark
        out: dict[str, list[int]] = {}
        states = self.states
        if len(states) > self.most:
            states.clear()
        room = 1 + max(map(len, words), default=0)
        prefix = [""] * room  # by depth: the characters so far
        last = [""] * room  # and the last token of their encoding
        back = [0] * room  # and the depth at which that token begins
        todo: list[tuple] = [(n, 1, s) for s, n in root.items()]
        while todo:
            node, depth, symbol = todo.pop()
            ends = symbol.__class__ is tuple
            own = prefix[depth - 1] + (symbol[0] if ends else symbol)
            if not ends and (state := states.get(own)):
                token, at = state
            else:
                for at in range(depth - longest if depth > longest else 0, depth):
                    token = own[at:] + tail if ends else own[at:]
                    if token in stable:
                        if not at:
                            break
                        side = (last[at], token)
                        if (fits := known.get(side)) is None:
                            fits = beside(*side)
                        if fits:
                            break
                else:  # a symbol that the vocabulary lacks
                    at, token = depth - 1, own[-1] + tail if ends else own[-1]
                if not ends:
                    states[own] = (token, at)
            prefix[depth], last[depth], back[depth] = own, token, at
            if ends:
                found = []
                while depth:
                    if (i := ids.get(last[depth])) is not None:  # symbols outside the vocabulary have no id
                        found.append(i)
                    depth = back[depth]
                out[node] = found[::-1]
            else:
                todo += [(n, depth + 1, s) for s, n in node.items()]
        return out

    def _pieces(self, unit: str) -> list:
        """Words of a unit, and the ids of special tokens, in order."""
        v, out = self.vocabulary, []
        for part in self.cut.split(unit) if self.cut and "<" in unit else [unit]:
            if part in v.special:
                out.append(v.special[part])
            elif v.is_word_kind and part.isascii() and part.isalpha():
                out.append(part.lower())
            elif v.is_word_kind and text_units._PLAIN.fullmatch(part):
                for w in text_units.WORDS.findall(part.lower()):
                    out.append(w if w.isascii() and w.isprintable() else "".join(map(v.byte_name.__getitem__, w.encode())))
            elif part:
                t = v.tokenizer
                out += [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part) if t.normalizer else part)]
        return out

    def learn(self, parts: Iterable[str], how) -> None:
        """Adds words or units to the memory with one trie for all new words."""
        collects = gc.isenabled()
        gc.disable()  # tries hold no cycles; scanning millions of small objects for some would cost more than the walk
        try:
            how(parts)
        finally:
            if collects:
                gc.enable()

    def _learn_words(self, words: Iterable[str]) -> None:
        byte_name, names = self.vocabulary.byte_name, self.vocabulary.names
        shown = {w: w if w.isascii() and w.isprintable() else "".join(map(byte_name.__getitem__, w.encode())) for w in words}
        found = self.encode_words(set(shown.values()))
        for word, name in shown.items():
            own = found[name]
            self.blank |= not own
            self.word_ids[word] = struct.pack(f"<{len(own)}I", *own)
            self.word_texts[word] = " ".join([names[i] for i in own])

    def _learn_units(self, units: Iterable[str]) -> None:
        pieces = {u: self._pieces(u) for u in units}
        met = {w for p in pieces.values() for w in p if isinstance(w, str)}
        if len(self.words) + len(met) > self.most:
            self.words.clear()
        self.words.update(self.encode_words(met.difference(self.words)))
        names, words = self.vocabulary.names, self.words
        for unit, parts in pieces.items():
            if len(parts) == 1 and isinstance(parts[0], str):
                own = words[parts[0]]
            else:
                own = [i for p in parts for i in (words[p] if isinstance(p, str) else [p])]
                self.blank |= not own
            self.ids[unit] = struct.pack(f"<{len(own)}I", *own)
            self.texts[unit] = " ".join([names[i] for i in own])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each whole text its ids as little-endian 32-bit integers and its decoded text."""
        marks = tuple(self.vocabulary.special)
        plain = [self.pattern is not None and text_units.is_plain(t, marks) for t in texts]
        words = iter(self._parts([self.pattern.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p], self.word_ids, self.word_texts, self._learn_words))
        units = iter(self._parts([_UNIT.findall(t) for t, p in zip(texts, plain, strict=True) if not p], self.ids, self.texts, self._learn_units))
        return [next(words if p else units) for p in plain]

    def _parts(self, cut: list[list[str]], held_ids: dict[str, bytes], held_texts: dict[str, str], how) -> list[tuple[bytes, str]]:
        """Ids and decoded texts of lists of words or units, through their memory."""
        parts = set().union(*cut)
        new = [x for x in parts if x not in held_ids]
        if len(held_ids) + len(new) > self.most:
            held_ids.clear()
            held_texts.clear()
            new = list(parts)
        if new:
            self.learn(new, how)
        ids, names, out = held_ids.__getitem__, held_texts.__getitem__, []
        for own in cut:
            found = b"".join(map(ids, own))
            if self.vocabulary.has_decoder:
                text = self.vocabulary.tokenizer.decode(np.frombuffer(found, "<u4").tolist(), skip_special_tokens=False)
            else:
                text = " ".join([t for t in map(names, own) if t] if self.blank else map(names, own))
            out.append((found, text))
        return out


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    """One encoder a process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col, n_tokens, ids (array of int) and decoded text; with ``digests`` SHA-256 sums in place of the last two."""
    common.prepare(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(path)
        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])

        def rows():
            for part in parts:
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for at in range(0, len(texts), 1024):
                    for i, (ids, decoded) in zip(keys[at : at + 1024], encoder.encode(texts[at : at + 1024]), strict=True):
                        row = {"id": i, "n_tokens": len(ids) // 4}
                        if digests:
                            yield row | {"ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
                        else:
                            yield row | {"ids": np.frombuffer(ids, "<u4").astype(np.int32), "decoded": decoded}

        yield from common.batches(schema, rows(), weigh=lambda r: 200 if digests else 200 + 12 * r["n_tokens"])

    kinds = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    return plain.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
