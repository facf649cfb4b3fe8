"""Secret scan: fixed patterns and a linear-chain conditional random field.

The patterns (``BASE``) give the base spans.  The field tags words as begin,
inside or outside of a secret from their shape, their neighbours and features
of the whole file; Viterbi decoding finds the best tags of whole texts, and
the parts of tagged words that no base span covers are added as kind ``crf``
(parts of white space and quotes or stops alone are left out).

The model is fitted by maximum likelihood (forward-backward) on texts that
``synthetic`` makes from a seed: prose, tables, shouting, code, numbers and
addresses without secrets, and keys, tokens, pass phrases and key blocks with
them.  No corpus rows are used.

Decoding is exact and skips most words: where "outside" leads by more than
all transition terms together can repay, it is the tag of every best path,
so only the short runs between such words need the dynamic programme.

Edge cases: a null or empty text has no spans.  Ids (null or repeated) are
passed through; an empty table gives an empty result.  ``redacted`` leaves
null texts null and keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common, textnum

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns: name, words of which one must occur, pattern, the part that must be long, its least length (fixed values).
BASE = (
    ("assign", (b"passw", b"secret", b"token", b"api"), re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", (), re.compile(rb"[0-9a-f]{16,}"), 0, 16),
)
#: Words that announce a secret (fixed values).
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key", "auth", "authorization", "bearer", "credential", "credentials", "client_secret", "access_token", "auth_token", "pin", "pass")
_STRIP = "\"'`,;.:=()[]{}<>"
_CUES = frozenset(CUES)
_CUE_HASH = None
OUT, BEGIN, INSIDE = range(3)


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; matches whose part is too short use up their text but are dropped."""
    low = data.lower()
    found = []
    for kind, needs, pattern, part, least in BASE:
        if not needs or any(n in low for n in needs):
            found += [(kind, *m.span()) for m in pattern.finditer(data) if len(m[part]) >= least]
    return found


# ---- features of words -------------------------------------------------

_CLASS = np.zeros((5, 256), np.int32)  # lower, upper, digit, key symbols, others
_CLASS[0, 97:123] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, list(b"+/_=-.~%")] = 1
_CLASS[4] = 1 - _CLASS[:4].sum(0)
_CODE = _CLASS.argmax(0).astype(np.int8)
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 40, 64])
#: Categories of each feature: shape and length, digits and changes, own start, cue before, shape before, shape after, file.
SIZES = (16 * 9, 5 * 5, 65, 8, 10, 10, 9)
_AT = np.cumsum((0, *SIZES))[:-1]
WIDTH = sum(SIZES)


def _cue_kinds(data: bytes, starts: np.ndarray, ends: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """0 no cue, 1 a cue, 2 a cue that ends in : or =, 3 only : or =, 4 a cue with a value joined on, 5 another value joined on."""
    out = np.zeros(len(starts), np.int8)
    for i in candidates:
        word = data[starts[i] : ends[i]].decode("utf-8", "replace").lower()
        if not word.strip(":="):
            out[i] = 3
            continue
        head, sep, value = re.match(r"([^:=]*)([:=]*)(.*)", word, re.S).groups()
        cue = head.strip(_STRIP) in _CUES or head.strip(_STRIP).rpartition("_")[2] in ("password", "secret", "token", "key")
        if value.strip(_STRIP):
            out[i] = 4 if cue else 5
        elif cue:
            out[i] = 2 if sep else 1
    return out


_FIRST = np.zeros(256, bool)
_FIRST[list({ord(c) for w in CUES for c in (w[0], w[0].upper())} | set(b"\"'`:=([{<"))] = True


def word_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and a row of category numbers for each."""
    starts, ends, _ = textnum.words(data)
    n = len(starts)
    cat = np.zeros((n, len(SIZES)), np.int32)
    if not n:
        return starts, ends, cat
    buf = np.frombuffer(data, np.uint8)
    size = ends - starts
    code = _CODE[buf]
    flat = np.empty(2 * n, np.int64)
    flat[::2], flat[1::2] = starts, ends
    if flat[-1] == len(buf):
        code, flat = np.append(code, np.int8(4)), flat
    part = np.empty((5, n), np.int32)
    for c in range(5):
        part[c] = np.add.reduceat((code == c).astype(np.int32), flat)[::2]
    change = np.add.reduceat(np.append(code[1:] != code[:-1], False).astype(np.int32), flat)[::2]
    bucket = np.searchsorted(_LENGTHS, size, "right")
    shape = (part[0] > 0) + 2 * (part[1] > 0) + 4 * (part[2] > 0) + 8 * (part[3] > 0)
    cat[:, 0] = shape * 9 + bucket
    digits = np.searchsorted([0.001, 0.2, 0.5, 0.95], part[2] / size, "right")
    turns = np.searchsorted([0.05, 0.15, 0.3, 0.5], change / size, "right")
    cat[:, 1] = digits * 5 + turns
    long_ = size >= 12
    at = starts[long_]
    mark = buf[at].astype(np.uint32) * 961 + buf[at + 1] * np.uint32(31) + buf[at + 2]
    cat[long_, 2] = 1 + (mark * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.int32)
    simple = np.where(size >= 12, 5, 0) + np.where(part[4] > 0, 4, np.where(part[2] > 0, np.where(part[0] + part[1] > 0, 3, 2), np.where(part[1] > 0, 1, 0)))
    has_sep = np.add.reduceat(((buf == 61) | (buf == 58)).astype(np.int32) if flat[-1] < len(buf) else np.append(((buf == 61) | (buf == 58)).astype(np.int32), 0), flat)[::2] > 0
    cue = _cue_kinds(data, starts, ends, np.flatnonzero(_FIRST[buf[starts]] | has_sep))
    # cue before: its kind, or 6 and 7 for a lone sign after a cue
    before = np.zeros(n, np.int8)
    before[1:] = cue[:-1]
    if n > 2:
        lone = (cue[1:-1] == 3) & ((cue[:-2] == 1) | (cue[:-2] == 2))
        before[2:][lone] = 6
    before[1:][(before[1:] == 5) | (before[1:] == 4)] = 0
    cat[:, 3] = np.where(cue == 4, 7, np.where(cue == 5, 5, before))
    cat[1:, 4], cat[:-1, 5] = simple[:-1], simple[1:]
    busy = np.searchsorted([0.1, 0.4], float((part[2] > 0).mean()), "right")
    odd = np.searchsorted([0.2, 0.7], float((part[4] > 0).mean()), "right")
    cat[:, 6] = busy * 3 + odd
    return starts, ends, cat


# ---- the field -----------------------------------------------------------


class Field:
    """Weights of the categories for each tag, and of tag pairs."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        tags = range(3)
        # the most that tags next to a word can lose when it becomes "outside"
        self.lead = max(moves[p, y] - moves[p, OUT] for p in tags for y in tags) + max(moves[y, q] - moves[OUT, q] for q in tags for y in tags)

    def scores(self, cat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cat), 3), np.float32)
        for f, at in enumerate(_AT):
            out += self.weights[at + cat[:, f]]
        return out

    def viterbi(self, scores: np.ndarray, left: int | None = None, right: int | None = None) -> np.ndarray:
        """Best tags of a run whose outer neighbours have the given tags, if any."""
        best = scores[0] + (self.moves[left] if left is not None else 0)
        back = np.zeros((len(scores), 3), np.int8)
        for t in range(1, len(scores)):
            step = best[:, None] + self.moves
            back[t] = step.argmax(0)
            best = step.max(0) + scores[t]
        if right is not None:
            best = best + self.moves[:, right]
        tags = np.empty(len(scores), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of a whole text."""
        n = len(scores)
        tags = np.zeros(n, np.int8)
        open_ = scores[:, OUT] - scores[:, 1:].max(1) <= self.lead + 1e-3
        edge = np.diff(np.r_[False, open_, False].astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            tags[a:b] = self.viterbi(scores[a:b], OUT if a else None, OUT if b < n else None)
        return tags


def fit(texts: list[tuple[str, list[tuple[int, int]]]], steps: int = 100, decay: float = 2e-3) -> Field:
    """Maximum likelihood with forward-backward over texts with the byte spans of their secrets."""
    rows = []
    for text, spans in texts:
        data = text.encode()
        s, e, cat = word_features(data)
        tags = np.zeros(len(s), np.int64)
        for a, b in spans:
            hit = np.flatnonzero((s < b) & (e > a))
            if len(hit):
                tags[hit] = INSIDE
                tags[hit[0]] = BEGIN
        rows.append((cat, tags))
    rows = [r for r in rows if len(r[1])]
    n, t = len(rows), max(len(r[1]) for r in rows)
    cat = np.zeros((n, t, len(SIZES)), np.int64)
    tags, real = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (c, y) in enumerate(rows):
        cat[i, : len(y)], tags[i, : len(y)], real[i, : len(y)] = c + _AT, y, True
    used = cat[real]
    gold = np.zeros((WIDTH, 3))
    for f in range(len(SIZES)):
        np.add.at(gold, (used[:, f], tags[real]), 1)
    gold_moves = np.zeros((3, 3))
    pair = real[:, 1:]
    np.add.at(gold_moves, (tags[:, :-1][pair], tags[:, 1:][pair]), 1)
    w, u = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(u), np.zeros_like(u)]

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        em = w[cat].sum(2) * real[..., None]
        fwd, bwd = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        fwd[:, 0] = em[:, 0]
        for k in range(1, t):
            nxt = log_sum(fwd[:, k - 1, :, None] + u, 1) + em[:, k]
            fwd[:, k] = np.where(real[:, k, None], nxt, fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            nxt = log_sum(u[None] + (em[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            bwd[:, k] = np.where(real[:, k + 1, None], nxt, bwd[:, k + 1])
        z = log_sum(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        g = -gold.copy()
        for f in range(len(SIZES)):
            np.add.at(g, used[:, f], p[real])
        both = np.exp(fwd[:, :-1, :, None] + u + (em[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gu = both[pair].sum(0) - gold_moves
        for x, grad, m, v in ((w, g / n + decay * w, state[0], state[1]), (u, gu / n + decay * u, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(np.float32), u.astype(np.float32))


_ABC = "abcdefghijklmnopqrstuvwxyz"
_B64 = _ABC + _ABC.upper() + "0123456789+/"
#: How providers begin their keys (fixed values).
PREFIXES = ("sk_live_", "sk-", "pk_live_", "rk_live_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xapp-", "AIza", "ya29.", "SG.", "npm_", "pypi-", "dop_v1_", "shpat_", "hf_", "eyJ", "AKIA", "ASIA")


def synthetic(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts of up to some 70 words with the byte spans of their secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    parts = [some("bcdfghklmnprstvwz", 1) + some("aeiouéèöüñ" if rng.random() < 0.2 else "aeiou", 1) + (some("nrstl", 1) if rng.random() < 0.5 else "") for _ in range(120)]

    titled = 0.1

    def plain() -> str:
        w = "".join(pick(parts) for _ in range(int(rng.integers(1, 5 if rng.random() < 0.93 else 9))))
        return (w.capitalize() if rng.random() < titled else w) + (pick(".,,.;:!?") if rng.random() < 0.15 else "")

    def other() -> str:
        k = int(rng.integers(17))
        digits = lambda a, b: some("0123456789", int(rng.integers(a, b)))
        return (
            digits(1, 6), plain().upper() + pick(["", "!!", "!"]), plain() + pick(["###", "$$$", "%%%", "&&&", "***"]), f"{plain()}.{digits(1, 3)}@{plain()}.example.com".replace(",", ""),
            f"({digits(3, 4)}) {digits(3, 4)}-{digits(4, 5)}", digits(13, 17), f"https://{plain()}.example.org/{plain()}/{digits(1, 5)}?{plain()}={digits(1, 5)}", f"{digits(1, 4)}.{digits(1, 4)}.{digits(1, 4)}.{digits(1, 4)}",
            f"{plain()} = {plain()}({digits(1, 4)});", f"20{digits(2, 3)}-{digits(2, 3)}-{digits(2, 3)}", f"{plain()}_{plain()}_{plain()}()", f"{plain()}-{plain()}-{plain()}-{plain()}", "| " + plain() + " |",
            pick(["the token was", "a secret of", "key idea", "password reset", "my password is long", "token ring", "secret:", "the key:"]) + " " + plain(), f"{plain()}: {plain()}", f"v{digits(1, 2)}.{digits(1, 3)}.{digits(1, 3)}", f"{plain().upper()}_{plain().upper()}={digits(1, 4)}",
        )[k]

    def secret() -> tuple[str, str]:
        """What stands before it, and the secret."""
        k, cue = int(rng.integers(8)), pick(CUES)
        cue = cue.upper() if rng.random() < 0.3 else cue
        value = some(_B64, int(rng.integers(20, 45)))
        lead = cue + pick([" = ", ": ", "=", ":", " := ", '": "', " is "])
        return (
            (lead, pick(["", '"']) + value), ("", pick(PREFIXES) + some(_B64[:62], int(rng.integers(20, 40)))), (lead, some("0123456789abcdef", 40)),
            ("", "-----BEGIN " + pick(["RSA ", "EC ", ""]) + "PRIVATE KEY----- " + " ".join(some(_B64, 64) for _ in range(int(rng.integers(1, 5)))) + " -----END PRIVATE KEY-----"),
            (lead, some(_B64[:62] + "!@#$%^&*", int(rng.integers(10, 18)))), ("Bearer ", f"eyJ{some(_B64[:62], 20)}.{some(_B64[:62], 40)}.{some(_B64[:62], 30)}"),
            ("", f"postgres://{plain()}:{some(_B64[:62], 16)}@db.example.com/{plain()}"), ("AWS " if rng.random() < 0.5 else "", pick(["AKIA", "ASIA"]) + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        )[k]

    out = []
    for _ in range(n):
        text, spans, noise = "", [], pick([0.02, 0.1, 0.4])
        loud, titled = pick([0, 0, 0, 1, 2]), pick([0.1, 0.1, 0.5, 1.0])
        for _ in range(int(rng.integers(5, 45))):
            if rng.random() < 0.04:
                lead, value = secret()
                text += lead
                spans.append((len(text.encode()), len((text + value).encode())))
                text += value + pick(["", '"', "###", ".", ","])
            elif rng.random() < noise:
                text += other()
            elif rng.random() < 0.03:  # the same word over and over
                text += " ".join([plain()] * int(rng.integers(2, 8)))
            else:
                text += plain().upper() + "!!" if loud == 1 else plain() + pick(["###", "$$$", "%%%", "&&&", "***"]) if loud == 2 else plain()
            text += pick([" ", " ", " ", " ", "\n"])
        out.append((text, spans))
    return out


_model: Field | None = None


def model() -> Field:
    """The field fitted on the default synthetic texts, once a process."""
    global _model
    if _model is None:
        _model = fit(synthetic())
    return _model


def uncovered(a: int, b: int, taken) -> Iterator[tuple[int, int]]:
    """The parts of a..b outside the taken (start, end), which come by start."""
    for x, y in taken:
        if a < x:
            yield a, int(x)
        a = max(a, int(y))
    if a < b:
        yield a, b


def spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """All (kind, start, end) in bytes, by start and then kind as listed."""
    data = text.encode("utf-8", "replace")
    found = base_spans(data)
    starts, ends, cat = word_features(data)
    if len(starts):
        taken = np.array(sorted((a, b) for _, a, b in found), np.int64).reshape(-1, 2)
        tags = field.decode(field.scores(cat))
        first = np.flatnonzero((tags != OUT) & ((tags == BEGIN) | (np.r_[OUT, tags[:-1]] == OUT)))
        for i in first:
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            a, b = int(starts[i]), int(ends[j - 1])
            word = data[a:b]
            a, b = a + len(word) - len(word.lstrip(_STRIP.encode())), b - (len(word) - len(word.rstrip(b"\"'`,;.:()[]{}<>")))
            for x, y in uncovered(a, b, taken[(taken[:, 0] < b) & (taken[:, 1] > a)]):
                piece = data[x:y]
                x, y = x + len(piece) - len(piece.lstrip()), y - (len(piece) - len(piece.rstrip()))
                if data[x:y].strip(_STRIP.encode()):
                    found.append(("crf", x, y))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def in_characters(data: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte spans as code-point spans."""
    out, at, n = [], 0, 0
    where = {}
    for p in sorted({x for _, a, b in found for x in (a, b)}):
        n += len(data[at:p].decode("utf-8", "ignore"))
        at = p
        where[p] = n
    for kind, a, b in found:
        out.append((kind, where[a], where[b]))
    return out


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans: array of (kind, start, stop) in code points, in order."""
    common.prepare(docs.sparkSession)
    field = field or model()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text in part.column(1).to_pylist():
                found = spans(text, field)
                out.append([{"kind": k, "start": a, "stop": b} for k, a, b in in_characters(text.encode("utf-8", "replace"), found)] if found else [])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["id", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    return plain.mapInArrow(common.lean(run), "id long, spans array<struct<kind:string,start:long,stop:long>>").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with the mark in place of every secret and the length column brought up to date."""
    common.prepare(docs.sparkSession)
    field = field or model()

    def clean(text: str | None) -> str | None:
        if not text or not (found := spans(text, field)):
            return text
        data, out, at = text.encode("utf-8", "replace"), [], 0
        for _, a, b in found:
            if a >= at:
                out += [data[at:a], mark.encode()]
            at = max(at, b)
        return b"".join([*out, data[at:]]).decode("utf-8", "replace")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            i = part.schema.get_field_index(text_col)
            yield part.set_column(i, part.schema.field(i), pa.array([clean(t) for t in part.column(i).to_pylist()], part.schema.field(i).type))

    out = docs.mapInArrow(common.lean(run), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
