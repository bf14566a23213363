"""Secrets in texts: three patterns, and a linear-chain conditional random field over words.

The field tags every word as the beginning or inside of a secret or as outside.
Its features are the word's shape, the shapes of the words beside it, whether a
word that names secrets stands just before, and a figure of the whole file. It is
trained on words near matches of the patterns in a bounded sample of documents,
without the patterns themselves among the features, and decoded by Viterbi.

Decoding is exact but short: a word whose best secret score cannot make up for
being outside, whatever its neighbours are, is outside in every best path, so
Viterbi runs only over the stretches between such words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, remembers, working

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns (fixed values); letters of the names in either case.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAME = re.compile("|".join(_NAMES).encode())
#: Letters of any script, and marks that stand at the ends of plain words.
_PLAIN = bytes(b for b in range(256) if b > 127 or chr(b).isalpha()) + b".,;!?'()"
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HEX_RUN = re.compile(rb"[0-9a-f]{16}")
_CORE, _TURNS = re.compile(rb"[A-Za-z0-9+/_.=-]+"), re.compile(rb"\d[A-Za-z]|[A-Za-z]\d")
_CLASSES = re.compile(rb"\d"), re.compile(rb"[A-Z]"), re.compile(rb"[a-z]")
OUT, BEGIN, INSIDE = range(3)
SHAPES, NEAR, FILE, ROUGH = 256, 8, 4, 36
LONG_HEX, ACCESS_KEY, NAMES_SECRET = 1, 2, 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind that are long enough."""
    low = text.lower()
    out = []
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def shape(word: bytes) -> tuple[int, int]:
    """A number for the word's shape, under SHAPES, and what the patterns may find in it."""
    flags, low = 0, word.lower()
    if len(word) > 4 and _NAME.search(low):
        flags = NAMES_SECRET
    if len(word) < 24 and not word.translate(None, _PLAIN):
        if len(word) > 15 and _HEX_RUN.search(word):
            flags |= LONG_HEX
        return (2 if flags & NAMES_SECRET else 1), flags | (ACCESS_KEY if b"AKIA" in word else 0)
    flags |= (LONG_HEX if _HEX_RUN.search(word) else 0) | (ACCESS_KEY if b"AKIA" in word else 0)
    if word in (b"=", b":", b":=", b"=="):
        return 3, flags
    core = max(_CORE.findall(word), key=len, default=b"")
    digit, upper, lower = (bool(p.search(core)) for p in _CLASSES)
    size = sum(len(core) >= k for k in (4, 8, 12, 16, 24, 32))
    turns = len(_TURNS.findall(core))
    mixed = 0 if not turns else 1 if turns < 3 else 2
    if b"." in core.strip(b".") or b"@" in word or any(b > 127 for b in word):
        mixed = 3  # addresses, numbers with points, words in other scripts
    kinds = digit + 2 * upper + 4 * lower
    return 4 + (size * 8 + kinds) * 4 + mixed if size else 4, flags


class Shapes(dict):
    """word -> (shape, flags) in one number, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        number, flags = shape(word)
        self[word] = out = number * 8 + flags
        return out


_shapes = Shapes()
remembers("secrets", _shapes.clear)


def file_feature(numbers: np.ndarray) -> int:
    """Of the whole file: none, few or many words that are no plain words; or one that names a secret."""
    if (numbers & NAMES_SECRET).any():
        return 3
    odd = float((numbers >> 3 != 1).mean()) if len(numbers) else 0.0
    return 0 if odd < 0.2 else 1 if odd < 0.6 else 2


def features(numbers: np.ndarray, of_file: int) -> np.ndarray:
    """Six active features per word: its shape, the shapes before and after, names near before, the file, length and mixture alone."""
    s = numbers >> 3
    rough = np.where(s < 4, s, 4 + (s - 4) // 32 * 4 + (s - 4) % 4)
    named = np.append(np.zeros(3, bool), numbers & NAMES_SECRET > 0)
    near = named[2:-1] * 1 + named[1:-2] * 2 + named[:-3] * 4
    before, after = np.append(0, s[:-1]), np.append(s[1:], 0)
    return np.column_stack([s, SHAPES + before, 2 * SHAPES + after, 3 * SHAPES + near, np.full(len(s), 3 * SHAPES + NEAR + of_file), 3 * SHAPES + NEAR + FILE + rough])


N_FEATURES = 3 * SHAPES + NEAR + FILE + ROUGH


class Field:
    """A linear-chain conditional random field with labels outside, begin, inside."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 3)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move

    def forward_backward(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each word's label and, summed over the words, of each move."""
        n, grow = len(score), np.exp(self.moves())
        local = np.exp(score - score.max(axis=1, keepdims=True))
        f, b = np.empty((n, 3)), np.ones((n, 3))
        f[0] = local[0] * (1, 1, 0)
        f[0] /= f[0].sum()
        for k in range(1, n):
            f[k] = (f[k - 1] @ grow) * local[k]
            f[k] /= f[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = grow @ (local[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        p = f * b
        p /= p.sum(axis=1, keepdims=True)
        pair = np.zeros((3, 3))
        for k in range(n - 1):
            joint = f[k][:, None] * grow * (local[k + 1] * b[k + 1])[None, :]
            pair += joint / joint.sum()
        return p, pair

    def moves(self) -> np.ndarray:
        out = self.move.copy()
        out[OUT, INSIDE] = -1e3
        return out

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Stochastic ascent of the conditional likelihood, with steps scaled by past gradients."""
        seen_e, seen_m = np.full_like(self.emit, 1e-3), np.full_like(self.move, 1e-3)
        order = np.random.default_rng(3)
        for _ in range(rounds):
            for k in order.permutation(len(rows)):
                feats, labels = rows[k]
                p, pair = self.forward_backward(self.emit[feats].sum(axis=1))
                g = np.eye(3)[labels] - p
                ge = np.zeros_like(self.emit)
                np.add.at(ge, feats.ravel(), np.repeat(g, feats.shape[1], axis=0))
                ge -= decay * self.emit
                gm = -pair
                np.add.at(gm, (labels[:-1], labels[1:]), 1)
                seen_e += ge * ge
                seen_m += gm * gm
                self.emit += rate * ge / np.sqrt(seen_e)
                self.move += rate * gm / np.sqrt(seen_m)
        return self

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        move, n = self.moves(), len(score)
        back = np.zeros((n, 3), np.int64)
        v = score[0] + (0, 0, -1e3)
        for k in range(1, n):
            step = v[:, None] + move
            back[k] = step.argmax(axis=0)
            v = step.max(axis=0) + score[k]
        out = np.empty(n, np.int64)
        out[-1] = v.argmax()
        for k in range(n - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def decode(self, feats: np.ndarray) -> np.ndarray:
        """Viterbi over the whole text, run only where a word could be other than outside.

        Making a stretch of secret labels outside changes the score by at most its words' gains, each with the
        best move into it, and the best move out. A word in no stretch where that sum is positive is outside.
        """
        move, gain = self.moves(), self.emit - self.emit[:, [OUT]]
        into = max(move[a, x] for a in range(3) for x in (BEGIN, INSIDE)) - move[OUT, OUT]
        leave = max(0.0, move[BEGIN, OUT] - move[OUT, OUT], move[INSIDE, OUT] - move[OUT, OUT])
        step = gain[:, 1:][feats].sum(axis=1).max(axis=1) + max(into, 0.0)
        out = np.zeros(len(feats), np.int64)
        if step.max() + leave < 0:
            return out
        run = np.append(0.0, np.cumsum(step))
        best = np.maximum.accumulate(run[:0:-1])[::-1] - np.minimum.accumulate(run[:-1])  # of the stretches that hold the word
        at = np.flatnonzero(best + leave >= 0)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
            first, last = max(0, part[0] - 1), min(len(feats), part[-1] + 2)
            out[first:last] = self.viterbi(self.emit[feats[first:last]].sum(axis=1))
        return out


def words_with_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def numbers_of(text: str) -> np.ndarray:
    working("secrets")
    words = text.encode("utf-8", "replace").split()
    return np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))


def training_rows(texts: list[str], around: int = 15, most: int = 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words near the first ``most`` matches of the patterns, or the first words of a text without one, with their labels.

    Matches near each other share one stretch of words, so no word is given twice.
    """
    out = []
    for text in texts:
        numbers, places = numbers_of(text), words_with_places(text)
        if not places:
            continue
        feats, labels = features(numbers, file_feature(numbers)), np.zeros(len(places), np.int64)
        for kind, start, end in base_spans(text):
            value = ASSIGN.match(text, start).start(2) if kind == "assign" else start
            hit = [k for k, (a, b) in enumerate(places) if a < end and b > value]
            if hit:
                labels[hit[0]] = BEGIN
                labels[hit[1:]] = INSIDE
        marked = np.flatnonzero(labels)
        begun = np.flatnonzero(labels == BEGIN)
        marked = marked[marked < begun[most]] if len(begun) > most else marked
        cuts = merged([(max(0, k - around), min(k + around, len(places))) for k in marked.tolist()]) or [(0, 4 * around)]
        cuts = [(a, min(b, a + 4 * around * most)) for a, b in cuts]
        out += [(feats[a:b], labels[a:b]) for a, b in cuts]
    return out


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches, sorted, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed: the patterns', and the field's that reach beyond them."""
    if not text:
        return []
    numbers = numbers_of(text)
    spans = base_spans(text) if (numbers & 7).any() else []  # nothing that the patterns find spans words without a flag
    if len(numbers):
        labels = field.decode(features(numbers, file_feature(numbers)))
        if labels.any():
            places, taken = words_with_places(text), merged([(a, b) for _, a, b in spans])
            for k in np.flatnonzero(labels == BEGIN):
                last = k
                while last + 1 < len(labels) and labels[last + 1] == INSIDE:
                    last += 1
                whole = [m.span() for m in _RUN.finditer(text, places[k][0], places[last][1])]
                if whole and not any(a <= whole[0][0] and whole[-1][1] <= b for a, b in taken):
                    spans.append(("crf", whole[0][0], whole[-1][1]))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def train(docs: DataFrame, text_col: str = "text", sample: int = 600, id_col: str = "doc_id") -> Field:
    """The field, learnt from ``sample`` documents that name a secret and as many that don't, or all, if fewer.

    Taken are the rows with the least hashes of id and text, a repeated row once, so the sample is bounded
    however large the table is; whole texts are labelled where they lie, and only words near the first
    matches of each come to the driver: some 1,200 words a document at most.
    """
    low, text = F.lower(F.col(f"`{text_col}`")), F.col(f"`{text_col}`")
    hint = text.contains("AKIA")
    for name in _NAMES:
        hint = hint | low.contains(name)
    known = docs.where(text.isNotNull()).select(text.cast("string").alias("text"), hint.alias("hint"), F.xxhash64(f"`{id_col}`", text).alias("key"))
    sizes = {r["hint"]: r["n"] for r in known.groupBy("hint").agg(F.approx_count_distinct("key").alias("n")).collect()}
    limit = F.lit(0)
    for kind, n in sizes.items():
        limit = F.when(F.col("hint") == kind, int((1 << 20) * min(1.0, 2 * sample / n))).otherwise(limit)

    def label(batches):
        for pdf in batches:
            rows = training_rows(pdf["text"].tolist())
            yield pd.DataFrame({"feats": [f.astype(np.int64).tobytes() for f, _ in rows], "labels": [x.tobytes() for _, x in rows]})

    some = known.where(F.shiftrightunsigned("key", 44) < limit).dropDuplicates(["key"])
    least = F.row_number().over(Window.partitionBy("hint").orderBy(F.shiftrightunsigned("key", 1), "key"))
    rows = some.withColumn("nth", least).where(F.col("nth") <= sample).select("text").mapInPandas(label, "feats binary, labels binary").collect()
    pairs = sorted((bytes(r["feats"]), bytes(r["labels"])) for r in rows)
    return Field().fit([(np.frombuffer(f, np.int64).reshape(-1, 6), np.frombuffer(x, np.int64)) for f, x in pairs])


def scan(docs: DataFrame, text_col: str = "text", sample: int = 600, field: Field | None = None, id_col: str = "doc_id", out_col: str = "spans") -> DataFrame:
    """``docs`` with a column ``out_col`` (kind, start, end; code points, end exclusive).

    A null or empty text has no spans; repeated rows are scanned each; texts are scanned whole, however long.
    Spans of equal start stand in the order of KINDS. An empty table gives no rows. All columns of ``docs`` pass
    through; if one has the name ``out_col``, the new one is called ``fresh(docs, out_col)``.
    """
    out_col = fresh(docs, out_col)
    fitted = docs.sparkSession.sparkContext.broadcast(field or train(docs, text_col, sample, id_col))

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, fitted.value)] for t in texts], dtype=object)

    return docs.withColumn(out_col, spans(F.col(f"`{text_col}`").cast("string")))


def base_digest(spans: str, leave: str | None = "crf") -> Column:
    """kind:start:end, comma-joined in order; without the kind ``leave``."""
    own = F.filter(spans, lambda x: x["kind"] != F.lit(leave)) if leave else F.col(spans)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """``docs`` with every span (merged where they overlap) replaced by ``mark``; other columns stay.

    A null text stays null, an empty one empty; repeated rows are treated each; texts are scanned whole, however
    long; an empty table gives no rows. No column is added, so no name can clash.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, **how))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts, at = [], 0
            for _, a, b in find(text, fitted.value):
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append(text if not parts else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
