"""Language of whole texts: script ranges, per-word scores and Viterbi with a switching penalty.

The model is counts of byte pairs and hashed byte triples inside words, and of
the scripts of words, for each language of the learning rows; the counts cover all
of them. A word's script leaves the languages that use it as candidates; each
candidate scores the word by its log probabilities, and the best labelling of the
words, where every change of language costs a penalty, gives the spans of a text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

TRIPLES = 1 << 17
_PART = 1 << 14
_LETTER = re.compile(r"[^\W\d_]")
#: First bytes of UTF-8 characters by script (fixed values): Latin, Greek, Cyrillic, Armenian and Hebrew,
#: Arabic, South and South-East Asian, other, kana and CJK signs, Han, Hangul, beyond the basic plane.
_SCRIPTS = [(0x61, 0x7A), (0xC2, 0xCB), (0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE2), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xF0, 0xF4)]
SCRIPT = np.zeros(256, np.int64)
for _k, (_a, _b) in enumerate(_SCRIPTS):
    SCRIPT[_a : _b + 1] = max(1, _k)
#: Bytes that are no letters become blanks.
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def grams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all texts in a row: pair and triple of bytes at each place, where words begin and end, each word's text, each byte's script."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)
    b = _KEEP[joined].astype(np.int64)
    pair = b[:-2] * 256 + b[1:-1]
    triple = ((pair * 256 + b[2:]) * 0x9E3779B1 >> 7) % TRIPLES
    inside = b != 32
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    where = np.cumsum([2, *[len(r) + 2 for r in raw]])
    return pair, triple, begin, end, np.searchsorted(where, begin, side="right") - 1, SCRIPT[b]


def learn(rows: DataFrame) -> dict[str, np.ndarray]:
    """Counts per language of (lang, text) rows: byte pairs, triples and scripts in one array each."""
    size = 65536 + TRIPLES + 16

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs) if x == lang and t]
                for at in range(0, len(mine), 256):
                    pair, triple, begin, end, _, script = grams(mine[at : at + 256])
                    n = len(pair) + 1  # a word's grams begin at the blank before it
                    spot = np.cumsum(np.bincount(begin - 1, minlength=n) - np.bincount(end, minlength=n))[: len(pair)] > 0
                    sums = total.setdefault(lang, np.zeros(size, np.int64))
                    sums[:65536] += np.bincount(pair[spot], minlength=65536)
                    sums[65536 : 65536 + TRIPLES] += np.bincount(triple[spot], minlength=TRIPLES)
                    if len(begin):
                        sums[65536 + TRIPLES :] += np.bincount(np.maximum.reduceat(script, begin), minlength=16)[:16]
        for lang, sums in total.items():
            for part, at in enumerate(range(0, size, _PART)):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([sums[at : at + _PART].tobytes()])], ["lang", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in pdf["sums"])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})

    schema = "lang string, part int, sums binary"
    parts = rows.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "part").applyInPandas(add, schema).collect()  # one array per language
    out: dict[str, list[tuple[int, bytes]]] = {}
    for r in parts:
        out.setdefault(r["lang"], []).append((r["part"], bytes(r["sums"])))
    return {lang: np.frombuffer(b"".join(b for _, b in sorted(p)), np.int64) for lang, p in sorted(out.items())}


class Model:
    """Log probabilities and candidate languages by script."""

    def __init__(self, counts: dict[str, np.ndarray], penalty: float, rare: float):
        self.langs, self.penalty = list(counts), penalty
        pairs = np.array([c[:65536] for c in counts.values()], np.float64).reshape(-1, 65536)
        triples = np.array([c[65536 : 65536 + TRIPLES] for c in counts.values()], np.float64).reshape(-1, TRIPLES)
        first = pairs.reshape(len(pairs), 256, 256).sum(axis=2, keepdims=True)
        self.pair = np.log((pairs.reshape(-1, 256, 256) + 0.05) / (first + 0.05 * 256)).reshape(-1, 65536).T.astype(np.float32)
        total = triples.sum(axis=1, keepdims=True)
        self.triple = (0.5 * np.log((triples + 0.1) / (total + 0.1 * TRIPLES))).T.astype(np.float32)
        scripts = np.array([c[65536 + TRIPLES :] for c in counts.values()], np.float64).reshape(-1, 16)
        uses = scripts >= rare * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.candidate = np.where(uses.any(axis=0), uses, True).T

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row of scores per word (0 for the best language), and the text that each word is of."""
        pair, triple, begin, end, owner, script = grams(texts)
        if not len(begin):
            return np.empty((0, len(self.langs)), np.float32), owner
        at = self.pair[pair] + self.triple[triple]
        bounds = np.column_stack([begin - 1, end]).ravel()
        if bounds[-1] >= len(at):
            bounds = bounds[:-1]
        score = np.add.reduceat(at, bounds, axis=0)[::2]
        score = np.maximum(score - score.max(axis=1, keepdims=True), -8)  # one odd word decides nothing
        fits = self.candidate[np.maximum.reduceat(script, begin)]
        return np.where(fits, score, -40).astype(np.float64), owner

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best labelling of the words: Viterbi, where a change costs the penalty.

        A stretch of one other language gains at most its best sum of scores over the text's best language, and
        costs a change at least. Before the first and after the last word of a stretch that gains as much,
        the best language stays; Viterbi runs between them. Only a stretch from the text's own edge to there costs
        no change more, so the range reaches to the edge if such a stretch gains anything.
        """
        best = int(s.sum(axis=0).argmax())
        run = np.zeros((len(s) + 1, s.shape[1]))
        np.cumsum(s - s[:, [best]], axis=0, out=run[1:])
        most = np.maximum.accumulate(run[:0:-1], axis=0)[::-1] - np.minimum.accumulate(run[:-1], axis=0)  # of the stretches that hold the word
        out = np.full(len(s), best)
        pays = np.flatnonzero((most >= self.penalty).any(axis=1))
        if len(pays):
            first, last = int(pays[0]), int(pays[-1]) + 1
            first = 0 if (run[first:].max(axis=0) > 0).any() else first
            last = len(s) if (run[-1] - run[: last + 1].min(axis=0) > 0).any() else last
            out[first:last] = self.viterbi(s[first:last], best if first else None, best if last < len(s) else None)
        return out

    def viterbi(self, s: np.ndarray, before: int | None, after: int | None) -> list[int]:
        langs, cost = range(s.shape[1]), self.penalty
        rows = s.tolist()
        score = [x - (cost if before is not None and k != before else 0.0) for k, x in zip(langs, rows[0])]
        back = []
        for row in rows[1:]:
            top = max(score)
            change, lead = top - cost, score.index(top)
            back.append([k if score[k] >= change else lead for k in langs])
            score = [(x if x >= change else change) + y for x, y in zip(score, row)]
        if after is not None:
            score = [x - (cost if k != after else 0.0) for k, x in zip(langs, score)]
        out = [score.index(max(score))]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Language, share of its words, and spans (language, first word, words) of each text."""
        out: list[tuple[str, float, list]] = [("und", 0.0, [])] * len(texts)
        some = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        for at in range(0, len(some), 128):
            part = some[at : at + 128]
            s, owner = self.scores([texts[k] for k in part])
            edges = np.searchsorted(owner, np.arange(len(part) + 1))
            for j, k in enumerate(part):
                mine = s[edges[j] : edges[j + 1]]
                if not len(mine):
                    out[k] = (self.langs[0], 0.0, [])
                    continue
                path = self.path(mine)
                turns = np.append(0, np.flatnonzero(path[1:] != path[:-1]) + 1)
                sizes = np.diff(np.append(turns, len(path)))
                words = np.bincount(path, minlength=len(self.langs))
                win = int(words.argmax())
                out[k] = (self.langs[win], float(words[win] / len(path)), [(self.langs[path[a]], int(a), int(n)) for a, n in zip(turns, sizes)])
        return out


def identify(docs: DataFrame, learning: DataFrame, text_col: str = "text", penalty: float = 12.0, rare: float = 0.001, out_col: str = "language", most: int = 200) -> DataFrame:
    """``docs`` with a column ``out_col`` (lang, score, spans), learnt from ``learning`` (lang, text).

    A text that is null or has no letter gets ``und`` with score 0 and no spans, and so does every text
    where nothing was learnt. Rows with a null lang or text teach nothing. Repeated rows are labelled each.
    A language is a candidate for a word if at least ``rare`` of its learnt words use the word's script.
    Texts are labelled whole, however long; of languages with equal scores the first by name wins. An empty table
    gives no rows. All columns of ``docs`` pass through; if one has the name ``out_col``, the new one is called
    ``fresh(docs, out_col)``. A model has 0.8 MB a language, so more than ``most`` languages are refused.
    """
    out_col, known = fresh(docs, out_col), learning.where("lang IS NOT NULL AND text IS NOT NULL")
    if (n := len(known.select("lang").distinct().limit(most + 1).collect())) > most:
        raise ValueError(f"{n} languages or more to learn: more than {most} make too large a model")
    counts = learn(known)
    model = docs.sparkSession.sparkContext.broadcast(Model(counts, penalty, rare))

    @F.pandas_udf("struct<lang:string,score:double,spans:array<struct<lang:string,first:int,words:int>>>")
    def label(texts: pd.Series) -> pd.DataFrame:
        rows = model.value.label(texts.tolist())
        return pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"lang": a, "first": b, "words": c} for a, b, c in r[2]] for r in rows]})

    return docs.withColumn(out_col, label(F.col(f"`{text_col}`").cast("string")))
