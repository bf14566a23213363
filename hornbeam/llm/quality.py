"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low, high or nothing on each document; every
defect is in the sight of several. The votes' patterns are counted over the whole
table, and expectation-maximisation estimates each labeller's accuracy and the
posterior of each pattern. These posteriors, as soft labels of a bounded sample,
train a linear scorer over hashed features, which then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, materialise, working

LOW, NONE, HIGH = -1, 0, 1
BUCKETS = 1 << 14
_SYMBOL = re.compile(rb"[#*$%&|<>!~^=_{}\[\]@]")
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())
#: ASCII letters and digits by class, bytes of other characters as letters, blanks as spaces.
_CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in range(256))
_MARKED = re.compile(rb"[#*$%&|<>!~^=_{}\[\]@][^\x20\x09-\x0d]*")
LABELLERS = ("symbols", "marked", "letters", "capitals", "variety", "repeats", "length", "ends", "runs", "words")


def _side(low: bool, high: bool) -> int:
    return LOW if low else HIGH if high else NONE


def variety(words: list[bytes], size: int = 2000) -> float:
    """Mean share of distinct words in the text's consecutive windows of ``size`` words, weighted by their words.

    Over the whole text the share falls with length, on clean prose too.
    """
    return sum(len(set(words[k : k + size])) for k in range(0, len(words), size)) / max(1, len(words))


def votes(text: str) -> list[int]:
    """One vote per labeller; all abstain on a text without words, but the last, which votes low."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [NONE] * (len(LABELLERS) - 1) + [LOW]
    signs = _SYMBOL.findall(raw)
    symbols = len(signs) / n
    marked = len(_MARKED.findall(raw)) / n if signs else 0.0
    letters = len(raw.translate(None, _NO_LETTERS)) / sum(map(len, words))
    upper = sum(map(str.isupper, text.split())) / n
    kinds = variety(words)
    again = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / (n - 4) if n >= 20 else 0.0
    mean = sum(map(len, words)) / n
    flat = raw.translate(_CLASSES) + b" "
    ends = sum(flat.count(p) for p in (b". ", b"! ", b"? ", b", ", b": ", b"; ")) / n
    run = sum(map(bytes.__eq__, words, words[1:])) / n
    long = n >= 20
    return [
        _side(symbols > 0.2, long and symbols < 0.1),
        _side(marked > 0.15, long and marked < 0.08),
        _side(letters < 0.93 and long, long and letters > 0.96),
        _side(upper > 0.4 and n >= 5, long and upper < 0.15),
        _side(kinds < 0.25 and n >= 50, long and kinds > 0.5),
        _side(again > 0.3, long and again < 0.05),
        _side(mean < 2 or mean > 14, long and 3.5 < mean < 9),
        _side(ends > 0.6 and long, long and ends < 0.35),
        _side(run > 0.2 and n >= 10, long and run < 0.03),
        _side(False, n >= 50),
    ]


def pattern_of(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, x = divmod(pattern, 3)
        out.append(x - 1)
    return out[::-1]


class LabelModel:
    """Accuracies of the labellers and the share of good documents, by expectation-maximisation over pattern counts.

    Labellers depend on each other: a defect draws several low votes at once, and another defect other ones. The
    documents are therefore of several kinds, and within a kind votes are independent. Every kind has free rates,
    under a prior of one vote in all. Two kinds come first, told apart by the starting point alone (0.3 low votes or
    0.7); then kinds are added, each begun at the pattern that is explained worst, while Bayes' information criterion
    falls. How often a labeller abstains is estimated apart from the kinds (``coverage``), so abstentions speak for none.

    The kind with the fewest low votes is good. Another is bad if the labellers' low votes on it, over those on the
    good kind, add up to ``against`` labellers or more: one labeller that turns alone errs.
    """

    def __init__(self, counts: dict[int, int], most: int = 8, rounds: int = 300, against: float = 1.5):
        patterns = sorted(counts)
        v = np.array([votes_of(p) for p in patterns], int).reshape(len(patterns), len(LABELLERS))
        n = np.array([counts[p] for p in patterns], float)
        low, high = (v == LOW).astype(float), (v == HIGH).astype(float)
        self.coverage = n @ (low + high) / max(1.0, n.sum())
        rates, share = np.tile([[0.3], [0.7]], len(LABELLERS)), np.array([0.5, 0.5])
        rates, share, fit = self._climb(low, high, n, rates, share, rounds)
        while len(share) < most and len(patterns):
            k = self._worst(low, high, n, rates, share)
            more = np.vstack([rates, np.where(low[k] > 0, 0.9, np.where(high[k] > 0, 0.1, 0.5))])
            begun = n[k] / (2 * n.sum())
            found = self._climb(low, high, n, more, np.append(share * (1 - begun), begun), rounds)
            cost = (len(LABELLERS) + 1) * np.log(n.sum())
            if 2 * (found[2] - fit) <= cost:
                break
            rates, share, fit = found
        self.rates, self.share = rates, share
        best = rates[int(rates.mean(axis=1).argmin())]
        self.bad = np.maximum(0, rates - best).sum(axis=1) >= against
        self.good = float(share[~self.bad].sum())

    @staticmethod
    def _joint(low: np.ndarray, high: np.ndarray, rates: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Logarithm of each kind's share times the likelihood of each row's votes under it."""
        return low @ np.log(rates.T) + high @ np.log(1 - rates.T) + np.log(share)

    @classmethod
    def _climb(cls, low: np.ndarray, high: np.ndarray, n: np.ndarray, rates: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
        fit = -np.inf
        for _ in range(rounds if len(n) else 0):
            joint = cls._joint(low, high, rates, share)
            norm = np.logaddexp.reduce(joint, axis=1)
            before, fit = fit, float(n @ norm)
            if fit - before < 1e-8 * n.sum():
                break
            weight = n[:, None] * np.exp(joint - norm[:, None])
            share = (weight.sum(axis=0) + 1) / (n.sum() + len(share))
            rates = (weight.T @ low + 0.5) / (weight.T @ (low + high) + 1)
        return rates, share, fit

    @classmethod
    def _worst(cls, low: np.ndarray, high: np.ndarray, n: np.ndarray, rates: np.ndarray, share: np.ndarray) -> int:
        """The pattern that lies most above what is expected among the patterns with the same abstentions."""
        _, same = np.unique(low + high, axis=0, return_inverse=True)
        expected = np.bincount(same.ravel(), n)[same.ravel()] * np.exp(np.logaddexp.reduce(cls._joint(low, high, rates, share), axis=1))
        return int(np.argmax(n * np.log(n / expected)))

    def posterior(self, vote_rows: np.ndarray) -> np.ndarray:
        """The probability of each row of votes to be of a good kind."""
        v = np.asarray(vote_rows, int).reshape(-1, len(LABELLERS))
        joint = self._joint((v == LOW).astype(float), (v == HIGH).astype(float), self.rates, self.share)
        if self.bad.all() or not self.bad.any():
            return np.full(len(v), float(not self.bad.any()))
        good, bad = (np.logaddexp.reduce(joint[:, side], axis=1) for side in (~self.bad, self.bad))
        return 1 / (1 + np.exp(np.clip(bad - good, -30, 30)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, the share of its votes (abstentions aside) that agree with the class."""
        agree = np.where(self.bad[:, None], self.rates, 1 - self.rates)
        return dict(zip(LABELLERS, (self.share @ agree).tolist()))


def shapes(raw: bytes) -> list[bytes]:
    """Each word's shape: letters and digits by class, runs of one class as one."""
    s = raw.translate(_CLASSES)
    for c in (b"a", b"A", b"0"):
        for n in (8, 3, 2, 2):  # what a run of any length shrinks to
            s = s.replace(c * n, c)
        while c * 2 in s:
            s = s.replace(c * 2, c)
    return s.split()


def features(text: str, vote: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, votes, and rough figures of the text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    found: Counter[int] = Counter()
    for shape, n in Counter(shapes(raw)).items():
        found[zlib.crc32(shape[:12]) % BUCKETS] += n
    total = max(1, len(words))
    out = {h: (n / total) ** 0.5 for h, n in found.items()}
    for k, x in enumerate(vote):
        h = zlib.crc32(b"vote:%d:%d" % (k, x)) % BUCKETS
        out[h] = out.get(h, 0.0) + 0.5
    for name, x in (("kinds", variety(words)), ("size", min(1.0, len(words) / 200))):
        h = zlib.crc32(f"{name}:{int(5 * x)}".encode()) % BUCKETS
        out[h] = out.get(h, 0.0) + 0.5
    return np.fromiter(out.keys(), np.int32, len(out)), np.fromiter(out.values(), np.float32, len(out))


class Scorer:
    """Logistic regression over the hashed features, fitted to soft labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-5):
        self.weights, self.bias, self.rows = np.zeros(BUCKETS), 0.0, len(rows)
        seen, order = np.full(BUCKETS, 1e-3), np.random.default_rng(11)
        for _ in range(rounds):
            for k in order.permutation(len(rows)):
                at, x, y = rows[k]
                g = y - self.probability(at, x)
                step = g * x - decay * self.weights[at]
                seen[at] += step * step
                self.weights[at] += rate * step / np.sqrt(seen[at])
                self.bias += 0.01 * g

    def probability(self, at: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.bias + self.weights[at] @ x, -30, 30))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> tuple[LabelModel, Scorer]:
    """Pattern counts over all rows, and a scorer from the ``sample`` different rows of (id, text) with the least hashes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), text)
    n = docs.agg(F.approx_count_distinct(key)).first()[0]
    share = int((1 << 20) * min(1.0, 2 * sample / max(1, n)))  # more than enough: few of many rows are looked at closely
    rows = docs.select(text.alias("text"), key.alias("key"), (F.shiftrightunsigned(key, 44) < share).alias("drawn"))

    def look(batches):
        working("quality")
        met: set[int] = set()
        for pdf in batches:
            counts: Counter[int] = Counter()
            keys, at, x, patterns = [], [], [], []
            for t, key, drawn in zip(pdf["text"], pdf["key"], pdf["drawn"]):
                v = votes(t)
                counts[p := pattern_of(v)] += 1
                if drawn and key not in met:  # a row that is repeated a million times is one
                    met.add(key)
                    f = features(t, v)
                    patterns.append(p)
                    keys.append(key)
                    at.append(f[0].tobytes())
                    x.append(f[1].tobytes())
            none = [None] * len(counts)
            yield pd.DataFrame({"pattern": list(counts) + patterns, "n": list(counts.values()) + [0] * len(patterns), "key": pd.array(none + keys, "Int64"), "at": none + at, "x": none + x})

    seen = materialise(rows.mapInPandas(look, "pattern int, n long, key long, at binary, x binary"), "votes")
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most 3 ** labellers
    labels = LabelModel(counts)
    least = seen.where("at IS NOT NULL").dropDuplicates(["key"]).orderBy(F.shiftrightunsigned("key", 1)).limit(sample)
    drawn = sorted((bytes(r["at"]), bytes(r["x"]), r["pattern"]) for r in least.collect())
    forget(seen)
    soft = labels.posterior(np.array([votes_of(p) for _, _, p in drawn], int))
    return labels, Scorer([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), float(y)) for (a, x, _), y in zip(drawn, soft)])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = 4000, out_col: str = "quality") -> DataFrame:
    """``docs`` with a column ``out_col`` (label: posterior of its votes, score, kept: score reaches the threshold).

    A null text counts as empty; a text without words is not kept. Repeated rows are scored each, and drawn once
    at most for training; ties at the threshold are kept; an empty table gives no rows. Texts are judged whole:
    shares are taken over all words, so a very long text is treated like a short one. All columns of ``docs`` pass
    through; if one has the name ``out_col``, the new one is called ``fresh(docs, out_col)``, with underscores added.
    """
    out_col = fresh(docs, out_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, sample))

    @F.pandas_udf("struct<label:double,score:double,kept:boolean>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        working("quality")
        labels, scorer = model.value
        rows = [votes(t or "") for t in texts]
        score = [scorer.probability(*features(t or "", v)) for t, v in zip(texts, rows)]
        words = [bool(t and t.encode("utf-8", "replace").split()) for t in texts]
        return pd.DataFrame({"label": labels.posterior(np.array(rows, int)), "score": score, "kept": [s >= threshold and w for s, w in zip(score, words)]})

    return docs.withColumn(out_col, judge(F.col(f"`{text_col}`").cast("string")))
