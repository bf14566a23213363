"""Byte-level BPE by speculation and verification, and its decoding.

For each word (a unit of the pre-tokeniser) the greedy longest match over the
vocabulary proposes tokens. A proposal is the merge rules' own result exactly
if every two neighbours are compatible, that is, if merging the bytes of the
pair alone gives the same two tokens back. All neighbours of a batch are looked
up at once in a sorted table of pairs judged so far; pairs not seen before are
judged by merging them. Only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import identified, remembers, rows_of, working

#: The byte-level pre-tokeniser's pattern (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank between two non-blanks always begins a new word, so texts may be cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")

#: Above every rank.
NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def check_declared(spec: dict) -> None:
    """Refuse vocabularies whose declared steps are not those that this module carries out."""
    first, model = spec.get("pre_tokenizer") or {}, spec["model"]
    split = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if spec.get("normalizer") or not split or not plain:
        raise ValueError("a vocabulary with other steps than byte-level words and merges: it would be encoded wrongly")


class Bpe:
    """Encoder and decoder of one vocabulary file; remembers words up to ``most``."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_declared(spec)
        back = byte_symbols()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *added.values()])
        self.token = [b""] * self.size
        for t, i in vocab.items():
            self.token[i] = bytes(back[c] for c in t)
        for t, i in added.items():
            self.token[i] = t.encode()
        self.added = added
        self.split_added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.byte_id = [vocab[c] for c, _ in sorted(back.items(), key=lambda x: x[1])]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] * self.size + vocab[b], rank * self.size + vocab[a + b])
        self.ids = {self.token[i]: i for i in vocab.values() if self.merged(self.token[i]) == [i]}
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[:2], set()).add(len(t))
        for b in range(256):
            for k in range(256):
                if (two := bytes((b, k))) in lengths:
                    lengths[two].add(1)
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.most = most
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.judged = np.empty(0, np.int64)  # pairs seen, sorted; and whether they are compatible
        self.verdict = np.empty(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """The merge rules applied exactly, lowest rank first and leftmost among equals."""
        ids, n, get, size = [self.byte_id[b] for b in word], len(word), self.merge.get, self.size
        if n < 48:
            ranks = [get(a * size + b, NEVER) for a, b in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != NEVER:
                at, new = ranks.index(best), best % size
                ids[at : at + 2] = [new]
                del ranks[at]
                if at:
                    ranks[at - 1] = get(ids[at - 1] * size + new, NEVER)
                if at < len(ranks):
                    ranks[at] = get(new * size + ids[at + 1], NEVER)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (m := get(ids[a] * size + ids[b], NEVER)) != NEVER:
                heapq.heappush(heap, (m // size, a, ids[a], ids[b], m % size))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, a, left, right, new = heapq.heappop(heap)
            if not alive[a] or after[a] >= n or ids[a] != left or ids[after[a]] != right:
                continue
            b = after[a]
            ids[a], alive[b], after[a] = new, False, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [i for i, ok in zip(ids, alive) if ok]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        out, at, n, ids, lengths = [], 0, len(word), self.ids, self.lengths
        while at < n:
            for k in lengths.get(word[at : at + 2], (1,)):
                if (i := ids.get(word[at : at + k])) is not None and at + k <= n:
                    out.append(i)
                    at += k
                    break
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (left * size + right): does merging its bytes give these two tokens?"""
        kinds, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.judged, kinds)
        known = (at < len(self.judged)) & (self.judged[np.minimum(at, len(self.judged) - 1)] == kinds) if len(self.judged) else np.zeros(len(kinds), bool)
        out = np.zeros(len(kinds), bool)
        out[known] = self.verdict[at[known]]
        new = kinds[~known]
        if len(new):
            fresh = np.array([self.merged(self.token[p // self.size] + self.token[p % self.size]) == [p // self.size, p % self.size] for p in new.tolist()], bool)
            out[~known] = fresh
            if len(self.judged) > 4 * self.most:
                self.judged, self.verdict = new, fresh
            else:
                keys = np.concatenate([self.judged, new])
                order = np.argsort(keys, kind="stable")
                self.judged, self.verdict = keys[order], np.concatenate([self.verdict, fresh])[order]
        return out[back]

    def learn(self, words: list[str]) -> None:
        """Propose for all, check all neighbours at once, merge what fails."""
        raw = [w.encode("utf-8", "replace") for w in words]
        tokens = [self.proposed(w) for w in raw]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ok = self.compatible(flat[inside] * self.size + flat[inside + 1])
        for k in np.unique(owner[inside[~ok]]).tolist():
            tokens[k] = self.merged(raw[k])
        self.words.update((w, np.array(ts, np.int32).tobytes()) for w, ts in zip(words, tokens))

    def learn_chunks(self, chunks: set[str]) -> None:
        if len(self.words) > 2 * self.most:
            self.words.clear()
        split = {c: PIECES.findall(c) for c in chunks}
        new = {w for ws in split.values() for w in ws if w not in self.words}
        if new:
            self.learn(list(new))
        for c, ws in split.items():
            self.chunks[c] = b"".join([self.words[w] for w in ws])

    def cut(self, text: str) -> list[str]:
        """Chunks that the pre-tokeniser never joins, and the special tokens between them."""
        out: list[str] = []
        at = 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            out += self.cut_plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.cut_plain(text[at:] if at else text)

    @staticmethod
    def cut_plain(text: str) -> list[str]:
        if not text:
            return []
        first, *rest = CUT.split(text)
        return [first, *[" " + c for c in rest]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.chunks) > self.most or not self.chunks:
            self.chunks = {t: np.int32(i).tobytes() for t, i in self.added.items()}
        split = [self.cut(t) if t else [] for t in texts]
        if new := {c for c in set().union(*split) if c not in self.chunks}:
            self.learn_chunks(new)
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, cs)), np.int32) for cs in split]

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def bpe(path: str) -> Bpe:
    """One per Python worker: what it has learnt serves the worker's later tasks too."""
    return Bpe(path)


remembers("bpe", bpe.cache_clear)


def encode_decode(docs: DataFrame, vocab: str) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string.

    A null text counts as empty: no ids, an empty decoded text. Repeated rows are encoded each. Texts are encoded
    whole, however long; merges of equal rank go from left to right, as the rules say. An empty table gives no rows.
    Other columns are not read, so no name can clash. A vocabulary file that declares other steps than
    byte-level pre-tokenisation and byte-pair merges is refused (ValueError).
    """

    def run(batches):
        working("bpe")
        coder = bpe(vocab)
        for batch in rows_of(batches, 256):
            ids = coder.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays, pa.array([coder.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return identified(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
