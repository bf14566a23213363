"""Best-fit packing of tokenised documents into sequences of a fixed length.

Everything that decides the packing is a histogram of piece lengths, which has
at most ``capacity`` entries however large the corpus is. The plan is made on
the histogram in the driver by exact-complement hashing: for the longest length
left, a single length, a pair or a triple that fills the rest of the sequence
exactly is looked up in an index of sums and as many whole sequences as the
counts allow are formed at once. What finds no exact complement goes through
best-fit decreasing, also by whole groups of equal lengths.

A piece then finds its place from (length, rank among the pieces of that
length). Ranks come from one running count per task and a small table of counts
per task and length, so no length, however common, meets in one task.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, identified, materialise, remembers, together, working

PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Letters (lower case) and digits below U+0180, and the pre-tokeniser's units in such texts (fixed values).
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = re.compile(r"[\x20\x09-\x0d]")
#: The pre-tokeniser's pattern as vocabulary files declare it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\x09-\x0d\x20\x85\xa0{_LETTERS}{_DIGITS}]+")


def gathered(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` that begin and are as long as given, one after the other, and where each ends."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return ids[at], ends


class Remembered:
    """String -> its ids, in arrays: what is new is learnt, and all is forgotten beyond a bound."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.begin = self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")

    def of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each of some different strings, where its ids begin in ``self.ids``, and how many they are."""
        if len(self.words) > self.most:
            self.clear()
        at = pc.index_in(names, value_set=self.words)
        if at.null_count:
            new = names.filter(at.is_null())
            ids, size = self.learn(new.to_pylist())
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
            self.words = pa.concat_arrays([self.words, new])
        places = np.array(at.fill_null(-1))
        places[places < 0] = np.arange(len(self.words) - at.null_count, len(self.words))
        return self.begin[places], self.size[places]


class WordIds:
    """Token ids of blank-separated chunks by the tokenizers library, remembered up to a bound.

    The vocabulary drops white space, so a text's ids are those of its chunks in turn. The chunks of many texts
    are numbered by Arrow, so that each different one is looked at once; the ids then fall into place by array
    arithmetic. Texts whose characters have one-to-one lower case and no combining forms are lower-cased and
    split into the pre-tokeniser's units here; a tokenizer without those two steps encodes each unit once.
    """

    odd = re.compile("[\u0130\u0180-\U0010ffff]")

    def __init__(self, path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        check_declared(self.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        bare = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.steps = {False: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), True: (normalizers.Sequence([]), bare)}
        self.is_bare = False
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.specials[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.units, self.chunks = Remembered(self.learn_units, most), Remembered(self.learn_chunks, most)

    def library(self, bare: bool):
        """The library's tokenizer with its own steps, or without those taken over here."""
        if bare != self.is_bare:
            self.is_bare = bare
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps[bare]
        return self.tokenizer

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library(False).encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of units in lower case: each but an empty one gives one token with a word end, its last."""
        full = [u for u in units if u]
        parts = [np.array(self.library(True).encode_batch_fast([" ".join(full[at : at + 512])], add_special_tokens=False)[0].ids, "<u4") for at in range(0, len(full), 512)]
        ids = np.concatenate([np.empty(0, "<u4"), *parts])
        size = np.zeros(len(units), np.int64)
        size[np.fromiter(map(bool, units), bool, len(units))] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return ids, size

    def learn_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any chunks; a special token between them shows where each ends."""
        out: list[np.ndarray] = []
        for at in range(0, len(chunks), 512):
            part = chunks[at : at + 512]
            if any(s in c for c in part for s in self.specials):
                out += map(self.plain, part)
                continue
            ids = self.plain(self.mark.join(part))
            cuts = np.flatnonzero(ids == self.mark_id)
            out += [ids[a:b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)])]
        return np.concatenate([np.empty(0, "<u4"), *out]), np.fromiter(map(len, out), np.int64, len(out))

    def encode_together(self, texts: list[str], lowered: bool) -> list[bytes]:
        """Ids of texts that are all lowered, or all not."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = lists.flatten().dictionary_encode()  # a text that begins or ends with a blank has an empty chunk there
        if lowered:
            apart = pc.ascii_split_whitespace(pc.replace_substring_regex(chunks.dictionary, f"[\x85\xa0]+|({UNIT.pattern})", r"\1 "))
            units = apart.flatten().dictionary_encode()
            begin, size = self.units.of(units.dictionary)
            index = units.indices.to_numpy()
            ids, ends = gathered(self.units.ids, begin[index], size[index])
            edges = np.append(0, ends)[apart.offsets.to_numpy()]
            begin, size = edges[:-1], np.diff(edges)
        else:
            begin, size = self.chunks.of(chunks.dictionary)
            ids = self.chunks.ids
        index = chunks.indices.to_numpy()
        ids, ends = gathered(ids, begin[index], size[index])
        raw, edges = ids.tobytes(), (4 * np.append(0, ends))[lists.offsets.to_numpy()].tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str | None], together: int = 1 << 21) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, about ``together`` characters at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def done(easy: bool) -> None:
            for (k, _), ids in zip(waiting[easy], self.encode_together([t for _, t in waiting[easy]], easy)):
                out[k].append(ids)
            waiting[easy], size[easy] = [], 0
            give_back()

        for k, text in enumerate(texts):
            if not text:
                continue
            easy = not self.odd.search(text) and not any(s in text for s in self.specials)
            for part in cut_at_blanks(text.lower() if easy else text.encode("utf-8", "replace").decode(), together):
                waiting[easy].append((k, part))
                size[easy] += len(part)
                if size[easy] >= together:
                    done(easy)
        for easy in (True, False):
            if waiting[easy]:
                done(easy)
        return [b"".join(parts) for parts in out]


def cut_at_blanks(text: str, most: int) -> list[str]:
    """A text in parts of about ``most`` characters, each but the last ending before a blank."""
    out, at = [], 0
    while len(text) - at > most and (blank := BLANK.search(text, at + most)):
        out.append(text[at : blank.start()])
        at = blank.start()
    return [*out, text[at:]]


def check_declared(tokenizer) -> None:
    """Refuse vocabularies whose declared steps are not those that this module takes over."""
    declared = json.loads(tokenizer.to_str())
    steps = [p["type"] for p in (declared["normalizer"] or {}).get("normalizers", [])]
    first, *_ = (declared["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if steps != ["NFC", "Replace", "Lowercase"] or first.get("pattern") != {"Regex": PATTERN} or declared["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("a vocabulary with other steps than NFC, blanks, lower case, words: it would be encoded wrongly")


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker: what it has learnt serves the worker's later tasks too."""
    return WordIds(path)


remembers("packing", word_ids.cache_clear)


def tokenised(docs: DataFrame, vocab: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids: the document's ids, then ``end_id``; only longer ones are cut.

    A null or empty text gives one piece that holds ``end_id`` alone; a repeated row gives its pieces again.
    """

    def run(batches):
        working("packing")
        words = word_ids(vocab)
        for batch in together(batches):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                ids += end_id.to_bytes(4, "little")
                n = len(ids) // 4
                out += [(doc, k, s, min(capacity, n - s), ids[4 * s : 4 * (s + capacity)]) for k, s in enumerate(range(0, n, capacity))]
            d, p, s, ln, b = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(ln, pa.int64()), pa.array(b, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return identified(docs).select("doc_id", "text").mapInArrow(run, PIECES)


class Plan:
    """For each length: ranges of ranks and the sequences and offsets they go to."""

    def __init__(self) -> None:
        self.used: dict[int, int] = defaultdict(int)
        self.segments: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.sequences = 0

    def new(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def put(self, length: int, n: int, first: int, offset: int) -> None:
        """The next ``n`` pieces of this length go to sequences first, first + 1, ... at this offset."""
        self.segments[length].append((self.used[length], n, first, offset))
        self.used[length] += n

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(v, dtype=np.int64) for k, v in self.segments.items()}


def plan_packing(counts: dict[int, int], capacity: int = 4096) -> Plan:
    """Exact complements first (single, pair, triple), then best-fit decreasing for the residuals."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    plan, rest = Plan(), {}
    pairs, stale = None, True

    def pair_for(gap: int) -> tuple[int, int] | None:
        a = np.arange((gap + 1) // 2, gap)
        ok = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
        at = np.flatnonzero(ok)
        return (int(a[at[-1]]), int(gap - a[at[-1]])) if len(at) else None

    def complement(gap: int) -> tuple[int, ...] | None:
        nonlocal pairs, stale
        if left[gap]:
            return (gap,)
        if two := pair_for(gap):
            return two
        while True:
            if pairs is None:  # the index of pair sums; it may name sums that have gone meanwhile
                there = (left > 0).astype(np.float64)
                size = 1 << (2 * capacity + 1).bit_length()
                pairs = np.rint(np.fft.irfft(np.fft.rfft(there, size) ** 2, size))[: capacity + 1] > 0
                stale = False
            a = np.arange(1, gap)
            for first in a[(left[a] > 0) & pairs[gap - a]][::-1]:
                left[first] -= 1
                two = pair_for(gap - int(first))
                left[first] += 1
                if two:
                    return (int(first), *two)
            if not stale:
                return None
            pairs = None

    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            if not gap:
                n = int(left[length])
                plan.put(length, n, plan.new(n), 0)
                left[length] = 0
                break
            left[length] -= 1
            found = complement(gap)
            left[length] += 1
            if not found:
                rest[length] = int(left[length])
                left[length], stale = 0, True
                break
            need: dict[int, int] = defaultdict(int)
            for x in (length, *found):
                need[x] += 1
            n = min(int(left[x]) // k for x, k in need.items())
            first, offset = plan.new(n), 0
            for x in (length, *found):
                plan.put(x, n, first, offset)
                left[x] -= n
                offset += x
                stale |= not left[x]

    gaps: list[int] = []  # sorted; for each, groups of sequences (first, how many)
    opened: dict[int, list[tuple[int, int]]] = {}

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in opened:
                opened[gap] = []
                insort(gaps, gap)
            opened[gap].append((first, n))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = opened[gap].pop()
                take = min(n, many)
                if many > take:
                    opened[gap].append((first + take, many - take))
                elif not opened[gap]:
                    del opened[gap], gaps[at]
                plan.put(length, take, first, capacity - gap)
                leave(gap - length, first, take)
                n -= take
                continue
            per = capacity // length
            for many, each in ((n // per, per), (1, n % per)):
                if many and each:
                    first = plan.new(many)
                    for k in range(each):
                        plan.put(length, many, first, k * length)
                    leave(capacity - each * length, first, many)
            n = 0
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset.

    The pieces are written once, with the task that wrote each and its place there. The plan is made
    of the counts of lengths; every piece looks its place up by its rank among those of its length.
    """
    spark = pieces.sparkSession
    own = (F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    kept = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *own), "pieces")
    per_task = kept.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    segments = spark.sparkContext.broadcast(plan_packing(histogram, capacity).arrays())

    def place(batches):
        working("packing")
        where = segments.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                rows, s = np.flatnonzero(length == k), where[int(k)]
                at = np.searchsorted(s[:, 0], rank[rows], side="right") - 1
                seq[rows], off[rows] = s[at, 2] + rank[rows] - s[at, 0], s[at, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*batch.schema.names[:5], "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("task", "length").orderBy("at")) - 1  # among a task's pieces of a length
    ranked = kept.withColumn("nth", nth).join(first, ["task", "length"])
    slim = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("first")).alias("rank"))
    return slim.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece.

    Null text: empty. Empty table: no rows. Repeated doc_ids: each row is packed on its own. Very long texts are
    cut into pieces of ``capacity`` ids, none is dropped. Pieces of equal length take the places of that length in
    the order in which they are written; any order packs equally well. Other columns are not read.
    """
    pieces = tokenised(docs, vocab, capacity, end_id)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed token ids themselves: one row per sequence with its ids (little-endian 32-bit)."""
    placed = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
