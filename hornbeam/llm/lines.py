"""Line deduplication by pairwise alignment.

Documents meet through hashes of lines that could make up a block: a line that has enough
words alone, else the shortest run of consecutive lines that has. Such runs are rare where
their lines are not. A run's first document (smallest id) stands for all that hold it, so a
passage that stands in a million documents makes a million pairs, not their square. Every
pair found is aligned by patience diff on the line hashes, what order alone kept apart is
aligned after it, and common blocks of enough words are deleted from the later document.

No later document loses a pair by meeting first holders only: whatever block it shares
with any earlier document consists of such runs, and it meets each run's first holder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, hot_slots, identified, materialise, spread_join, working
from .membership import marks, maybe_among
from .rules import BLANKS

_FIRST = -(1 << 63)
_BITS = 23


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sub-list with rising second members of pairs with rising first members."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        before.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two lists: anchored at elements unique in both, extended to equal neighbours, again in the gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def run_spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs of lines that make a block, from each line on and up to each line; of a text of fewer words, all of it.

    Every line of a common block stands in such a run within the block, and the run is one in the other text too.
    """
    ends = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    if ends[-1] < min_words:
        return [(0, len(words))] if len(words) else []
    to = np.searchsorted(ends, ends[:-1] + min_words)  # a run from line k ends before line to[k]
    since = np.searchsorted(ends, ends[1:] - min_words, "right") - 1  # a run up to line k begins at line since[k]
    return sorted({(k, m) for k, m in enumerate(to.tolist()) if m < len(ends)} | {(m, k + 1) for k, m in enumerate(since.tolist()) if m >= 0})


def part_spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """All runs of lines with fewer words than a block needs: a whole text of so few words may stand there."""
    ends = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    to = np.searchsorted(ends, ends[:-1] + min_words).tolist()
    return [(a, b) for a, m in enumerate(to) for b in range(a + 1, min(m, len(words) + 1))]


def common_blocks(earlier: list[int], later: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions of the later document's lines in common blocks of enough words, or in a block that is all of it.

    Blank lines (hash 0) take no part, so they neither begin nor end a block.
    """
    full_b = [k for k, x in enumerate(later) if x]
    one, two, n = [x for x in earlier if x], [later[k] for k in full_b], [words[k] for k in full_b]
    gone: set[int] = set()
    run: list[int] = []

    def settle() -> None:
        if run and (len(run) == len(two) or sum(n[k] for k in run) >= min_words):
            gone.update(run)

    last = (-2, -2)
    for i, j in patience(one, two):
        if (i, j) != (last[0] + 1, last[1] + 1):
            settle()
            run = []
        run.append(j)
        last = i, j
    settle()
    left, there = [k for k in range(len(two)) if k not in gone], set(one)
    if any(two[k] in there for k in left):  # blocks that stand in another order, or beside an equal line
        spans = [(a, b) for a, b in run_spans(n, min_words) if not gone.issuperset(range(a, b)) and there.issuperset(two[a:b])]
        for size in {b - a for a, b in spans}:
            held = {tuple(one[k : k + size]) for k in range(len(one) - size + 1)}
            gone.update(k for a, b in spans if b - a == size and tuple(two[a:b]) in held for k in range(a, b))
    return [full_b[k] for k in sorted(gone)]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the key that orders documents: id, then hash of the text."""
    key = F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("id"), F.xxhash64("text").alias("h"))
    return docs.withColumn("key", key)


def line_hashes(text: Column) -> tuple[Column, Column]:
    """Hash of each trimmed line, 0 for a blank one, and its number of words."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    bare = F.transform(lines, lambda x: F.trim(F.translate(x, BLANKS, " " * len(BLANKS))))
    hashes = F.transform(bare, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))
    return hashes, F.transform(bare, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " +"))))


def _hash(lines: np.ndarray, span: tuple[int, int]) -> int:
    return xxhash.xxh3_64_intdigest(lines[span[0] : span[1]].tobytes()) - (1 << 63)


def held_runs(lists: DataFrame, min_words: int) -> DataFrame:
    """(id, h, run, asks): the runs of every document; ``asks``: an earlier holder of the run takes it from this one.

    Runs of fewer words than a block are told of only where they may be all of some document.
    """
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    slot = lambda h: h & ((1 << _BITS) - 1)  # noqa: E731 - runs are hashes already

    def whole(batches):
        working("lines")
        for pdf in batches:
            data = [np.array([x for x in xs if x], np.int64) for xs in pdf["lines"]]
            yield pd.DataFrame({"slot": [slot(_hash(d, (0, len(d)))) for d in data if len(d)]}, dtype="int64")

    wanted = lists.sparkSession.sparkContext.broadcast(marks(lists.where(total.between(1, min_words - 1)).mapInPandas(whole, "slot long"), _BITS))

    def runs(batches):
        working("lines")
        known = wanted.value
        any_short = bool(known.any())
        for pdf in batches:
            out = []
            for i, h, lines, words in zip(pdf["id"], pdf["h"], pdf["lines"], pdf["words"]):
                full = np.flatnonzero(lines)
                data, n = np.asarray(lines, np.int64)[full], np.asarray(words)[full].tolist()
                found = {_hash(data, s): True for s in run_spans(n, min_words)}
                if any_short:
                    for s in part_spans(n, min_words):
                        at = slot(r := _hash(data, s))
                        if known[at >> 3] >> (7 - (at & 7)) & 1:
                            found.setdefault(r, False)
                out += [(i, h, r, asks) for r, asks in found.items()]
            yield pd.DataFrame(out, columns=["id", "h", "run", "asks"])

    return lists.mapInPandas(runs, "id long, h long, run long, asks boolean")


def removals(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(id, h, gone): positions of the lines that go, for every document of (doc_id, text) that loses any."""
    hashes, words = line_hashes(F.col("text"))
    key = F.struct("id", "h")
    lists = keyed(docs).select("key.id", "key.h", hashes.alias("lines"), words.alias("words"))
    lists = materialise(lists.dropDuplicates(["id", "h"]), "lines")
    runs = materialise(held_runs(lists, min_words), "runs")
    shared = runs.groupBy("run").agg(F.count("*").alias("df"), F.min(key).alias("first")).where("df > 1").drop("df")
    met = spread_join(runs.where("asks"), shared, "run", hot_slots(runs, "run")).where(key != F.col("first"))
    pairs = materialise(met.select("id", "h", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h")).distinct(), "pairs")
    firsts = lists.select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.col("lines").alias("earlier"))
    both = spread_join(pairs, firsts, ["first_id", "first_h"], hot_slots(pairs, ["first_id", "first_h"])).join(lists, ["id", "h"])

    def align(batches):
        working("lines")
        for pdf in batches:
            gone = [common_blocks(e.tolist(), x.tolist(), w.tolist(), min_words) for e, x, w in zip(pdf["earlier"], pdf["lines"], pdf["words"])]
            out = pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "gone": gone})
            yield out[out["gone"].map(len) > 0]

    found = both.select("id", "h", "earlier", "lines", "words").mapInPandas(align, "id long, h long, gone array<int>")
    out = materialise(found.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "removals")
    for used in (lists, runs, pairs):
        forget(used)
    return out


def deduplicate_lines(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without the deleted lines, and n_lines and n_removed (lines with words).

    A line goes if it lies in a block of consecutive lines (blank ones aside) of ``min_words`` words or more that an
    earlier document holds as well, or if the whole document is one block of an earlier one.
    Null text: stays null, with no lines. A null id counts as the smallest. Repeated rows are one document
    and get the same result; of two texts under one id the smaller hash is the earlier. Empty table: no rows.
    Texts are read whole, however long; a pair is aligned on the hashes of its lines alone.
    Added columns replace columns of the same names.
    """
    hashed, found_id, found_hash, found = (fresh(docs, c) for c in ("text_hash", "found_id", "found_hash", "found"))
    gone = removals(identified(docs, id_col, text_col), min_words).toDF(found_id, found_hash, found)
    text = F.col(f"`{text_col}`").cast("string")
    own_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_FIRST))
    own = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (id_col, text_col)]).withColumn(hashed, F.xxhash64(text))
    may = maybe_among(gone.select(found_hash))(F.col(hashed))  # most documents lose nothing and need not be shuffled
    some = own.where(may).join(gone, (own_id == F.col(found_id)) & (F.col(hashed) == F.col(found_hash)), "left").drop(found_id, found_hash)
    marked = some.unionByName(own.where(~may).withColumn(found, F.lit(None).cast("array<int>")))
    lines = F.split(text, "\n")
    left = F.when(F.col(found).isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(found, i)), "\n"))
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, BLANKS, "") != "")).cast("long")
    out = marked.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size(found), F.lit(0)).cast("long")}).withColumn(text_col, left)
    return out.drop(found, hashed)
