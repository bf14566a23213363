"""Substring deduplication by level-wise doubling of repeated word windows.

Level one looks at short windows, of half the length sought, and only at those that
are the least by hash among their neighbours, so that every window of the full
length holds one. Windows of the full length, twice the half but for the word that
the halves share, are formed only where the short window inside was repeated in
another document, and are looked up in turn; the levels end where the length is
reached or no candidate is left.

Looking up is done on packed arrays. A task first settles what its own documents
show: of equal windows only the smallest document's need to be asked about, so a
passage that stands everywhere makes one entry per batch. Entries go to buckets by
hash, answers go to buckets by document, and both kinds of bucket grow in number,
not in size, with the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, forget, identified, materialise, mix, remembers, rows_of, split_words, windows, working
from .membership import maybe_among

_hashes = WordHashes()
remembers("substring", _hashes.clear)
_FIRST = -(1 << 63)
_ASKED = "bucket int, docs binary, keys binary, hashes binary, owners binary, places binary, known binary, known_owners binary, known_places binary"
_ANSWERED = "part int, docs binary, keys binary, owners binary, places binary"
_PLACED = "doc_id long, key long, places binary"
#: One bucket for so many bytes of text.
BUCKET_BYTES = 24 << 20


def anchors(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short windows, and for each full window the place of its least short window (leftmost of equals)."""
    half = size // 2 + 1
    short = windows(h, half)
    if len(h) < size:
        return short, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, size - half + 1)
    return short, view.argmin(axis=1) + np.arange(len(view))


def asked(found: list[tuple[int, int, np.ndarray, np.ndarray]], buckets: int, turn: int, any_other: bool) -> Iterator[tuple]:
    """Rows of _ASKED for the (document, key, places, hashes) of one batch.

    ``any_other``: the question is whether any other document has the window; else, whether a smaller one has.
    """
    docs, keys = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    owner = np.repeat(np.arange(len(found)), [len(f[2]) for f in found]).astype(np.uint16)
    place = np.concatenate([f[2] for f in found]).astype(np.int32)
    h = np.concatenate([f[3] for f in found])
    order = np.lexsort((docs[owner], h))
    h, owner, place = h[order], owner[order], place[order]
    doc = docs[owner]
    first = np.append(True, h[1:] != h[:-1])
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    least = doc == doc[begin][group]
    many = doc[np.append(begin[1:], len(h)) - 1] != doc[begin]  # the batch itself has another document
    settled = ~least | (many[group] & any_other)
    head = (docs.tobytes(), keys.tobytes())
    send = np.zeros(len(h), bool)
    if any_other:  # others must hear of a window that is settled here: once per window is enough
        send[begin] = True
        send |= ~settled
    else:
        send = least
    known = (send & settled).astype(np.uint8)
    bucket = (mix(h) % np.uint64(buckets)).astype(np.int32)
    at = np.flatnonzero(send)
    at = at[np.argsort(bucket[at], kind="stable")]
    cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
    rest = settled if not any_other else settled & ~send
    own = turn % buckets
    for b in np.flatnonzero((cuts[1:] > cuts[:-1]) | (np.arange(buckets) == own)).tolist():
        mine = at[cuts[b] : cuts[b + 1]]
        more = (owner[rest].tobytes(), place[rest].tobytes()) if b == own else (b"", b"")
        yield (b, *head, h[mine].tobytes(), owner[mine].tobytes(), place[mine].tobytes(), known[mine].tobytes(), *more)


def look_up(rows: DataFrame, buckets: int, any_other: bool) -> DataFrame:
    """(doc_id, key, places): where each document's windows are repeated, of rows of _ASKED."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "key", "place", "hash", "known")}
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r in pdf.itertuples():
            docs, keys = np.frombuffer(r.docs, np.int64), np.frombuffer(r.keys, np.int64)
            owner = np.frombuffer(r.owners, np.uint16)
            for k, v in (("doc", docs[owner]), ("key", keys[owner]), ("place", np.frombuffer(r.places, np.int32)), ("hash", np.frombuffer(r.hashes, np.uint64)), ("known", np.frombuffer(r.known, np.uint8))):
                parts[k].append(v)
            owner = np.frombuffer(r.known_owners, np.uint16)
            done.append((docs[owner], keys[owner], np.frombuffer(r.known_places, np.int32)))
        doc, key, place, h, known = (np.concatenate(parts[k]) for k in ("doc", "key", "place", "hash", "known"))
        order = np.lexsort((doc, h))
        doc, key, place, h, known = (x[order] for x in (doc, key, place, h, known))
        first = np.append(True, h[1:] != h[:-1])[: len(h)]
        begin, group = np.flatnonzero(first), np.cumsum(first) - 1
        if any_other:
            spread = doc[np.append(begin[1:], len(h)) - 1] != doc[begin] if len(h) else np.empty(0, bool)
            yes = spread[group] | (known > 0)
        else:
            yes = doc != doc[begin][group] if len(h) else np.empty(0, bool)
        done.append((doc[yes], key[yes], place[yes]))
        doc, key, place = (np.concatenate([d[k] for d in done]) for k in range(3))
        part = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        out = []
        order = np.lexsort((place, key, doc, part))
        doc, key, place, part = (x[order] for x in (doc, key, place, part))
        for p in np.unique(part).tolist():
            a, b = np.searchsorted(part, [p, p + 1])
            new = np.append(True, (doc[a + 1 : b] != doc[a : b - 1]) | (key[a + 1 : b] != key[a : b - 1]))
            out.append((p, doc[a:b][new].tobytes(), key[a:b][new].tobytes(), (np.cumsum(new) - 1).astype(np.uint32).tobytes(), place[a:b].tobytes()))
        return pd.DataFrame(out, columns=["part", "docs", "keys", "owners", "places"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(np.frombuffer(r.docs, np.int64), np.frombuffer(r.keys, np.int64), np.frombuffer(r.owners, np.uint32), np.frombuffer(r.places, np.int32)) for r in pdf.itertuples()]
        doc, key, place = (np.concatenate(x) for x in zip(*[(d[o], k[o], p) for d, k, o, p in rows]))
        order = np.lexsort((place, key, doc))
        doc, key, place = doc[order], key[order], place[order]
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        return pd.DataFrame({"doc_id": doc[begin], "key": key[begin], "places": [np.unique(p).tobytes() for p in np.split(place, begin[1:])]})

    answers = rows.groupBy("bucket").applyInPandas(answer, _ANSWERED)
    return answers.groupBy("part").applyInPandas(gather, _PLACED)


def _emit(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*rows))
    if columns:
        kinds = [pa.int32()] + [pa.binary()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _ASKED.split(", ")])


def repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, key, places): starts of the windows of ``size`` words that also start in a document with a smaller id.

    ``docs`` has doc_id, key (a hash of the text) and text; null ids have been replaced.
    """
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-octets // BUCKET_BYTES))

    def level_one(batches):
        working("substring")
        for turn, batch in enumerate(rows_of(batches, 2048)):
            found = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = split_words(text)
                if len(words) >= size:
                    short, least = anchors(_hashes.of(words), size)
                    places = np.unique(least)
                    found.append((doc, key, places, short[places]))
            if found:
                yield from _emit(asked(found, buckets, turn, True))

    def level_two(batches):
        working("substring")
        for turn, batch in enumerate(rows_of(batches, 2048)):
            found = []
            for doc, key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                h = _hashes.of(split_words(text))
                short, least = anchors(h, size)
                hit = np.zeros(len(short), bool)
                hit[np.frombuffer(places, np.int32)] = True
                at = np.flatnonzero(hit[least])
                if len(at):
                    found.append((doc, key, at, windows(h, size)[at]))
            if found:
                yield from _emit(asked(found, buckets, turn, False))

    slim = docs.select("doc_id", "key", "text")
    halves = materialise(look_up(slim.mapInArrow(level_one, _ASKED), buckets, True), "halves")
    near = slim.where(maybe_among(halves.select("doc_id"))(F.col("doc_id")))
    candidates = near.join(halves, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    out = materialise(look_up(candidates.mapInArrow(level_two, _ASKED), buckets, False), "repeats")
    forget(halves)
    return out


def deduplicate(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller id; windows
    are judged on the input. Null or empty text: no words. A null id counts as the smallest; rows of one id
    never remove each other's words; an empty table gives no rows. Texts are read whole, however long: a task holds
    the windows of a batch of texts. Of equal windows the one in the smallest id stays, and all its copies there.
    Other columns are not read.
    """
    slim = identified(docs, id_col, text_col).select(F.col("doc_id").alias("own_id"), F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    places = repeated_windows(slim, size)
    may = maybe_among(places.select("doc_id"))(F.col("doc_id"))
    some = slim.where(may).join(places, ["doc_id", "key"], "left").select("own_id", "text", "places")
    none = slim.where(~may).select("own_id", "text", F.lit(None).cast("binary").alias("places"))

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, starts):
            words = split_words(text)
            if at is None:
                out.append((len(words), 0, b" ".join(words).decode()))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.frombuffer(at, np.int32)
            edge[at] += 1
            np.subtract.at(edge, at + size, 1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return some.unionByName(none).select(F.col("own_id").alias("doc_id"), cut("text", "places").alias("r")).select("doc_id", "r.n_words", "r.n_removed", "r.kept")
