"""Near duplicates: a Jaccard join on word shingles by rare-first prefix filtering.

Documents with equal shingle sets are one class and take part once. All classes
order shingles the same way, rare ones first by a count sketch of fixed size over
the whole table. If two sets of sizes x and y reach the threshold they share at least
``need`` shingles, and then the first ``x - need(x) + DEPTH`` of either share at
least DEPTH (or ``need``, if that is less). Classes therefore meet on prefix shingles,
pairs are counted, and length, positional and suffix filters drop pairs before
each is verified once on the whole sets.

No group is expanded into all its pairs. A first round verifies each class only
against the leader, the class of the smallest document, of each prefix shingle it
shares; what is found linked merges. A second round verifies every pair that still
lies in two components, and so loses no link that could join them. There, two
classes that were compared with one leader and share too little with it can link
only by shingles that the leader has not, so they meet on those instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, forget, fresh, hot_slots, identified, materialise, mix, remembers, rows_of, spread_join, windows, working
from .graph import components
from .membership import maybe_among

SKETCH_BITS, _PART = 20, 1 << 12
_FIRST = -(1 << 63)
DEPTH = 3
_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("linked", pa.bool_()), ("common", pa.int64()), ("beyond", pa.list_(pa.int64()))])
_hashes = WordHashes()
remembers("jaccard", _hashes.clear)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text of fewer words is one shingle.

    All texts' words stand in one array and are hashed together; what spans two texts is left out.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # of bytes, lower() changes A to Z alone
    ends = np.cumsum([0, *map(len, words)])
    h = _hashes.of([w for ws in words for w in ws])
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(windows(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.empty(0, np.uint64))
    return out


def hash_of(s: np.ndarray) -> int | None:
    """What stands for a whole set: its class."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def least_overlap(n: int, percent: int) -> int:
    """The fewest common shingles of a set of n with any set that reaches the threshold."""
    return (percent * n + 99) // 100


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' sets have a shingle in each of a fixed number of buckets."""

    def count(batches):
        working("jaccard")
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in rows_of(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), size)
            if sets:
                total += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=len(total)).astype(np.int32)
        for part in range(len(total) // _PART):
            if (own := total[part * _PART : (part + 1) * _PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()])], ["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in parts.collect():  # 4 MB, whatever the table's size
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(bytes(r["counts"]), np.int32)
    return out


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), class (hash of the set), prefix: rarest shingles first."""
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs, size))

    def run(batches):
        working("jaccard")
        for batch in rows_of(batches):
            n, kind, first = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), size):
                n.append(len(s))
                kind.append(hash_of(s))
                many = min(len(s), len(s) - least_overlap(len(s), percent) + DEPTH)
                first.append(s[np.lexsort((s, order.value[s >> np.uint64(64 - SKETCH_BITS)]))[:many]].view(np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(kind, pa.int64()), lists], ["doc_id", "h", "n", "class", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n long, class long, prefix array<long>")


def similar_sizes(nx: Column, ny: Column, percent: int) -> Column:
    """Length filter."""
    return 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)


def possible(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Length and positional filters for two sets that meet at places px and py of their orders."""
    most = F.least(px, py) + F.least(nx - px, ny - py)
    return similar_sizes(nx, ny, percent) & ((100 + percent) * most >= percent * (nx + ny))


def needed(nx: Column, ny: Column, percent: int) -> Column:
    """The fewest common shingles of a pair over the threshold."""
    return F.ceil(percent * (nx + ny) / F.lit(100 + percent))


def enough(nx: Column, ny: Column, met: Column, percent: int) -> Column:
    """Do the prefixes share as many shingles as those of any pair over the threshold?"""
    return met >= F.least(F.lit(DEPTH), needed(nx, ny, percent))


def leads(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Is the shingle among the first of the smaller set, as far as a partner of its size or more needs?

    Such a partner shares at least ``2 * percent / (100 + percent)`` of the set, so DEPTH of the common shingles
    lie in a prefix that is about half as long as the one that larger sets need.
    """
    return F.when(nx <= ny, leading(nx, px, percent)).otherwise(leading(ny, py, percent))


def overlap_possible(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Suffix filter: equal parts of the hash range bound the common shingles from above."""
    edges = np.arange(1, 2**depth, dtype=np.uint64) << np.uint64(64 - depth)
    parts = [np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])) for s in (a, b)]
    return bool(np.minimum(*parts).sum() >= need)


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``; most others are dropped before the shuffle."""
    return docs.where(maybe_among(ids.select("doc_id"))(F.col("doc_id"))).join(ids, "doc_id", "left_semi")


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with the sizes of their sets, and ``linked``, ``common`` (exact unless the suffix
    filter shows that it is too small: then null) and ``beyond``, the shingles of b that a has not (of pairs with ``common``)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = wanted.join(classes.select("class", F.col("rep").alias("doc_id")), "class")
    # a document id may stand in several rows with other texts; the class tells the right one
    texts = narrowed(docs, chosen.select("doc_id")).join(chosen, "doc_id").select("class", "text").distinct()
    one = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        working("jaccard")
        for batch in rows_of(batches, 256):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            kinds = list(dict.fromkeys(t for r in rows for t in r[2:]))
            sets = dict(zip(kinds, shingle_sets(kinds, size)))
            out = []
            for a, b, ta, tb in rows:
                x, y = sets[ta], sets[tb]
                if hash_of(x) == a and hash_of(y) == b:
                    out.append((a, b, len(x), len(y), *compare(x, y, percent)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_COMPARED.names, r)) for r in out], schema=_COMPARED)

    return both.mapInArrow(check, "a long, b long, na long, nb long, linked boolean, common long, beyond array<long>")


def compare(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[bool, int, list[int]]:
    """Linked or not, the common shingles, and those of y that x has not. The suffix filter saves the count of hopeless pairs."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if not len(x) or not len(y) or not overlap_possible(x, y, need // 2):  # far from it: not worth a list
        return False, None, None
    new = np.setdiff1d(y, x, assume_unique=True)
    common = len(y) - len(new)
    return common >= need, common, new.view(np.int64).tolist()


def _size_of(place: str) -> Column:
    return F.shiftright(place, 31)


def _at(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << 31) - 1)


def leading(n: Column, p: Column, percent: int) -> Column:
    """Is place p among the first of a set of n, as far as a partner of its size or more needs?"""
    return p < n - F.floor((2 * percent * n + 99 + percent) / F.lit(100 + percent)) + DEPTH


def pairs_through_prefixes(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that share enough leading prefix shingles.

    Left out are pairs that both were compared with the first class of the shingle and share too little of it:
    they could link only by shingles that it has not, and ``pairs_beyond_leaders`` finds those. Components are
    paired first, under bounds that hold for all their members and are exact where a component is one class.
    """
    n, p = _size_of("place"), _at("place")
    bounds = {
        "c": F.max("common"), "k": F.count("common") == F.count("*"), "n": F.min(n), "m": F.max(n), "p": F.max(p), "r": F.max(n - p),
        "l": F.min(F.when(leading(n, p, percent), n)),
    }
    parts = open_.groupBy("token", "root").agg(*[f.alias(c) for c, f in bounds.items()])
    left, right = (parts.select("token", F.col("root").alias(f"r{side}"), *[F.col(c).alias(f"{c}_{side}") for c in bounds]) for side in "ab")
    one = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    # components whose members are all settled with each other need not be looked into
    whole = F.col("k_a") & F.col("k_b") & (F.least(*one("c")) < needed(*one("n"), percent))
    sizes = (100 * F.col("m_a") >= percent * F.col("n_b")) & (100 * F.col("m_b") >= percent * F.col("n_a"))
    most = (100 + percent) * (F.least(*one("p")) + F.least(*one("r"))) >= percent * (F.col("n_a") + F.col("n_b"))
    ahead = F.coalesce(F.col("l_a") <= F.col("m_b"), F.lit(False)) | F.coalesce(F.col("l_b") < F.col("m_a"), F.lit(False))
    between = left.join(right, "token").where((F.col("ra") < F.col("rb")) & ~whole & sizes & most & ahead)
    between = between.select("token", "ra", "rb", F.col("c_b").alias("cb"), F.col("k_b").alias("kb"), F.col("n_b").alias("nb"))
    a = open_.select("token", F.col("root").alias("ra"), F.col("class").alias("a"), F.col("place").alias("pa"), F.col("common").alias("x"))
    b = open_.select("token", F.col("root").alias("rb"), F.col("class").alias("b"), F.col("place").alias("pb"), F.col("common").alias("y"))
    # nor the members that are settled with the whole of the other component, nor pairs that are
    alone = F.coalesce(F.col("kb") & F.col("x").isNotNull() & (F.least("x", "cb") < needed(_size_of("pa"), F.col("nb"), percent)), F.lit(False))
    settled = F.coalesce(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.least("x", "y") < needed(_size_of("pa"), _size_of("pb"), percent)), F.lit(False))
    places = _size_of("pa"), _at("pa"), _size_of("pb"), _at("pb")
    fits = possible(*places, percent) & leads(*places, percent) & ~settled
    pairs = between.join(a, ["token", "ra"]).where(~alone).join(b, ["token", "rb"]).where(fits)
    # a token is in each prefix once, so the rows of a pair are the leading shingles it shares
    counted = pairs.select("a", "b", _size_of("pa").alias("nx"), _size_of("pb").alias("ny")).groupBy("a", "b", "nx", "ny").agg(F.count("*").alias("met"))
    return counted.where(enough(F.col("nx"), F.col("ny"), F.col("met"), percent)).select("a", "b")


def pairs_beyond_leaders(tried: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components, compared with one leader, that share enough shingles which it has not.

    Of such a pair at most the smaller of the two overlaps with the leader is common inside it, so a class with
    ``common`` shingles in the leader must share ``least_overlap - common`` beyond it, with whatever partner. Its
    remainder is therefore a set to be joined in its turn: ordered rare-first among the classes that were compared
    with this leader, and met on a prefix of that order. Shingles that no class of another component has take no part.
    """
    known = tried.where("common IS NOT NULL").join(roots.withColumnRenamed("node", "b"), "b", "left")
    rows = known.select(F.col("a").alias("lead"), F.col("b").alias("class"), F.coalesce("root", "b").alias("root"), F.col("nb").alias("n"), "common", F.explode("beyond").alias("token"))
    mixed = rows.groupBy("lead", "token").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("lead", "token", "df")
    own = Window.partitionBy("lead", "class")
    rows = rows.join(mixed, ["lead", "token"]).withColumns({"at": F.row_number().over(own.orderBy("df", "token")), "size": F.count("*").over(own)})
    rows = rows.withColumn("share", F.greatest(F.lit(1), F.expr(f"({percent} * n + 99) div 100") - F.col("common")))
    rows = rows.where((F.col("size") >= F.col("share")) & (F.col("at") <= F.col("size") - F.col("share") + 1))
    x, y = (rows.select("lead", "token", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "root", "n", "common", "at", "size")]) for side in "xy")
    # positional filter: at the first shingle that two remainders share, all others they share come later in both;
    # rows of later ones may fail it, but the first row of a pair that has enough passes
    most = F.least("common_x", "common_y") + 1 + F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    hope = similar_sizes(F.col("n_x"), F.col("n_y"), percent) & (most >= needed(F.col("n_x"), F.col("n_y"), percent))
    met = x.join(y, ["lead", "token"]).where((F.col("root_x") < F.col("root_y")) & hope)
    return met.select(F.col("class_x").alias("a"), F.col("class_y").alias("b")).distinct()


def links(seen: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the same components as all links would."""
    classes = seen.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    tokens = seen.where("n > 0").select("doc_id", "class", "n", F.posexplode("prefix").alias("at", "token")).select("token", "class", "doc_id", (F.col("n") * (1 << 31) + F.col("at")).alias("place"))
    doc = F.coalesce("doc_id", F.lit(_FIRST))
    groups = tokens.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min_by("class", doc).alias("lead"), F.min_by("place", doc).alias("lead_place"))
    size_of = lambda c: F.shiftright(c, 31)
    met = materialise(tokens.join(groups.where("low < high"), "token").select("token", "class", "place", "lead", "lead_place"), "met")

    # all that could be near a leader are compared with it, hopeless ones too: what they lack is used later
    star = met.where((F.col("class") != F.col("lead")) & similar_sizes(size_of("place"), size_of("lead_place"), percent))
    counted = star.select("lead", "class", size_of("place").alias("nx"), size_of("lead_place").alias("ny"), "token").distinct().groupBy("lead", "class", "nx", "ny").agg(F.count("*").alias("met"))
    near = counted.where(enough(F.col("nx"), F.col("ny"), F.col("met"), percent)).select(F.col("lead").alias("a"), F.col("class").alias("b"))
    tried = materialise(compared(near, classes, docs, size, percent), "tried")
    first = tried.where("linked").select("a", "b")

    roots = components(first)
    placed = met.select("token", "class", "place", "lead").distinct().join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    overlap = tried.where("common IS NOT NULL").select(F.col("a").alias("lead"), F.col("b").alias("class"), "common")
    own = F.when(F.col("class") == F.col("lead"), size_of("place"))
    open_ = materialise(placed.join(mixed, "token").join(overlap, ["lead", "class"], "left").withColumn("common", F.coalesce("common", own)), "open")
    more = pairs_through_prefixes(open_, percent).unionByName(pairs_beyond_leaders(tried, roots, percent))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = materialise(compared(materialise(more, "more"), classes, docs, size, percent).where("linked").select("a", "b"), "links")
    first = materialise(first, "links")
    for used in (met, open_, tried):
        forget(used)
    return first.unionByName(second)


def rooted(slim: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, h, n and root (what stands for the component; null without words) of every row of (doc_id, text)."""
    seen = materialise(prefixes(slim, size, percent), "prefixes")
    roots = components(links(seen, slim, size, percent))
    rows = seen.select("doc_id", "h", "n", "class")
    placed = rows.join(roots.withColumnRenamed("node", "class"), "class", "left")
    out = materialise(placed.select("doc_id", "h", "n", F.coalesce("root", "class").alias("root")), "rooted")
    forget(seen)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link if 100 * common >= ``percent`` * union of their shingle sets. A null or empty text has
    an empty set and is linked with nothing; a null id is taken as it is and never smallest unless alone;
    repeated rows are linked with each other; an empty table gives no rows. Texts are taken whole, however long:
    a task holds the hashes of a batch of texts. Of shingles equally rare the one with the smaller hash comes
    first, and of documents with equal ids any may lead, which changes no component. Other columns are not read.
    """
    placed = rooted(identified(docs, id_col, text_col), size, percent)
    grouped = placed.where("root IS NOT NULL")
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = spread_join(grouped, smallest, "root", hot_slots(grouped, "root")).select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = placed.where("root IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the smallest by id (null last), then hash of the text.

    Documents without words (null and empty texts among them) stay; of rows with equal id and text one stays.
    All columns of ``docs`` come back under their names. An empty table gives no rows.
    """
    every = rooted(identified(docs, id_col, text_col), size, percent)
    placed = every.where("root IS NOT NULL").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h"))
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    id_name, text_name = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    gone = spread_join(placed, first, "root", hot_slots(placed, "root")).where("place <> first").select("doc_id", "h").distinct()
    gone = materialise(gone.toDF(id_name, text_name), "gone")
    twice = every.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    text, own_id = fresh(docs, "text_hash"), F.col(f"`{id_col}`").cast("long")
    own = docs.withColumn(text, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    may = maybe_among(gone.select(F.col(text_name).alias("h")).union(twice))(F.col(text))  # most rows stay and need not be shuffled
    some = own.where(may).join(gone, own_id.eqNullSafe(F.col(id_name)) & (F.col(text) == F.col(text_name)), "left_anti")
    once = some.dropDuplicates([id_col, text])
    return once.unionByName(own.where(~may)).drop(text)
