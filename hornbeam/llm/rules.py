"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base figures are computed per document. The method then hashes the normalised
lines, counts in how many distinct texts of a host each stands, takes lines above
the host's limit as boilerplate, removes them, and rejects documents that they deplete.

Texts are read once: what is needed of them, the figures and the line hashes, is
written as a slim table, and all that follows works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, identified, materialise

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
_BLANKS_IN_LINE = r"[\x20\x09\x0B-\x0D]+"


def words(text: Column) -> Column:
    """The blank-separated words; none for a text without words."""
    bare = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def repeated_words(w: Column, hashes: Column, size: int = 5) -> Column:
    """Words that stand in a window which occurs twice or more; ``hashes`` are the windows' in order."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda e, k: F.get(s, k)["h"] == e["h"]
        twice = F.filter(s, lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    # one-element transforms name the sorted array once, so that it is computed once
    first = F.get(F.transform(F.array(by_hash), starts), F.lit(0))
    zero = F.struct(F.lit(-size).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(first, zero, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(size), p - a["at"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def host_key(host: str) -> Column:
    """The host under a mark; a null host is a host of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))


def line_marks(text: Column) -> Column:
    """The hash and the number of words of every normalised line that has words, in order."""
    plain = F.split(F.trim(F.lower(F.regexp_replace(text, _BLANKS_IN_LINE, " "))), " ?\n ?")
    n = lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1
    return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), n(x).alias("n")))


def line_hash(line: Column) -> Column:
    """The hash of one raw line, as in ``line_marks``."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, _BLANK_RUN, " "))))


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host, marks and the base figures of every row of (doc_id, text, host); a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    host = host_key("host").alias("host")
    with_words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), host, text.alias("text"), words(text).alias("w"), lines.alias("lines"), line_marks(text).alias("marks"))
    n = F.size("w")
    at = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    own = ["doc_id", "text_hash", "host", "marks"]
    figures = with_words.select(
        *own, "w", hashes.alias("hashes"), n.cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return figures.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("w"), F.col("hashes")).cast("long").alias("n_repeat_words"))


def common_lines(rows: DataFrame, share: float, least: int, copies: bool = False) -> DataFrame:
    """(host, line) of lines in more than ``least`` texts and more than ``share`` of the host's texts.

    ``rows`` has row (its number), host, text_hash, marks. With ``copies``, documents are counted in place of different texts.
    """
    each = rows.select("row", "host", "text_hash") if copies else rows.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    texts = each.groupBy("host").agg(F.count("*").alias("texts"))
    counted = rows if copies else rows.join(each.select("row"), "row", "left_semi")
    lines = counted.select("host", F.explode(F.array_distinct(F.transform("marks", lambda x: x["line"]))).alias("line"))
    spread = lines.groupBy("host", "line").agg(F.count("*").alias("in_texts")).where(F.col("in_texts") > least)
    return spread.join(texts, "host").where(F.col("in_texts") > share * F.col("texts")).select("host", "line")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a number each, written so that the numbers stay what they are."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), name)


def quality_rules(
    docs: DataFrame, host: str = "source", share: float = 0.02, least: int = 20, min_words: int = 10, min_left: float = 0.2, copies: bool = False
) -> DataFrame:
    """One row per row of ``docs``: base figures, words in common lines, base_failed, kept.

    A document is depleted when its common lines leave fewer than ``min_words`` words or less than
    ``min_left`` of them. Copies of one text count once, so copies alone make no line common, unless
    ``copies`` asks that every document is counted.
    A null or empty text has no words and fails the base rule; a null host is a host of its own;
    a repeated row appears again with the same figures; an empty table gives no rows. Texts are taken whole,
    however long; a line at a limit is not yet common. Other columns are not read.
    """
    rows = _numbered(base_figures(identified(docs, "doc_id", "text", host).withColumnRenamed(host, "host")), "figures")
    lines = rows.select("row", "host", F.explode("marks").alias("mark")).select("row", "host", "mark.line", "mark.n")
    common = lines.join(common_lines(rows, share, least, copies), ["host", "line"])
    per_row = common.groupBy("row").agg(F.sum("n").cast("long").alias("in_common"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    removed = F.coalesce("in_common", F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.alias("n_common_words"),
        failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def remove_common_lines(docs: DataFrame, host: str = "source", text_col: str = "text", share: float = 0.02, least: int = 20, copies: bool = False) -> DataFrame:
    """``docs`` with the lines above the limits of their host taken out of ``text_col``; no row goes.

    A text without such lines, a null one among them, stays as it is, and blank lines stay. A null host is a host of
    its own; repeated rows are treated alike; an empty table gives no rows; all columns come back under their names.
    Texts are taken whole, however long.
    """
    text, key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), host_key(f"`{host}`")
    rows = _numbered(docs.select(key.alias("host"), F.xxhash64(text).alias("text_hash"), line_marks(text).alias("marks")), "marks")
    # what goes depends on host and text alone
    each = rows.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    lines = rows.join(each.select("row"), "row", "left_semi").select("host", "text_hash", F.explode("marks.line").alias("line"))
    gone = lines.join(common_lines(rows, share, least, copies), ["host", "line"]).groupBy("host", "text_hash").agg(F.collect_set("line").alias("gone"))
    names = [fresh(docs, c) for c in ("own_host", "own_hash", "gone_lines")]
    own = docs.withColumns({names[0]: key, names[1]: F.xxhash64(text)}).join(gone.toDF(*names), names[:2], "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(names[2], line_hash(x))), "\n")
    out = F.when(F.col(names[2]).isNull(), F.col(f"`{text_col}`")).otherwise(left)
    return own.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
