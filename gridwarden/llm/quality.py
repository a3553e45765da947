"""Quality rules with cross-document line frequency, in built-in functions only.

Base rules look at one text: word count, repeated three-word windows, repeated
lines, symbols.  The frequency rule looks across texts: lines are normalised (lower
case, digits as 0, white space as one space) and hashed; for each host the distinct
documents that hold a line are counted; a line that more than ``LINE_SHARE`` percent of the
host's documents hold, and more than ``LEAST_DOCUMENTS`` of them, is removed; and a document
of which less than ``LEAST_SHARE`` percent of the words remain is rejected.  The limit is a
share because hosts differ in size: it means the same on a host of 50 documents and of 50 million.

What is shuffled are 64-bit hashes of lines, each once for a document.  Rows meet by
doc_id first, so that equal rows count once, and are counted map-side before they meet by
line.  The frequent lines of a host are at most (lines of its average document) x 100 / LINE_SHARE,
whatever its size, so they go to the documents as one short array for each host; texts are never shuffled.

Repeated windows are found inside the row: the windows' hashes, with the position in
their low bits, are sorted as one array of longs; neighbours with equal hashes are
compared word by word; and the covered words follow from the sorted positions.  This takes
n log n steps on any text and no shuffle.

Cases: a null or empty text has no words, fails the base rules and is rejected; a null
host is a host of its own; rows of one doc_id are one document of each of their hosts, and
each row gets its own result; rows without a doc_id are one document; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: A line is removed on a host if more than this percentage of its documents, and more than so many of them, hold it.
LINE_SHARE, LEAST_DOCUMENTS = 5, 5
#: Percentage of a document's words that must remain.
LEAST_SHARE = 50
#: The six white-space characters between words, and the symbol characters.
BLANK, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def _words(text):
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def _without(text, chars: str):
    return F.length(F.translate(text, chars, ""))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    step1 = docs.withColumns({"_words": _words(text), "_own": lines, "_text": text})
    step2 = step1.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": _without(F.col("_text"), BLANK).cast("bigint"),
            "n_symbols": (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_own") - F.size(F.array_distinct("_own"))).cast("bigint"),
            # low bits that hold a position
            "_mask": F.expr("shiftleft(1L, cast(ceil(log2(greatest(size(_words), 2))) as int) + 1) - 1L"),
        }
    )
    keys = F.expr(
        "CASE WHEN size(_words) < 3 THEN cast(array() as array<bigint>) ELSE sort_array(transform(sequence(0, size(_words) - 3),"
        " i -> (xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) & ~_mask) | cast(i as bigint))) END"
    )
    same = (
        "((get(_keys, {a}) ^ get(_keys, {b})) & ~_mask) = 0L AND "
        + " AND ".join(f"get(_words, cast(get(_keys, {{a}}) & _mask as int) + {k}) = get(_words, cast(get(_keys, {{b}}) & _mask as int) + {k})" for k in range(3))
    )
    repeats = F.expr(
        "CASE WHEN size(_keys) < 2 THEN cast(array() as array<bigint>) ELSE sort_array(transform(filter(sequence(0, size(_keys) - 1), j ->"
        f" (j > 0 AND {same.format(a='j', b='j - 1')}) OR (j < size(_keys) - 1 AND {same.format(a='j', b='j + 1')})), j -> get(_keys, j) & _mask)) END"
    )
    covered = F.expr(
        "CASE WHEN size(_at) = 0 THEN 0L WHEN size(_at) = 1 THEN 3L ELSE"
        " 3L + aggregate(sequence(1, size(_at) - 1), 0L, (s, k) -> s + least(3L, get(_at, k) - get(_at, k - 1))) END"
    )
    return (
        step2.withColumn("_keys", keys).withColumn("_at", repeats).withColumn("n_repeat_words", covered)
        .drop("_words", "_own", "_text", "_mask", "_keys", "_at")
    )


def _lines(text):
    """Normalised lines that have a word, each as (number of the line, hash, words)."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "123456789", "000000000")
    # white space other than the line's end becomes one space; a line's ends are trimmed below
    split = F.split(F.regexp_replace(plain, "[ \\t\\x0b\\f\\r]+", " "), "\n")
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("no"), F.btrim(x).alias("line")))
    return F.transform(
        F.filter(numbered, lambda x: x["line"] != ""),
        lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["line"]).alias("key"), (F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "))) + 1).alias("words")),
    )


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def frequent_lines(docs: DataFrame, host_col: str = "source", share: int = LINE_SHARE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(host, frequent array<bigint>): hashes of the normalised lines above the limit, one row for each host that has any."""
    return _frequent(docs.select("doc_id", _host(host_col).alias("_host"), _lines(F.col("text").cast("string")).alias("_lines")), share, least)


def _frequent(rows: DataFrame, share: int, least: int) -> DataFrame:
    """The same from (doc_id, _host, _lines)."""
    # rows of a doc_id lie together, so that distinct lines of a document need no further shuffle
    keys = rows.select("doc_id", F.col("_host").alias("host"), F.array_distinct(F.transform("_lines", lambda x: x["key"])).alias("keys"))
    held = keys.repartition("doc_id").select("doc_id", "host", F.explode("keys").alias("key")).distinct()
    counts = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > least)
    sizes = rows.select("doc_id", F.col("_host").alias("host")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    over = counts.join(sizes, "host").filter(100 * F.col("documents") > share * F.col("size"))
    return materialise(over.groupBy("host").agg(F.collect_set("key").alias("frequent")))


def _gone(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with ``_lines`` and ``_host`` replaced by ``_gone``, those lines (no, key, words) that are frequent on the row's host."""
    table = frequent.select(F.col("host").alias("_known"), F.col("frequent").alias("_frequent"))
    # of most documents no line is frequent: one pass over two hash sets says so
    hit = F.array_intersect(F.transform("_lines", lambda x: x["key"]), F.col("_frequent"))
    some = F.size(F.coalesce("_hit", F.array().cast("array<bigint>"))) > 0
    gone = F.when(some, F.filter("_lines", lambda x: F.array_contains(F.col("_hit"), x["key"]))).otherwise(F.filter("_lines", lambda x: F.lit(False)))
    joined = rows.join(table, F.col("_host") == F.col("_known"), "left")
    return joined.withColumn("_hit", hit).withColumn("_gone", gone).drop("_lines", "_hit", "_host", "_known", "_frequent")


def clean(docs: DataFrame, host_col: str = "source", share: int = LINE_SHARE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with ``removed_lines`` (numbers from 0, ascending) and ``clean_text``, the text without these lines."""
    rows = docs.withColumns({"_lines": _lines(F.col("text")), "_host": _host(host_col)})
    gone = _gone(rows, frequent_lines(docs, host_col, share, least)).withColumn("removed_lines", F.transform("_gone", lambda x: x["no"]))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed_lines", i))
    return gone.withColumn("clean_text", F.array_join(left, "\n")).drop("_gone")


def judge(docs: DataFrame, host_col: str = "source", share: int = LINE_SHARE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), _host(host_col).alias("_host"))
    # one pass over the texts: what is counted, and what meets the frequent lines, are the numbers written here
    measured = materialise(base_metrics(rows.withColumn("_lines", _lines(F.col("text")))).drop("text"))
    words = F.aggregate("_gone", F.lit(0).cast("bigint"), lambda s, x: s + x["words"])
    marked = _gone(measured, _frequent(measured, share, least)).withColumn("removed_words", words)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < LEAST_SHARE * F.col("n_words")
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )
