"""Quality rules from a text's own words and lines, and from lines that many documents of a host
share, with DataFrame functions alone.

Lines are compared in a normal form (lower case, digits as one zero, blanks as one space). Of each
host the distinct texts are counted that have a line; lines above both limits are taken away, and
a document that keeps too little of itself is rejected. Copies of one text count once, so that
copies alone never make a line frequent: finding copies is another operator's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, by_class
from .syncmers import let

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window, and words that a text needs.
WINDOW, LEAST_WORDS = 8, 20
#: Per cent of a text's words that may stand in windows found twice or more.
MOST_REPEATED = 30
#: A line is frequent if more texts of its host have it than either limit: a number, and a per cent.
LEAST_TEXTS, MOST_SHARE = 10, 5
#: A document is depleted if fewer per cent of the characters of its lines are left.
LEAST_LEFT = 30
#: Frequent lines that are broadcast, at most; more of them are joined by their key.
BROADCAST_LINES = 100_000


def words(text: Column) -> Column:
    """Runs of other characters than blanks, in order."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda bare: F.when(bare != "", F.split(bare, GAP)).otherwise(F.array().cast("array<string>")))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many of these words stand in a window of `window` words (a power of two) that the list
    has twice or more, the first occurrence included. Windows are compared by 64-bit hashes."""

    def joined(h: Column, apart: int) -> Column:
        n = F.size(h) - apart
        return F.zip_with(F.slice(h, 1, n), F.slice(h, apart + 1, n), lambda a, b: F.xxhash64(a, b))

    def hashed(h: Column, apart: int = 1) -> Column:
        return h if apart == window else let(joined(h, apart), lambda wider: hashed(wider, 2 * apart))

    def again(h: Column) -> Column:
        return let(F.sort_array(F.transform(h, lambda x, at: F.struct(x.alias("h"), at.alias("at")))), among)

    def among(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = lambda i: ((i > 0) & same(i, i - 1)) | ((i < F.size(s) - 1) & same(i, i + 1))
        at = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(twice(i), F.lit(False))), lambda i: F.get(s, i)["at"])
        return let(F.sort_array(at), covered)

    def covered(at: Column) -> Column:
        n = F.size(at) - 1
        steps = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, F.lit(window), lambda total, x: total + x)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), again(h)).otherwise(0)

    return F.when(F.size(found) <= window, 0).otherwise(let(hashed(F.transform(found, lambda w: F.xxhash64(w))), of))


def lines(text: Column) -> Column:
    """The lines that have a word, as they stand."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def normal_lines(text: Column) -> Column:
    """Array of (hash, n_chars), one for each line that has a word, of its normal form."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    kept = F.filter(F.transform(F.split(plain, "\n"), lambda line: F.btrim(line, F.lit(" "))), lambda line: line != "")
    return F.transform(kept, lambda line: F.struct(F.xxhash64(line).alias("line"), F.length(line).alias("n_chars")))


def facts(text: Column) -> dict[str, Column]:
    """What a text says of itself: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    counted = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    doubled = let(lines(text), lambda found: F.size(found) - F.size(F.array_distinct(found)))
    return {"own": let(words(text), counted), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)), "n_dup_lines": doubled}


def frequent_lines(texts: DataFrame) -> DataFrame:
    """Rows (host, line) of the lines above both limits, of rows (host, lines), one a distinct text."""
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    each = texts.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
    found = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_TEXTS)
    return found.join(hosts, "host").where(F.col("n") * 100 > F.col("n_texts") * MOST_SHARE).select("host", "line")


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Rows (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_chars,
    n_left, kept), one for each row of `docs`; n_chars and n_left are the characters of the lines'
    normal forms, all of them and those of lines that aren't frequent.

    A null text counts as empty: it has no words and fails. Null hosts are one host. Rows of equal
    text and host get the same verdict, whatever their keys, which may be null or repeat; a text of
    any length is judged whole. An empty table gives no rows; other columns are not read.
    """
    steps = Steps(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), docs[host].cast("string")), F.lit("")).alias("host"))
    # Texts are read once; what follows works on hashes of their lines.
    whole = F.col("text")
    made = rows.select("key", "host", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"), normal_lines(whole).alias("lines"), *(c.alias(k) for k, c in facts(whole).items()))
    found = steps.saved(made, "facts")
    same = ["host", "h1", "h2"]
    texts = steps.saved(found.groupBy(*same).agg(F.any_value(F.struct("lines", "own", "n_symbols", "n_dup_lines")).alias("fact"), F.count("*").alias("copies")).select(*same, "copies", "fact.*"), "texts")
    hot = steps.saved(frequent_lines(texts), "frequent")
    each = texts.select(*same, F.explode("lines").alias("at")).select(*same, "at.line", "at.n_chars")
    met = each.join(F.broadcast(hot) if hot.count() <= BROADCAST_LINES else hot, ["host", "line"], "left_semi")
    gone = met.groupBy(*same).agg(F.sum("n_chars").alias("gone"))
    chars = F.aggregate("lines.n_chars", F.lit(0).cast("long"), lambda total, n: total + n)
    told = texts.join(gone, same, "left").select(*same, "copies", *(F.col(f"own.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")), *(F.col(c).cast("long").alias(c) for c in ("n_symbols", "n_dup_lines")), chars.alias("n_chars"), F.coalesce("gone", F.lit(0)).alias("gone"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    left = F.col("n_chars") - F.col("gone")
    told = steps.saved(told.withColumn("base_failed", failed).withColumn("n_left", left).withColumn("kept", ~failed & (left * 100 >= F.col("n_chars") * LEAST_LEFT)), "told")
    out = by_class(found.select("key", *same), told, same, found.count())
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars", "n_left", "kept")
