"""Document fingerprints from closed syncmers, with DataFrame functions alone.

Symbols are words: runs of up to 32 characters between blanks. Of a longer run (a script without
blanks, an address, encoded bytes) every character is a symbol, so that none is counted from where
the run begins. Of every k = 4 symbols in a row the inner pairs (s = 2) are hashed; where the least
of the three hashes stands at either edge, the four symbols are an anchor. Whether they are depends
on them alone, so texts that share a passage share its anchors, wherever it stands; an edit touches
the anchors of its own symbols, and of a run only that is just short enough to be a word.

A fingerprint names all anchors of a text, each as often as it occurs, and so does the likeness of
two texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A symbol: a whole word, or a character of a longer run.
SYMBOL = r"((?<!\S)\S{1,32}+(?!\S)|\S)"
#: Hashes of a sketch, of 32 bits each, unless the caller wants another number.
SKETCH = 96
#: Documents that are ordered together, on average, and ranges of them at most.
TOGETHER, MOST_RANGES = 1024, 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edges(text: Column, use: Callable[[Column, Column], Column], kind: str) -> Column:
    """use(number of the first symbol, hash) of all anchors of a text, in order."""
    edge = F.array(*[F.lit(0).cast("long")] * 3)

    def pairs(h: Column) -> Column:
        n = F.size(h) - 1
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))

    def chosen(g: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(g) - 3), lambda i: F.least(F.get(g, i), F.get(g, i + 2)) <= F.get(g, i + 1))
        return F.transform(at, lambda i: use(i - 3, F.xxhash64(F.get(g, i), F.get(g, i + 2))))

    def of(symbols: Column) -> Column:
        padded = F.concat(edge, F.transform(symbols, lambda s: F.xxhash64(s)), edge)
        return F.when(F.size(symbols) > 0, let(padded, lambda h: let(pairs(h), chosen))).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1)), of)


def anchors(text: Column) -> Column:
    """All anchors of a text, in order: array of (at: number of the first symbol, hash), by which
    passages of two texts can be matched in place.

    Three empty symbols stand before and after the text's own, so that short texts have
    anchors too; null and empty texts have none.
    """
    return _edges(text, lambda at, h: F.struct(at.alias("at"), h.alias("hash")), "array<struct<at:int,hash:bigint>>")


def hashes(text: Column) -> Column:
    """64-bit hashes of all anchors of the text, in order."""
    return _edges(text, lambda at, h: h, "array<bigint>")


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The `size` least distinct ones of the upper halves of the anchors' hashes, ascending: of a
    bounded length, for an index of texts. `fingerprint` and `likeness` don't use it."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda x: F.shiftrightunsigned(x, 32)))), 1, size)


def numbered(found: Column) -> Column:
    """The hashes made distinct: each one's first occurrence stands for itself, a further one is
    hashed with its number, so that an intersection counts each hash as often as both have it."""
    none = F.array().cast("array<bigint>")

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.when(F.size(at) == F.size(s), s).otherwise(F.concat(F.array_distinct(s), again(s, at))))

    def again(s: Column, at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
        more = lambda a, b: F.when(b - a > 1, F.transform(F.sequence(F.lit(1), b - a - 1), lambda nth: F.xxhash64(F.get(s, a), nth))).otherwise(none)
        return F.flatten(F.zip_with(at, ends, more))

    return F.when(F.size(found) > 0, let(F.sort_array(found), of)).otherwise(none)


def fingerprint(all_anchors: Column) -> Column:
    """128 bits in hexadecimal over all anchors as `numbered` gives them; '' if there are none."""
    half = lambda k: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), all_anchors))), 16, "0")
    return F.when(F.size(all_anchors) == 0, "").otherwise(F.concat(half(1), half(2)))


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors in common, 2 |A and B| / (|A| + |B|), counted over all anchors of two
    texts as `numbered` gives them; 1 for two texts without anchors, 0 if one alone has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def _ranges(rows: DataFrame, keys: list[str]) -> tuple[int, list[tuple]]:
    """Number of rows, and the rows that begin ranges of about TOGETHER rows in the order of
    `keys`: the least of all, and quantiles of a sample by hash, MOST_RANGES at most."""
    whole = rows.agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("least")).first()
    wanted = min(MOST_RANGES, max(1, whole["n"] // TOGETHER))
    if wanted == 1:
        return whole["n"], [tuple(whole["least"])] if whole["n"] else []
    drawn = max(1, whole["n"] // (8 * wanted))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("range"), *keys), F.lit(drawn)) == 0).select(*keys).distinct()
    found = sorted({tuple(whole["least"]), *(tuple(r) for r in sample.limit(16 * MOST_RANGES).collect())})
    step = max(1, len(found) // wanted)
    return whole["n"], found[::step]


def _range_of(starts: list[tuple], keys: list[str]) -> Column:
    """Number of the last range that begins at or before the row, by binary search."""
    lists = [F.from_json(F.lit(json.dumps(list(c))), "array<bigint>") for c in zip(*starts, strict=True)]
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, (len(starts) - 1).bit_length())))))

    def reached(i: Column) -> Column:
        out = F.lit(True)
        for name, values in reversed(list(zip(keys, lists, strict=True))):
            out = (F.get(values, i) < F.col(name)) | ((F.get(values, i) == F.col(name)) & out)
        return out

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(starts)) & reached(at + step), at + step).otherwise(at))


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, next_text) of every row of `docs` and the one that follows in ascending
    key order; the first follows the last.

    Keys are integers, of the whole range. Null keys come first, equal keys are ordered by their
    texts' hash. Null texts count as empty. Rows are dealt to ranges that begin at known rows;
    such a row goes to the range before too, as its end. So texts are shuffled once, no task sees
    the whole order. A frequent key is spread by its texts; frequent copies under one key are
    counted and made anew.
    """
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    keys = ["there", "at", "tie"]
    rows = rows.select("key", "text", F.col("key").isNotNull().cast("long").alias("there"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("at"), F.xxhash64("text").alias("tie"))
    # Copies under one key that fill ranges: all but the last are followed by their own text. They
    # are told by their count, a thousand groups at most, and one row of each is ordered.
    counts = rows.groupBy(*keys).agg(F.count("*").alias("times"))
    many = counts.where((F.col("times") > TOGETHER) & (F.col("times") * 1000 >= rows.count()))
    found = [tuple(r) for r in many.collect()]
    if found:
        hot = F.broadcast(rows.sparkSession.createDataFrame(found, many.schema))
        one = rows.join(hot, keys).groupBy("key", *keys, "times").agg(F.any_value("text").alias("text"))
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 2) / TOGETHER)))
        dealt = one.select("key", "text", "times", chunk.alias("chunk")).repartition("key", "chunk")
        first = F.col("chunk") * TOGETHER
        again = dealt.select("key", "text", F.explode(F.sequence(first, F.least(first + TOGETHER, F.col("times") - 1) - 1)))
        again = again.select(F.col("key").alias(key), "text", F.col("text").alias("next_text"))
        rows = rows.join(hot, keys, "left_anti").unionByName(one.select(*rows.columns))
    n, starts = _ranges(rows, keys)
    if not n:
        return rows.select(F.col("key").alias(key), "text", F.col("text").alias("next_text"))
    placed = rows.withColumn("range", _range_of(starts, keys))
    lists = [F.from_json(F.lit(json.dumps(list(c))), "array<bigint>") for c in zip(*starts, strict=True)]
    begins = reduce(lambda a, b: a & b, [F.get(values, F.col("range")) == F.col(name) for name, values in zip(keys, lists, strict=True)])
    place = lambda at, end: F.struct(at.cast("int").alias("range"), F.lit(end).alias("end"))
    before = F.pmod(F.col("range") + (len(starts) - 1), F.lit(len(starts)))
    places = F.when(begins, F.array(place(F.col("range"), 0), place(before, 1))).otherwise(F.array(place(F.col("range"), 0)))
    dealt = placed.withColumn("place", F.explode(places)).select("key", "text", "there", "at", "tie", "place.range", "place.end").repartition("range")
    line = Window.partitionBy("range").orderBy("end", *keys)
    led = dealt.select("key", "end", "text", F.lead("text").over(line).alias("next_text"))
    out = led.where("end = 0").select(F.col("key").alias(key), "text", "next_text")
    return out.unionByName(again) if found else out


def edited(text: Column, n: Column, following: Column) -> Column:
    """The text with its last floor(n / 4) characters replaced by the first of `following`."""
    cut = (n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compare_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one
    for each row of `docs`: likeness of each whole text to its edited form and to the next text,
    from all their anchors, which the fingerprints name.

    Equal texts have equal fingerprints; null and empty texts have an empty one, which is like
    other empty ones only. In a table of one row the row follows itself; an empty table gives none.
    Other columns are not read, whatever their names.
    """
    # Anchors are found after the rows are ordered: they are larger than the texts.
    led = with_next(docs, key=key, text=text).withColumn("n", F.length("text"))
    out = led.withColumn("edited", edited(F.col("text"), F.col("n"), F.col("next_text")))
    out = out.select(key, "n", "edited", *(hashes(F.col(c)).alias(f"of_{c}") for c in ("text", "edited", "next_text")))
    out = out.select(key, "n", "edited", *(numbered(F.col(f"of_{c}")).alias(f"all_{c}") for c in ("text", "edited", "next_text")))
    return out.select(
        key,
        F.col("n").cast("long").alias("n_chars"),
        "edited",
        fingerprint(F.col("all_text")).alias("fingerprint"),
        fingerprint(F.col("all_edited")).alias("edited_fingerprint"),
        likeness(F.col("all_text"), F.col("all_edited")).alias("near_edited"),
        likeness(F.col("all_text"), F.col("all_next_text")).alias("near_next"),
    )
