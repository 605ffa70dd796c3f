"""Mixing sources to target weights, by pivotal dependent rounding of copy probabilities.

Every document starts with the copies that its source should have of it on average: whole
copies and a fraction. Two documents of one source that both have a fraction are paired, and
mass is moved at random between them, weighed by their sizes so that the source's words stay
the same on average and in each step, until one has no fraction left. Blocks of documents are
rounded apart; the one document of a source that keeps a fraction in each block goes on to
the next level of a reduction tree, until one is left of each source. That one keeps a part of
a last copy, so that a source's words meet its target.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps

#: Weights of the sources in code point order, repeated; words of the mix by words of all.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a block, and blocks that meet at each level of the tree.
BLOCK, FAN_IN = 4000, 64
#: Copies of one row that are listed together.
CHUNK = 4096


def size_of(text: Column) -> Column:
    """Number of words: runs of characters other than blanks; 0 for null."""
    blank = r"[\x20\x09-\x0D]+"
    return F.coalesce(F.size(F.array_remove(F.split(text, blank), "")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all, by weight; what a source can't give, beyond
    `most` times its size, is shared by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    limit = {name: most * size for name, size in order}
    out, open_, left = {}, list(weight), share * sum(size for _, size in order)
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * each >= limit[s]]
        if not full:
            return out | {s: weight[s] * each for s in open_}
        out |= {s: limit[s] for s in full}
        left -= sum(limit[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _pivot(part: pd.DataFrame, level: int) -> pd.DataFrame:
    """Rounds the fractions of one block, source by source, in the order of `luck`."""
    part = part.sort_values(["luck", "key"], kind="stable")
    fraction, size, luck = part["fraction"].to_numpy(float).copy(), part["size"].to_numpy(float), part["luck"].to_numpy(np.uint64)
    whole = part["whole"].to_numpy(np.int64).copy()
    draws = np.random.default_rng([7, level]).integers(0, 2**63, 1, dtype=np.uint64)[0]
    chance = (((luck ^ draws) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53
    open_: dict = {}  # of each source the one document that has a fraction
    for i, source in enumerate(part["source"].where(part["source"].notna(), None).tolist()):
        p = fraction[i]
        if p <= 0:
            continue
        j = open_.get(source)
        if j is None:
            open_[source] = i
            continue
        # Moving words t from j to i: up to what empties j or fills i, or the other way.
        give = min(fraction[j] * size[j], (1 - p) * size[i])
        take = min((1 - fraction[j]) * size[j], p * size[i])
        t = give if chance[i] * (give + take) < take else -take
        fraction[i], fraction[j] = p + t / size[i], fraction[j] - t / size[j]
        left = []
        for k in (i, j):
            if fraction[k] > 1 - 1e-12:
                whole[k] += 1
                fraction[k] = 0
            elif fraction[k] < 1e-12:
                fraction[k] = 0
            else:
                left.append(k)
        if left:
            open_[source] = left[0]
        else:
            del open_[source]
    return part.assign(fraction=fraction, whole=whole)


def _pivot_at(level: int):
    return lambda part: _pivot(part, level)


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", by: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (key, size, source_size, target, copies, part, taken), one for each row of `docs`.

    `copies` whole copies and the first `part` words of another are taken; only one document
    of a source has a part. Rows are ordered by a hash of `by` (the key if none are named), source
    and size, so results agree between runs and partitionings. Rows of equal key, source and size
    are interchangeable: they are counted before they are dealt, share their fractions among
    themselves, and one of them goes on with what is left. Documents without words (null and
    empty texts) take none. Null is a source of its own. Sources are listed on the driver, a row
    for each. An empty table gives no rows.
    """
    steps = Steps(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[source].alias("source"), size_of(docs[text].cast("string")).alias("size"), F.xxhash64(F.lit(2), *(docs[c] for c in by or (key,))).alias("seed"))
    groups = steps.saved(rows.groupBy("key", "source", "size", "seed").agg(F.count("*").alias("times")), "sizes")
    sizes = [(r["source"], r["size"]) for r in groups.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size")).collect()]
    total, copied = groups.agg(F.count("*"), F.max("times")).first()
    wanted = targets(sizes, weights, share, most)
    by_source = docs.sparkSession.createDataFrame([(name, size, float(wanted[name])) for name, size in sizes], T.StructType([groups.schema["source"], *T.StructType.fromDDL("source_size long, target double").fields]))
    join = F.col("a.source").eqNullSafe(F.col("b.source"))
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    found = groups.alias("a").join(by_source.alias("b"), join).select("key", "a.source", "size", "times", "source_size", "target", rate.alias("rate"), F.xxhash64("seed", "a.source", "size").alias("luck"))
    blocks = max(1, -(-total // BLOCK))
    # Of `times` equal documents `more` get a further copy, one keeps a fraction, the rest none.
    owed = (F.col("rate") - F.floor("rate")) * F.col("times")
    level = found.withColumn("owed", owed).select("key", "source", "size", "times", "source_size", "target", F.floor("rate").cast("long").alias("base"), F.floor(F.col("owed") + 1e-9).cast("long").alias("more"), F.lit(0).cast("long").alias("whole"), F.greatest(F.col("owed") - F.floor(F.col("owed") + 1e-9), F.lit(0.0)).alias("fraction"), "luck", F.pmod(F.xxhash64("luck", F.lit("block")), F.lit(blocks)).cast("long").alias("block"))
    schema = T.StructType(level.schema.fields)
    done, depth = [], 0
    while True:
        grouped = level.groupBy("block") if depth == 0 else level.groupBy("block", "source")
        out = steps.saved(grouped.applyInPandas(_pivot_at(depth), schema), "mixed")
        if depth == 0:
            steps.drop(groups)
        if blocks <= 1:
            done.append(out)
            break
        done.append(out.where("fraction = 0"))
        blocks = -(-blocks // FAN_IN)
        level = out.where("fraction > 0").withColumn("block", F.floor(F.col("block") / FAN_IN))
        depth += 1
    mixed = reduce(DataFrame.unionByName, done)
    chunks = mixed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))))
    if (copied or 0) > CHUNK:
        chunks = chunks.repartition("key", "chunk")
    first, i = F.col("chunk") * CHUNK, F.col("nth")
    each = chunks.withColumn("nth", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("times")) - 1)))
    copies = F.col("base") + F.when(i < F.col("more"), 1).when(i == F.col("more"), F.col("whole")).otherwise(0)
    part = F.when(i == F.col("more"), F.round(F.col("fraction") * F.col("size"))).otherwise(0).cast("long")
    out = each.select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), part.alias("part"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
