"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; each of its documents has the same wanted number of
copies (target over source size).  The whole part is taken as it is.  The fractional parts are
settled by pairing: two documents exchange words, in a random direction whose odds keep each
one's expected copies, until one of them holds none or a whole copy.  The words of the pair do not
change, so a source's sum is kept until its very last open document, which is rounded to the
nearer side: a source misses its target by half of one document at most.  Blocks of a bounded number
of documents settle by themselves; each leaves at most one open document, and those meet in the
next level of a reduction tree until one per source is left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import WORD, cut_lineage, in_bitmap, key_bitmap, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_ROWS = 4096
SEED = 20240
_SALTS = 16
_OPEN = "row_id long, id long, spread long, size long, copies long, open double, source_no long, block long"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_no, source_size, n_rows, target per source of ``sized`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; no target exceeds ``most`` times its source's size, and what is cut off is shared anew by
    weight.  That ends at one level per unit of weight, found by walking the sources in the order
    of size over weight.  One row per source goes through the ordering, no documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("ratio").desc(), F.col("source_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    per = (per.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(whole))
           .withColumn("below", F.coalesce(F.sum("cap").over(rising), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(onward))
           .withColumn("level", (F.col("total") * share - F.col("below")) / F.col("rest_w")))
    per = per.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole))
    per = per.withColumn("final", F.max(F.when(F.col("ratio") == F.col("found"), F.col("level"))).over(whole))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap")))
    return per.select("source", "source_no", "source_size", "n_rows", target.alias("target"))


def settle(sizes: np.ndarray, open_: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pair the fractional copies ``open_`` in order; returns the settled ones and the row left open (-1: none)."""
    p, s, draws, i = open_.tolist(), sizes.tolist(), rng.random(len(open_)).tolist(), -1
    for j in range(len(p)):
        if i < 0:
            i = j
            continue
        a, b = p[i] * s[i], p[j] * s[j]
        up, down = min(s[i] - a, b), min(a, s[j] - b)
        gain = up if draws[j] * (up + down) < down else -down
        a, b = a + gain, b - gain
        tiny_i, tiny_j = 1e-9 * s[i], 1e-9 * s[j]
        p[i] = 0.0 if a <= tiny_i else 1.0 if a >= s[i] - tiny_i else a / s[i]
        p[j] = 0.0 if b <= tiny_j else 1.0 if b >= s[j] - tiny_j else b / s[j]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return np.array(p), i if i >= 0 and 0 < p[i] < 1 else -1


def _settle_block(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "spread"], ascending=[False, True], ignore_index=True)
        no, block = int(rows["source_no"].iloc[0]), int(rows["block"].iloc[0])
        rng = np.random.default_rng(zlib.crc32((f"{seed}/{no}/{block}/{last}" + f"/{level}" * (level > 0)).encode()))
        p, left = settle(rows["size"].to_numpy(float), rows["open"].to_numpy(float), rng)
        if last and left >= 0:
            p[left], left = float(p[left] >= 0.5), -1
        settled = np.arange(len(p)) != left
        rows["copies"] += np.where(settled, np.rint(p), 0).astype("int64")
        rows["open"] = np.where(settled, 0.0, p)
        return rows
    return run


def _same(id_col: str, source_col: str, text_col: str) -> Column:
    """A hash that rows share whose id, source and text are equal."""
    return F.xxhash64(*[x for c in (id_col, source_col, text_col) for x in (F.col(c), F.col(c).isNull())])


def _spread() -> Column:
    """A hash of the row's ``same`` and of its ``number`` among rows with the same."""
    return F.xxhash64("same", "number")


def _numbered_among_equals(sized: DataFrame) -> DataFrame:
    """``sized`` with ``number``: the row's number among rows with its ``same``, from 0.

    Equal rows are numbered within the parts that ``row_id`` names and offset by the counts of earlier
    parts, so no task gathers them all.  They are alike, so it does not matter which has which number.
    """
    columns = sized.columns
    sized = sized.withColumn("part", F.shiftright("row_id", 33))
    inside = F.row_number().over(Window.partitionBy("same", "part").orderBy("row_id"))
    per = sized.groupBy("same", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select(F.col("same").alias("p_same"), F.col("part").alias("p_part"), "before")
    numbered = sized.withColumn("inside", inside).join(per, (F.col("same") == F.col("p_same")) & (F.col("part") == F.col("p_part")), "left")
    number = F.coalesce("before", F.lit(0)).cast("long") + F.col("inside") - 1
    return numbered.select(*columns, number.alias("number"))


def copies_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, **kw) -> DataFrame:
    """row_id, the id, size, source_size, target, copies for every row of ``docs`` (``row_col``: its own row numbers, if it has any).

    A null text has size 0, a null source is a source of its own (the last), documents without
    words take no copies, repeated rows are documents of their own, an empty table gives no rows.
    Draws depend on the seed, source and block only, and a document's block on its id, source and
    text, so reruns agree however the rows are split; of equal rows any may be the one taken.  ``row_id``
    numbers the rows of ``docs`` as they are read; columns besides the three named are ignored.
    Keywords: ``weights``, ``share``, ``most``, ``block_rows``, ``seed``.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = _sized(docs, number, id_col, text_col, source_col)
    return _settled(sized, **kw).select("row_id", F.col("id").alias(id_col), "size", "source_size", "target", "copies")


def _sized(docs: DataFrame, number: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row_id, id, source, size, same and number of every row, written."""
    sized = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                        word_count(text_of(text_col)).alias("size"), _same(id_col, source_col, text_col).alias("same"))
    return cut_lineage(_numbered_among_equals(cut_lineage(sized, "mix-sizes")), "mix-numbered")


def _settled(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """row_id, id, spread, size, source_size, target and copies of the rows of :func:`_sized`."""
    sized = sized.withColumn("spread", _spread()).drop("same", "number")
    targets = cut_lineage(source_targets(sized, weights, share, most), "mix-targets")
    most_rows = targets.agg(F.max("n_rows")).first()[0] or 0
    salted = targets.withColumnRenamed("source", "t_source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = (sized.withColumn("t_salt", F.pmod("spread", F.lit(_SALTS)))
            .join(salted, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("t_salt") == F.col("salt"))))
    wanted = F.when(F.col("size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    rows = rows.withColumn("wanted", wanted).withColumn("copies", F.floor("wanted").cast("long"))
    blocks = F.ceil(F.col("n_rows") / block_rows)
    rows = rows.select("row_id", "id", "spread", "size", "copies", (F.col("wanted") - F.col("copies")).alias("open"), "source_no",
                       F.pmod(F.shiftright("spread", 8), blocks).cast("long").alias("block"), "source_size", "target")
    rows = cut_lineage(rows, "mix-rows")
    settled = rows.filter("open = 0").select("row_id", "id", "spread", "size", "copies", "source_no")
    pending, n_blocks = rows.filter("open > 0").drop("source_size", "target"), math.ceil(most_rows / block_rows)
    level = 0
    while n_blocks:
        done = pending.groupBy("source_no", "block").applyInPandas(_settle_block(seed, level, n_blocks == 1), _OPEN)
        level += 1
        done = cut_lineage(done, "mix-level")
        settled = settled.unionByName(done.filter("open = 0").select("row_id", "id", "spread", "size", "copies", "source_no"))
        pending = done.filter("open > 0").withColumn("block", F.floor(F.col("block") / block_rows).cast("long"))
        n_blocks = 0 if n_blocks == 1 else math.ceil(n_blocks / block_rows)
    salted = salted.select("source_size", "target", "salt", F.col("source_no").alias("t_no"))
    settled = settled.withColumn("t_salt", F.pmod(F.xxhash64("id", "row_id"), F.lit(_SALTS)))
    out = settled.join(salted, (F.col("source_no") == F.col("t_no")) & (F.col("t_salt") == F.col("salt")))
    return out.select("row_id", "id", "spread", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, written: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``docs`` with each row as often as :func:`copies_of` takes it; the columns stay as they are.

    ``docs`` is read several times, and every reading must give the same rows: unless it is
    ``written`` (read from files), it is written first.  Rows go through one shuffle, to their copies,
    by id and ``spread``; rows that repeat an id, source and text are numbered anew for that, and
    only those and the few that a bitmap of fixed size cannot tell from them are written.
    """
    row = F.col("row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # apart from the columns added here
    rows = rows if written else cut_lineage(rows, "mix-docs")
    named = rows.select("row", *[row.getField(c).alias(to) for c, to in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    sized = _sized(named, F.monotonically_increasing_id(), "doc_id", "text", "source")
    taken = _settled(sized, **kw).filter("copies > 0").select(F.col("id").alias("t_id"), F.col("spread").alias("t_spread"), "copies")
    taken = cut_lineage(taken, "mix-taken")
    own = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("spread") == F.col("t_spread"))
    rows = named.select("row", F.col("doc_id").cast("long").alias("id"), _same("doc_id", "source", "text").alias("same"), F.lit(0).cast("long").alias("number"))
    repeats, again = sized.filter("number = 1").select("same"), None
    if not repeats.isEmpty():
        marked = in_bitmap(rows, key_bitmap(repeats, F.col("same")), F.col("same"), "maybe")
        again = cut_lineage(marked.filter("maybe").select("row", "id", "same", F.monotonically_increasing_id().alias("row_id")), "mix-repeats")
        rows = marked.filter("NOT maybe")
    joined = rows.select("row", "id", _spread().alias("spread")).join(taken, own).select("row", "copies")
    if again:
        keys = _numbered_among_equals(again.select("row_id", "id", "same")).select("row_id", "id", _spread().alias("spread"))
        joined = joined.union(again.join(keys.join(taken, own).select("row_id", "copies"), "row_id").select("row", "copies"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return joined.select("row", times.alias("time")).select(*[row.getField(c).alias(c) for c in docs.columns])
