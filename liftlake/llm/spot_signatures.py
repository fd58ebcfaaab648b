"""Document fingerprints by spot signatures, with DataFrame functions only.

A signature is a common word and the chain of the next ``CHAIN`` content words behind
it, whatever common words stand between; the start of a text is an anchor as well. The
fingerprint of a text is the sorted set of its signatures' hashes. Fingerprints are
compared by Jaccard similarity, which the sizes alone bound: sets whose lengths are too
far apart are never intersected, and for joins lie in partitions that do not meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.session import materialize

CHAIN = 2
CELL_ROWS = 2048
# Anchors, the most common words of four languages.
ANCHORS = (
    "the of and to in a is that it for was on as with be by this are or from at not "
    "der die das und ein eine zu den von mit ist des im für auf nicht als dem "
    "le la les de et un une du en que qui est dans pour par pas "
    "el los las y se con una es su para al lo como del por"
).split()
#: Set before each anchor of a text; the words hold letters and digits only.
_MARK = "\x01"
_BY_LETTER = {word[0]: sorted(w[1:] for w in set(ANCHORS) if w[0] == word[0]) for word in sorted(set(ANCHORS))}
_ANCHOR = "(?:" + "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in _BY_LETTER.items()) + ")"
_SPOT = _MARK + rf"(?=([^ ]+(?:(?: {_MARK}[^ ]+)*+ [^ {_MARK}][^ ]*){{{CHAIN}}} ))"


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the sorted distinct signature hashes of column ``text``; a text without any has the hash of its words as its only one.

    One projection a step, so that each regular expression runs once a row (inside one expression
    the array functions would have their arguments evaluated again for each mention).
    """
    words = F.concat(F.lit(f" {_MARK}^ "), F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    rows = rows.withColumn("__words", F.regexp_replace(F.replace(words, F.lit("  "), F.lit(" ")), f" (?={_ANCHOR} )", f" {_MARK}"))
    rows = rows.withColumn("__spots", F.array_join(F.regexp_extract_all("__words", F.lit(_SPOT), F.lit(1)), "\n"))
    chains = F.when(F.col("__spots") == "", F.col("__words")).otherwise(F.regexp_replace("__spots", f" {_MARK}[^ ]+", ""))
    hashes = F.transform(F.split(chains, "\n"), lambda s: F.hash(s))
    return rows.withColumn(name, F.sort_array(F.array_distinct(hashes))).drop("__words", "__spots")


def pruned_jaccard(one: Column, other: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look at the elements where the sizes cannot reach ``least``."""
    low, high = F.least(F.size(one), F.size(other)), F.greatest(F.size(one), F.size(other))
    both = F.size(F.array_intersect(one, other))
    return F.when(high == 0, 1.0).when(low < high * F.lit(least), 0.0).otherwise(both / (F.size(one) + F.size(other) - both))


def near_pairs(docs: DataFrame, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Near copies by fingerprint: (doc_id, class_id) of every row, and (a, b, likeness) between classes.

    Equal fingerprints are one class (its smallest doc_id). Lengths are cut so that a set
    can only meet its own part and the next; in a part, sets meet by their first
    signatures, of which similar sets share one.
    """
    marked = materialize(with_signatures(docs.select("doc_id", "text"), "text", "s").drop("text"))
    classes = materialize(marked.groupBy("s").agg(F.min("doc_id").alias("class_id")).withColumn("n", F.size("s")))
    part = F.floor(F.log("n") / math.log(1 / least)).cast("int")
    lead = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    index = classes.select("class_id", "n", part.alias("part"), F.explode(lead).alias("spot"))
    probe = index.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = probe.alias("a"), index.alias("b")
    meet = (F.col("a.part") == F.col("b.part")) & (F.col("a.spot") == F.col("b.spot")) & (F.col("a.class_id") != F.col("b.class_id"))
    pairs = a.join(b, meet & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least))
    pairs = pairs.select(F.least("a.class_id", "b.class_id").alias("a"), F.greatest("a.class_id", "b.class_id").alias("b")).distinct()
    sets = classes.select("class_id", "s")
    pairs = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("likeness", pruned_jaccard(F.col("sa"), F.col("sb"), least))
    return marked.join(classes, "s").select("doc_id", "class_id"), pairs.where(F.col("likeness") >= least).select("a", "b", "likeness")


def _with_next(docs: DataFrame) -> DataFrame:
    """Each row with its signatures and the next document's text and signatures by descending doc_id (``next``); the last one's next is the first.

    Rows go to cells of the id range; the first row of each cell also goes, as a ghost, behind
    the last of the cell before, so one shuffle serves and no task sorts all rows.
    """
    ids = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, width = ids.lo or 0, max(1, -(-((ids.hi or 0) - (ids.lo or 0) + 1) * CELL_ROWS // max(ids.n, 1)))
    # in decimals: the range of ids may be wider than a long
    cell = F.coalesce(F.expr(f"(cast(doc_id as decimal(20, 0)) - cast('{lo}' as decimal(20, 0))) div cast('{width}' as decimal(24, 0))"), F.lit(-1).cast("long"))
    tops = docs.groupBy(cell.alias("cell")).agg(F.max("doc_id").alias("top"))
    down = Window.orderBy(F.desc("cell"))
    ahead = F.coalesce(F.lead(F.struct("cell", "top")).over(down), F.first(F.struct("cell", "top")).over(down))
    ghosts = materialize(tops.select(F.col("cell").alias("for_cell"), ahead.alias("g")).select("for_cell", "g.top"))
    rows = docs.withColumn("cell", cell).withColumn("ghost", F.lit(False))
    extra = docs.join(ghosts, docs.doc_id.eqNullSafe(ghosts.top)).drop("top").withColumnRenamed("for_cell", "cell").withColumn("ghost", F.lit(True))
    order = Window.partitionBy("cell").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = with_signatures(rows.unionByName(extra), "text", "sigs").withColumn("next", F.lead(F.struct("text", "sigs")).over(order))
    return rows.where(~F.col("ghost")).drop("cell", "ghost")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``.

    Null text: as the empty one, whose only signature is that of no words. Rows with one
    doc_id follow each other by text; null ids come last. One document is its own next.
    """
    rows = _with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    written = lambda s: F.array_join(F.col(s).cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("sigs").alias("fingerprint"),
        written("edited_sigs").alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        pruned_jaccard(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )
