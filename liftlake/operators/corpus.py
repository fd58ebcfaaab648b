"""Methodology text: chunks, terms, TF-IDF and BM25 ranking, evidence selection.

The same scoring that serves one request runs here for many queries over a
document table. A term may occur in a large share of all chunks, so its posting
rows are spread over several join keys in proportion to its document frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from liftlake.functions import fixed
from liftlake.session import FEW_ROWS, materialize

SPLIT_ROWS = 1_000_000  # postings of one term per join key
PART_CHARS = 8_000_000  # text of one task that counts terms: some million tokens
MEMO_TOKENS = 500_000  # tokens whose terms a task remembers
_STOPS = frozenset(fixed.STOP_WORDS)
BROADCAST_TERMS = 200_000  # so many terms, the most frequent, travel to the postings; the others meet theirs by a shuffle

LOT_QUERIES = 1_000  # queries that share one row of a term


# --- chunks --------------------------------------------------------------------
def line_chunks(docs: DataFrame, doc_id: str, text: str, source: str, keep: list[str] | None = None) -> DataFrame:
    """One chunk per non-blank line, for prose without headings."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *(keep or []), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
        .withColumn("content", F.trim("line"))
        .filter(F.length("content") > 0)
        .withColumn("heading", F.lit(""))
        .withColumn("metadata", F.create_map().cast("map<string,string>"))
        .withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.lpad(F.col("pos").cast("string"), 8, "0")))
        .drop("line")
    )


def section_chunks(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """One chunk per ``## `` section; an optional comment line of ``key: value`` pairs becomes the metadata.

    Text before the first heading and sections without a body are dropped.
    """
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.posexplode(F.split(F.col(text), r"\n(?=## )")).alias("pos", "section"))
    section = F.trim(F.regexp_replace("section", r"^\s+|\s+$", ""))
    first = r"^<!--\s*(.*?)\s*-->\s*$"
    staged = (
        parts.withColumn("section", section)
        .filter(F.col("section").startswith("## "))
        .withColumn("heading", F.trim(F.regexp_extract("section", r"^## ([^\n]*)", 1)))
        .withColumn("body", F.regexp_replace("section", r"^## [^\n]*\n?\s*", ""))
        .withColumn("comment", F.regexp_extract(F.regexp_extract("body", r"^([^\n]*)", 1), first, 1))
        .withColumn("has_comment", F.rlike(F.trim(F.regexp_extract("body", r"^([^\n]*)", 1)), F.lit(first)))
    )
    pairs = F.filter(
        F.transform(
            F.split("comment", ";"),
            lambda p: F.struct(
                F.trim(F.substring_index(p, ":", 1)).alias("key"),
                F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value"),
                F.contains(p, F.lit(":")).alias("ok"),
            ),
        ),
        lambda s: s["ok"] & (F.length(s["key"]) > 0),
    )
    metadata = F.when(
        F.col("has_comment"), F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["key"], s["value"])))
    ).otherwise(F.create_map().cast("map<string,string>"))
    content = F.when(F.col("has_comment"), F.regexp_replace("body", r"^[^\n]*\n?\s*", "")).otherwise(F.col("body"))
    return (
        staged.withColumn("content", content)
        .filter(F.length("content") > 0)
        .withColumn("metadata", metadata)
        .withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.lpad(F.col("pos").cast("string"), 8, "0")))
        .select("doc_id", "source", "pos", "content", "heading", "metadata", "chunk_id")
    )


# --- terms -----------------------------------------------------------------------
def _raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def _stem(t: Column) -> Column:
    """The first listed suffix is cut when at least four characters stay."""
    out = None
    for suffix in fixed.SUFFIXES:
        hit = t.endswith(suffix) & (F.length(t) >= len(suffix) + fixed.MIN_STEM)
        cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


def tokens(text: Column) -> Column:
    """Lower-cased tokens without stop words, then stemmed, as an array."""
    return F.transform(F.filter(_raw_tokens(text), lambda t: ~t.isin(fixed.STOP_WORDS)), _stem)


class _Memo(dict):
    """The term of a token, null for stop words, as ``tokens`` has it."""

    def __missing__(self, token: str) -> str | None:
        if len(self) >= MEMO_TOKENS:
            self.clear()
        term = None if token in _STOPS else token
        for suffix in fixed.SUFFIXES if term else ():
            if token.endswith(suffix) and len(token) >= len(suffix) + fixed.MIN_STEM:
                term = token[: -len(suffix)]
                break
        self[token] = term
        return term


def text_parts(chunks: DataFrame) -> int:
    """How many tasks count the terms of some chunks: tokens take many times the bytes of their text."""
    chars = chunks.agg(F.sum(F.length("heading") + F.length("content"))).first()[0] or 0
    return max(1, -(-chars // PART_CHARS))


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", parts: int | None = None) -> DataFrame:
    """(chunk, term, tf, chunk_len): one shuffle of the chunks; counting and lengths are then local to a task.

    A chunk's rows are neighbours, so they are added up one chunk at a time. ``parts``: tasks, else by the text's size.
    """
    text = F.lower(F.concat_ws(" ", "heading", "content"))
    placed = chunks.select(chunk_id, text.alias("text")).repartition(parts or text_parts(chunks), chunk_id).sortWithinPartitions(chunk_id)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, term = re.compile(fixed.TOKEN_PATTERN).findall, _Memo()
        kind = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            for _, counts in done:
                counts.pop(None, None)
            sizes = [len(counts) for _, counts in done]
            at = np.repeat(np.arange(len(done)), sizes)
            lengths = np.array([sum(counts.values()) for _, counts in done], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in done], kind).take(pa.array(at)),
                    pa.array(list(chain.from_iterable(counts for _, counts in done)), pa.string()),
                    pa.array(list(chain.from_iterable(counts.values() for _, counts in done)), pa.int64()),
                    pa.array(lengths[at]),
                ],
                names=[chunk_id, "term", "tf", "chunk_len"],
            )

        last, held = None, None  # the chunk whose rows may go on in the next batch
        for batch in batches:
            kind, done = batch.schema.types[0], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is None or key != last:
                    if held is not None:
                        done.append((last, held))
                    last, held = key, Counter()
                held.update(map(term.__getitem__, find(line)))
            yield rows(done)
        if held is not None:
            yield rows([(last, held)])

    schema = StructType([chunks.schema[chunk_id], StructField("term", StringType()), StructField("tf", LongType()), StructField("chunk_len", LongType())])
    return placed.mapInArrow(counted, schema)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    toks = queries.select(query_id, tokens(F.col(text)).alias("__toks"))
    return (
        toks.select(query_id, F.size("__toks").alias("query_len"), F.explode("__toks").alias("term"))
        .groupBy(query_id, "term")
        .agg(F.count(F.lit(1)).alias("qtf"), F.max("query_len").alias("query_len"))
    )


def corpus_stats(chunks: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: number of chunks and average token count (chunks without tokens count as empty)."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return posts.agg(
        F.max(n.select("n").scalar()).alias("n_chunks"), (F.sum("tf") / F.max(n.select("n").scalar())).alias("avg_len")
    )


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_terms(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Terms with df and smoothed idf."""
    n = stats.select("n_chunks").scalar()
    return document_frequencies(posts).withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1.0)


def bm25_terms(posts: DataFrame, stats: DataFrame) -> DataFrame:
    n = stats.select("n_chunks").scalar()
    return document_frequencies(posts).withColumn("idf", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def _frequent_from(terms: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` terms reach with their document frequency."""
    reached = terms.agg(*[F.count_if(F.col("df") >= 1 << k).alias(str(k)) for k in range(63)]).first()
    return next((1 << k for k, n in enumerate(reached) if n <= most), 1 << 62)


def _weighted(posts: DataFrame, terms: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(chunk, term, w): TF-IDF weights, of frequent terms, whose postings, nearly all, are not shuffled, and of the others."""
    bar = _frequent_from(terms, most)
    frequent = F.broadcast(terms.filter(F.col("df") >= bar).select("term", "idf"))
    w = (F.col("tf") / F.col("chunk_len") * F.col("idf")).alias("w")
    near = posts.join(frequent, "term").select("chunk_id", "term", w)
    if bar <= 1:
        return near, None
    far = posts.join(frequent, "term", "left_anti").join(terms.filter(F.col("df") < bar).select("term", "idf").hint("shuffle_merge"), "term")
    return near, far.select("chunk_id", "term", w)


def _norms(near: DataFrame, far: DataFrame | None) -> DataFrame:
    held = near if far is None else near.unionByName(far)
    return held.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def chunk_norms(posts: DataFrame, terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A chunk's postings are neighbours, so squares are summed to a row a chunk before the shuffle."""
    return _norms(*_weighted(posts, terms, most))


def tfidf_index(posts: DataFrame, terms: DataFrame, most: int = BROADCAST_TERMS, parts: int | None = None) -> DataFrame:
    """(chunk, term, g): TF-IDF weights of unit-length chunks.

    The norms, a row a chunk, go to the postings: these stay where they are if they were written by chunk. ``parts`` places
    the rows of rare terms, which were shuffled by term, in so many parts by chunk again.
    """
    near, far = _weighted(posts, terms, most)
    far = far if far is None else materialize(far)
    norms = materialize(_norms(near, far)).hint("shuffle_hash")
    unit = (F.col("w") / F.col("norm")).alias("g")
    index = near.join(norms, "chunk_id").select("chunk_id", "term", unit)
    if far is None:
        return index
    rare = far.join(norms, "chunk_id").select("chunk_id", "term", unit)
    return index.unionByName(rare.repartition(parts, "chunk_id") if parts else rare)


def bm25_index(posts: DataFrame, stats: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(chunk, term, g): saturated, length-normalized term frequencies."""
    length = (1 - b) + b * F.col("chunk_len") / stats.select("avg_len").scalar()
    return posts.select("chunk_id", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)).alias("g"))


# --- search ----------------------------------------------------------------------
# Both rankings are sums over shared terms of a(query, term) * g(chunk, term), so
# they share one exact plan:
#   1. seeds: the best chunks by each query's few rarest terms, scored in full,
#      give a lower bound of the k-th best score (the bar);
#   2. a query's most frequent terms are set aside while their largest possible
#      joint contribution stays below the bar: a chunk sharing only those cannot
#      be among the results, so their long posting lists generate no pairs;
#   3. the other terms generate candidates, and only candidates whose upper bound
#      reaches the bar look their set-aside terms up, by (chunk, term).
SEED_TERMS = 4


def _matched(query_rows: DataFrame, index: DataFrame, terms: DataFrame, split_rows: int) -> DataFrame:
    """Query terms meet postings; a frequent term's postings are spread over several keys.

    Postings of terms that no query has are left out before any of them moves: the list of
    asked terms, with the number of keys of each, is written and travels to the index. Where
    the spread queries are too many to travel too, a posting comes back to its chunk with
    its queries in one row, and what adds up a chunk's scores leaves the rows in place.
    """
    asked = query_rows.select("term").distinct().join(terms, "term")
    asked = materialize(asked.select("term", F.ceil(F.col("df") / F.lit(split_rows)).cast("int").alias("__parts")))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    lots = -(-query_rows.select("query_id").distinct().count() // LOT_QUERIES) or 1
    placed = index.join(asked, "term").withColumn("__part", F.pmod(F.xxhash64("chunk_id"), F.col("__parts")).cast("int")).drop("__parts")
    spread = query_rows.join(asked, "term").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    # a term's queries share its rows, in lots of bounded size; written, so that their number is known
    spread = spread.groupBy("term", "__part", F.pmod(F.xxhash64("query_id"), F.lit(lots)).alias("__lot")).agg(F.collect_list(F.struct("query_id", "a")).alias("__queries"))
    spread = materialize(spread)
    entries = spread.agg(F.sum(F.size("__queries"))).first()[0] or 0
    if entries <= FEW_ROWS:
        met = placed.join(F.broadcast(spread), ["term", "__part"])
    else:
        met = placed.join(spread.hint("shuffle_merge"), ["term", "__part"]).select("chunk_id", "g", "__queries").repartition("chunk_id")
    return met.select("chunk_id", "g", F.inline("__queries"))


def _top(scores: DataFrame, top_k: int, by: str = "score") -> DataFrame:
    """k best chunks per query; the row-number limit is applied before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def _seed_bounds(q: DataFrame, index: DataFrame, terms: DataFrame, top_k: int, split_rows: int) -> DataFrame:
    """Per query a lower bound of the best and of the k-th best full score."""
    rarest = W.partitionBy("query_id").orderBy("df", "term")
    seeds = q.withColumn("__r", F.row_number().over(rarest)).filter(F.col("__r") <= SEED_TERMS).select("query_id", "term", "a")
    partial = _matched(seeds, index, terms, split_rows).groupBy("query_id", "chunk_id").agg(F.sum(F.col("a") * F.col("g")).alias("p"))
    picked = _top(partial, top_k, "p").select("query_id", "chunk_id")
    full = (
        materialize(picked.join(q.select("query_id", "term", "a"), "query_id"))
        .join(index, ["chunk_id", "term"])
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(F.col("a") * F.col("g")).alias("s"))
    )
    return full.groupBy("query_id").agg(
        F.max("s").alias("best_low"), F.when(F.count(F.lit(1)) >= top_k, F.min("s")).otherwise(0.0).alias("kth_low")
    )


def _search(q: DataFrame, index: DataFrame, terms: DataFrame, bar: Column, tail_bound: Column, top_k: int, split_rows: int) -> DataFrame:
    """Full scores (raw) of every chunk that reaches the bar.

    ``q``: query_id, term, a, df. ``tail_bound`` aggregates, over a window, the
    largest joint contribution of a query's terms.
    """
    # Query-sized tables are written so that their measured size decides whether
    # the index is joined by broadcast, without shuffling it, or by key.
    q = materialize(q)
    bounds = _seed_bounds(q, index, terms, top_k, split_rows)
    floor = bar * (1 - 1e-6)
    downwards = W.partitionBy("query_id").orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    split = materialize(
        q.join(bounds, "query_id", "left")
        .fillna(0.0, ["best_low", "kth_low"])
        .withColumn("bar", floor)
        .withColumn("tail", tail_bound.over(downwards))
        .withColumn("is_common", F.col("tail") < F.col("bar"))
    )
    lead = split.filter(~F.col("is_common")).select("query_id", "term", "a")
    partial = _matched(lead, index, terms, split_rows).groupBy("query_id", "chunk_id").agg(F.sum(F.col("a") * F.col("g")).alias("p"))
    aside = split.groupBy("query_id").agg(
        F.max("bar").alias("bar"),
        F.coalesce(F.max(F.when(F.col("is_common"), F.col("tail"))), F.lit(0.0)).alias("most"),
        F.collect_list(F.when(F.col("is_common"), F.struct("term", "a"))).alias("common"),
    )
    held = partial.join(materialize(aside), "query_id").filter(F.col("p") + F.col("most") >= F.col("bar"))
    # a chunk's set-aside terms meet its candidates in one row: no row a candidate and term, and an index written by chunk stays in place
    common = materialize(split.filter("is_common").select("term").distinct())
    looked = index.join(common, "term").groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "g"))).alias("__g"))
    rest = F.aggregate("common", F.lit(0.0), lambda acc, c: acc + c["a"] * F.coalesce(F.element_at("__g", c["term"]), F.lit(0.0)))
    raw = held.join(looked.hint("shuffle_merge"), "chunk_id", "left").withColumn("raw", F.col("p") + rest)
    return raw.filter(F.col("raw") >= F.col("bar")).select("query_id", "chunk_id", "raw")


def tfidf_search(
    queries: DataFrame,
    index: DataFrame,
    terms: DataFrame,
    top_k: int = 3,
    min_score: float = 0.12,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Cosine ranking. Terms outside the corpus still count in the query's length.

    ``index`` is ``tfidf_index``; pass one filtered to some chunks (a metadata
    category) to restrict candidates before scoring, with the whole corpus' terms.
    """
    q = query_terms(queries).join(terms, "term").withColumn("wq", F.col("qtf") / F.col("query_len") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(W.partitionBy("query_id")))
    q = q.withColumn("a", F.col("wq") / norm).select("query_id", "term", "a", "df")
    # chunks have unit length: by Cauchy-Schwarz terms contribute at most the norm of their a's
    raw = _search(
        q, index, terms, F.greatest(F.lit(min_score), F.col("kth_low")), _RootSum(F.col("a") * F.col("a")), top_k, split_rows
    )
    scored = raw.withColumn("score", F.round("raw", 9)).filter(F.col("score") >= min_score).select("query_id", "chunk_id", "score")
    return _top(scored, top_k)


class _RootSum:
    """sqrt(sum(x)) over a window."""

    def __init__(self, x: Column):
        self.x = x

    def over(self, window) -> Column:
        return F.sqrt(F.sum(self.x).over(window))


def bm25_search(
    queries: DataFrame,
    index: DataFrame,
    terms: DataFrame,
    top_k: int = 3,
    min_score: float = 0.55,
    k1: float = fixed.BM25_K1,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Okapi ranking over ``bm25_index``; repeated query terms count each time; scores relative to the query's best."""
    q = query_terms(queries).join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("a"), "df")
    # a term frequency saturates at k1 + 1
    bar = F.greatest(F.lit(min_score) * F.col("best_low"), F.col("kth_low"))
    raw = _search(q, index, terms, bar, F.sum(F.col("a") * (k1 + 1)), top_k, split_rows)
    best = F.max("raw").over(W.partitionBy("query_id"))
    scored = (
        raw.withColumn("best", best)
        .filter(F.col("best") > 0)
        .withColumn("score", F.round(F.col("raw") / F.col("best"), 9))
        .filter(F.col("score") >= min_score)
        .select("query_id", "chunk_id", "score")
    )
    return _top(scored, top_k)


# --- evidence ----------------------------------------------------------------------
def select_evidence(ranked: DataFrame, tiers: DataFrame, limit: int = 3) -> DataFrame:
    """Best chunk per source, then by (tier, score); ``ranked`` carries source and score."""
    per_source = W.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")
    best = ranked.withColumn("__rn", F.row_number().over(per_source)).filter(F.col("__rn") == 1).drop("__rn")
    tiered = best.join(tiers.select("source", "tier"), "source", "left").withColumn("tier", F.coalesce("tier", F.lit(2)))
    order = W.partitionBy("query_id").orderBy("tier", F.desc("score"), "chunk_id")
    return tiered.withColumn("evidence_rank", F.row_number().over(order)).filter(F.col("evidence_rank") <= limit)


def blocking_topic(validity: DataFrame) -> DataFrame:
    """The topic an INVALID experiment's evidence must be about; null leaves retrieval unrestricted."""
    topic = F.when(
        F.col("validity") == "INVALID",
        F.when(F.col("srm_failed"), "SRM")
        .when(F.col("arm_conflict"), "CONFLICTING_VARIANT_ASSIGNMENT")
        .when(F.col("critical_failure") & F.contains(F.lower("critical_label"), F.lit("outlier")), "OUTLIER_DETECTION")
        .when(F.col("critical_failure"), "CRITICAL_DATA_QUALITY"),
    )
    return validity.withColumn("topic", topic)


def mentions(text: Column, topic: str) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in fixed.TOPIC_WORDS[topic]))


def topics_of(text: Column) -> Column:
    """Topics a text covers, as an array."""
    return F.array_compact(F.array(*[F.when(mentions(text, t), F.lit(t)) for t in fixed.TOPIC_WORDS]))


def filter_by_topic(evidence: DataFrame, experiments: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Keep evidence about the blocking topic; experiments without a topic keep everything."""
    held = evidence.join(experiments.select(*keys, "topic"), keys)
    return held.filter(F.col("topic").isNull() | F.array_contains(topics_of(F.concat_ws(" ", "heading", text)), F.col("topic")))


def with_fallback(evidence: DataFrame, experiments: DataFrame, keys: list[str], note: str, text: str = "content") -> DataFrame:
    """Append a built-in note where the ratio check failed and no evidence covers it."""
    covering = evidence.filter(
        F.lower(F.concat_ws(" ", "heading", text)).rlike("sample ratio mismatch|srm")
    ).select(*keys)
    missing = experiments.filter("srm_failed").select(*keys).join(covering, keys, "left_anti").dropDuplicates(keys)
    added = missing.select(
        *keys,
        F.lit("built-in").alias("source"),
        F.lit("Sample ratio check").alias("heading"),
        F.lit(note).alias(text),
        F.lit(0.0).alias("score"),
        F.lit(True).alias("is_system"),
    )
    return evidence.select(*keys, "source", "heading", text, "score", F.lit(False).alias("is_system")).unionByName(added)


def retrieval_query(requests: DataFrame) -> DataFrame:
    """Query text: the prompt alone for concept questions, otherwise prompt, review concepts and metric terms."""
    terms = F.create_map(*[F.lit(x) for kv in fixed.METRIC_TYPE_TERMS.items() for x in kv])
    full = F.concat_ws(" ", F.col("prompt"), F.lit(fixed.REVIEW_CONCEPTS), terms[F.col("metric_type")])
    return requests.withColumn("query_text", F.when(F.col("concept_only"), F.col("prompt")).otherwise(full))


