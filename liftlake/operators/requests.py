"""Request text: intent tags, stratification requests, neutralized values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import fixed


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def intent_tags(requests: DataFrame, text: str, n_arms: str | None = None) -> DataFrame:
    """Ordered keyword rules: metric choice, concept, funnel, quality, full review."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    arms = F.col(n_arms) if n_arms else F.lit(2)
    review, quality = _any(low, fixed.REVIEW_WORDS), _any(low, fixed.QUALITY_WORDS)
    funnel = _any(low, fixed.FUNNEL_WORDS)
    lead = F.regexp_replace(low, r"^\s+", "")
    asks = F.contains(low, F.lit("?")) | lead.rlike("^(?:" + "|".join(re.escape(w) for w in fixed.QUESTION_LEADS) + ")")
    metric_choice = (arms == 0) & _any(low, fixed.METRIC_CHOICE_WORDS)
    concept = _any(low, fixed.CONCEPT_WORDS) & ~_any(low, fixed.DATASET_WORDS) & ~funnel & asks
    intent = (
        F.when(metric_choice | concept, "knowledge_base")
        .when(funnel, "funnel_analysis")
        .when(quality & ~review, "quality_check")
        .otherwise("full_review")
    )
    capabilities = (
        F.when(F.col("intent") == "knowledge_base", "knowledge_base")
        .when((F.col("intent") == "funnel_analysis") & review, "funnel,validation,experiment")
        .when(F.col("intent") == "funnel_analysis", "funnel")
        .when(F.col("intent") == "quality_check", "validation")
        .otherwise("validation,experiment,knowledge_base")
    )
    return requests.withColumn("intent", intent).withColumn("capabilities", capabilities)


def stratification_requests(requests: DataFrame, keys: list[str], text: str, columns: DataFrame) -> DataFrame:
    """Explicit requests for stratified analysis and the column they name.

    ``columns``: dataset, column_name. The captured phrase's word prefixes meet
    the dataset's columns by equality (blank and underscore alike); the longest
    match wins, otherwise the phrase itself joined by underscores.
    """
    asked = requests.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"(?i)\bstratif\w*\b")).withColumn(
        "phrase", F.trim(F.regexp_extract(text, "(?s)" + fixed.STRATIFY_PATTERN, 1))
    )
    words = F.filter(F.split("phrase", r"\s+"), lambda w: F.length(w) > 0)
    named = asked.withColumn("__w", words)
    prefixes = named.filter(F.size("__w") > 0).select(
        *keys, "dataset", F.explode(F.transform(F.sequence(F.lit(1), F.size("__w")), lambda n: F.struct(n.alias("n"), F.lower(F.array_join(F.slice("__w", F.lit(1), n), " ")).alias("p")))).alias("x")
    )

    def plain(c: Column) -> Column:
        return F.replace(F.lower(c), F.lit("_"), F.lit(" "))

    known = columns.select("dataset", plain(F.col("column_name")).alias("__c"), "column_name").dropDuplicates(["dataset", "__c"])
    hits = (
        prefixes.select(*keys, "dataset", F.col("x.n").alias("n"), plain(F.col("x.p")).alias("__c"))
        .join(known, ["dataset", "__c"])
        .groupBy(*keys)
        .agg(F.max(F.struct("n", "column_name"))["column_name"].alias("matched"))
    )
    raw = F.when(F.size("__w") > 0, F.array_join("__w", "_"))
    return named.join(hits, keys, "left").select(
        *keys, "dataset", "phrase", F.coalesce("matched", raw).alias("resolved_column"), F.col("matched").isNotNull().alias("is_real_column")
    )


INSTRUCTION_RE = "(?i)" + "|".join(f"(?:{p})" for p in fixed.INSTRUCTION_PATTERNS)


def looks_like_instruction(text: Column) -> Column:
    return text.rlike(INSTRUCTION_RE)


def neutralize(text: Column, max_len: int = 80) -> Column:
    """Display-safe copy of a value: printable, one line, capped, defused, wrapped."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\n\t]", " "), r"\p{C}", ""), r"[\s\p{Z}]+", " ")
    clean = F.trim(flat)
    short = F.when(F.length(clean) > max_len, F.concat(F.rtrim(F.substring(clean, 1, max_len)), F.lit("…"))).otherwise(clean)
    broken = F.regexp_replace(short, r"([<>])", "$1​")
    defused = F.when(looks_like_instruction(broken), F.replace(broken, F.lit(":"), F.lit(" -"))).otherwise(broken)
    return F.when(F.coalesce(F.length(defused), F.lit(0)) > 0, F.concat(F.lit("[dataset value: "), defused, F.lit("]"))).otherwise("")


def instruction_rate(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Share of instruction-like texts per source, over whole texts."""
    flag = F.coalesce(looks_like_instruction(F.col(text)), F.lit(False))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(flag).alias("n_flagged"), F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("flag_rate")
    )
