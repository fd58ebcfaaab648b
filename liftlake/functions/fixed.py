"""Fixed values the results depend on: thresholds, vocabularies and patterns."""

# --- thresholds -----------------------------------------------------------
ALPHA = 0.05
SRM_ALPHA = 0.05
NORMALITY_ALPHA = 0.05
OUTLIER_CRITICAL_SIGMA = 4.0
NULL_FRACTION_LIMIT = 0.01
TARGET_POWER = 0.80
IQR_MULTIPLIER = 1.5
MAD_SCALE = 0.6745
MAD_LIMIT = 3.5
LARGE_ARM = 30
MIN_EXPECTED_CELL = 5
SEGMENT_MIN_ARM = 30
SEGMENT_MAX_CARDINALITY = 10
SEGMENT_MAX_MISSING = 0.30
STRATUM_MIN_ARM = 10
STRATIFICATION_MAX_CARDINALITY = 20
CUPED_MIN_PAIRS = 10
CUPED_MIN_CORRELATION = 0.05
EVENT_ROWS_PER_USER = 1.5
SHAPIRO_MAX_N = 5000
BM25_K1 = 1.5
BM25_B = 0.75

# --- column-name vocabularies, in priority order ---------------------------
USER_NAMES = ["user_id", "userid", "user", "customer_id", "visitor_id", "id"]
ARM_NAMES = [
    "variant", "group", "arm", "bucket", "treatment", "cohort",
    "experiment_group", "test_group", "ab_group", "ab_variant", "variant_group",
    "variant_name", "group_name", "segment", "treatment_group", "campaign_group",
]
HOLDOUT_LABELS = [
    "control", "ctrl", "holdout", "no email", "no e mail",
    "no campaign", "no treatment", "untreated",
]
EVENT_NAMES = ["event_name", "event_type", "event", "action"]
FUNNEL_EVENT_NAMES = ["event", "event_name", "event_type", "action", "step"]
TIMESTAMP_NAMES = ["timestamp", "event_time", "created_at", "occurred_at", "time"]
OUTCOME_NAMES = [
    "converted", "conversion", "purchased", "is_converted",
    "order_value", "revenue", "value", "amount", "click", "clicked",
    "conversions", "purchases", "clicks", "metric",
]
ARM_SIZE_NAMES = ["users", "sample_size", "n", "impressions", "visitors", "sessions"]
COVARIATE_NAMES = [
    "pre_experiment_metric", "pre_experiment_value", "pre_metric",
    "pre_metric_value", "baseline", "baseline_metric", "baseline_value",
    "covariate", "cuped_covariate",
]
# The adjustment step looks the explicit names up in this order.
ADJUSTMENT_COVARIATE_NAMES = [
    "pre_metric", "pre_experiment_metric", "pre_experiment_value",
    "pre_metric_value", "baseline", "baseline_metric", "baseline_value",
    "covariate", "cuped_covariate",
]
COVARIATE_AFFIXES = ["pre", "prev", "before", "baseline", "historical"]
DEMOGRAPHIC_WORDS = ["age", "gender", "sex", "dob", "birth_year"]
MONETARY_WORDS = ["revenue", "value", "amount", "price", "aov", "spend"]
LOWER_IS_BETTER_WORDS = [
    "latency", "load_time", "response_time", "error_rate", "error",
    "bounce_rate", "bounce", "crash_rate", "crash", "unsubscribe",
    "complaint", "refund", "churn", "cancellation", "cancel", "page_load",
]
HIGHER_IS_BETTER_WORDS = [
    "revenue", "purchase", "spend", "order_value", "aov",
    "session_duration", "session_time", "views", "visit",
    "add_to_cart", "first_order",
]
PRE_TREATMENT_WORDS = [
    "age", "recency", "historical_spend", "history", "customer_type",
    "channel", "region", "newbie", "previous_purchase_count",
    "previous_purchase", "prior_purchase", "tenure", "signup_date",
    "account_age", "zip_code", "zipcode", "loyalty_tier",
    "customer_since", "gender", "income", "baseline",
]
POST_TREATMENT_WORDS = [
    "conversion", "converted", "visit", "visited", "click", "clicked",
    "open", "opened", "campaign_revenue", "current_spend",
    "current_order", "response", "responded", "purchase", "purchased",
    "signup", "signed_up", "revenue", "spend", "order_value",
    "customer_value", "delivered", "sent", "add_to_cart",
]
FUNNEL_STAGES = [
    ("sent", ["sent"]),
    ("delivered", ["delivered"]),
    ("opened", ["opened", "open"]),
    ("clicked", ["clicked", "click"]),
    ("visited", ["visited", "visit"]),
    ("converted", [
        "converted", "conversion", "purchase", "purchased",
        "signup", "signed_up", "response", "responded",
    ]),
]
METRIC_LABELS = {
    "converted": "Conversion Rate",
    "conversion": "Conversion Rate",
    "is_converted": "Conversion Rate",
    "purchased": "Conversion Rate",
    "order_value": "Order Value",
    "revenue": "Revenue",
    "value": "Value",
    "amount": "Amount",
    "click": "Click Rate",
    "clicked": "Click Rate",
}
RATE_NUMERATORS = {
    "conversions": "conversion_rate",
    "conversion_count": "conversion_rate",
    "purchases": "purchase_rate",
    "orders": "order_rate",
    "clicks": "click_rate",
    "opens": "open_rate",
    "signups": "signup_rate",
    "responses": "response_rate",
    "successes": "success_rate",
}
MONEY_NUMERATORS = ["revenue", "spend", "gmv", "order_value_total", "total_spend"]
RATIO_DENOMINATORS = [
    "users", "sessions", "impressions", "visits", "customers",
    "n", "exposures", "sample_size",
]

# --- text ------------------------------------------------------------------
TOKEN_PATTERN = "[a-z0-9]+(?:-[a-z0-9]+)*"
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "this", "that", "these", "those", "it", "its", "of", "to", "in",
    "on", "for", "with", "as", "at", "by", "from", "and", "or", "but",
    "if", "then", "than", "so", "not", "no", "do", "does", "did",
    "can", "could", "will", "would", "should", "what", "which", "who",
    "how", "when", "where", "why", "i", "you", "he", "she", "we",
    "they", "my", "your", "our", "their", "me", "us", "them",
    "like", "just", "also", "very", "get", "gets", "make", "makes",
]
SUFFIXES = ["ously", "ing", "tion", "ed", "ly", "es", "s"]
MIN_STEM = 4
TOPIC_WORDS = {
    "SRM": ["sample ratio mismatch", "srm", "allocation imbalance", "randomization"],
    "CONFLICTING_VARIANT_ASSIGNMENT": [
        "conflicting variant assignment", "multiple variants per user",
        "treatment assignment integrity", "randomization integrity",
    ],
    "OUTLIER_DETECTION": [
        "outlier detection", "outliers", "outlier", "extreme observations",
        "extreme observation", "extreme value", "influential observations",
        "influential observation", "data quality", "robust analysis",
        "robust statistics", "heavy-tailed", "heavy tailed",
    ],
    "CRITICAL_DATA_QUALITY": ["data quality", "data integrity"],
}
REVIEW_CONCEPTS = (
    "A/B testing experiment validity randomization sample ratio mismatch "
    "statistical significance practical significance minimum detectable effect "
    "power analysis guardrail metrics multiple comparisons segmentation "
    "heterogeneous treatment effects interpreting experiment results"
)
METRIC_TYPE_TERMS = {
    "binary": "binary conversion metric chi-square test",
    "continuous_monetary": "continuous revenue metric t-test confidence interval",
    "continuous_general": "continuous metric t-test confidence interval",
}
REVIEW_WORDS = [
    "ship", "evaluate", "evaluation", "significant", "significance",
    "analyze", "analysis", "compare", "test", "review", "uplift",
    "conversion", "effect", "winner", "launch",
]
QUALITY_WORDS = [
    "srm", "sample ratio", "quality", "audit", "randomization",
    "randomisation", "null", "missing value", "outlier",
]
CONCEPT_WORDS = [
    "cuped", "srm", "sample ratio mismatch", "mann-whitney", "mann whitney",
    "welch", "chi-square", "chi square", "fisher's exact", "fishers exact",
    "p-value", "p value", "mde", "minimum detectable effect",
    "statistical power", "guardrail metric", "novelty effect",
    "primacy effect", "twyman", "holdout", "bootstrap confidence",
    "shapiro-wilk", "shapiro wilk", "variance reduction", "sequential testing",
    "multiple comparisons", "overall evaluation criterion",
]
DATASET_WORDS = [
    "this dataset", "this experiment", "my dataset", "my data",
    "my experiment", "this data", "our data", "the dataset",
    "for this", "check for", "in my data",
]
METRIC_CHOICE_WORDS = [
    "primary metric", "most appropriate primary metric", "best metric",
    "which metric", "what metric", "outcome metric", "available metrics",
    "metrics should", "metric should", "choose a metric",
]
FUNNEL_WORDS = [
    "funnel", "drop-off", "dropoff", "drop off", "drop-offs",
    "conversion decrease", "conversion drop", "where users drop",
    "step-by-step conversion", "biggest drop", "onboarding funnel",
    "signup rate", "which step", "lose users", "losing users",
]
QUESTION_LEADS = [
    "what is", "what's", "whats", "what are", "explain", "describe",
    "define", "how does", "how do", "how is", "how are",
]
INSTRUCTION_PATTERNS = [
    r"ignore (all |any )?(previous|prior|above) instructions?",
    r"disregard (all |any )?(previous|prior|above) instructions?",
    r"you are now",
    r"new instructions?:",
    r"system prompt",
    r"(?<![a-z])system:",
    r"(?<![a-z])assistant:",
    r"(?<![a-z])user:",
    r"</?(system|instructions?|prompt)>",
]
NUMBER_PATTERN = r"[-+]?\d[\d,]*\.?\d*%?"
STRATIFY_PATTERN = (
    r"(?i)\bstratif\w*\b.*?\b(?:by|using|on)\s+"
    r"([a-zA-Z_][a-zA-Z0-9_]*(?:[ _][a-zA-Z0-9_]+){0,3})"
)
TRAJECTORIES = {
    "knowledge_base_only": ["classifier", "planner", "knowledge_base", "decision"],
    "funnel_only": ["classifier", "planner", "funnel", "decision"],
    "funnel_and_validation": ["classifier", "planner", "funnel", "validation", "experiment", "decision"],
    "normal_review": ["classifier", "planner", "validation", "experiment", "decision"],
    "srm_fail_short_circuit": ["classifier", "planner", "validation", "experiment", "decision"],
}
HIGHER_BETTER_SCORES = [
    "decision_accuracy", "overall_accuracy", "rag_avg_precision_at_k",
    "rag_avg_recall_at_k", "rag_avg_answer_faithfulness",
]
LOWER_BETTER_SCORES = [
    "unsafe_go_rate", "guardrail_override_rate", "invalid_experiment_approval_rate",
    "false_positive_rate", "false_negative_rate", "safety_invariant_violations",
]
