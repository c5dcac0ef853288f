"""Column contracts and the fixed values the analytics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Input contract: the columns a project file must carry, in canonical order.
REQUIRED_COLUMNS = [
    "project_id",
    "project_name",
    "project_type",
    "contract_value_usd",
    "start_date",
    "end_date",
    "region",
    "subcontractor_count",
    "delay_days",
    "cost_overrun_pct",
    "safety_incidents",
    "payment_disputes",
    "final_status",
]
NUMERIC_COLUMNS = [
    "contract_value_usd",
    "subcontractor_count",
    "delay_days",
    "cost_overrun_pct",
    "safety_incidents",
    "payment_disputes",
]
# Filled only on finished work; every other numeric column is filled everywhere.
OUTCOME_COLUMNS = ["safety_incidents", "payment_disputes"]
DATE_COLUMNS = ["start_date", "end_date"]
INTEGER_COLUMNS = [
    "subcontractor_count",
    "safety_incidents",
    "payment_disputes",
    "actual_duration_days",
]
NON_NEGATIVE_COLUMNS = [
    "contract_value_usd",
    "subcontractor_count",
    "safety_incidents",
    "payment_disputes",
    "actual_duration_days",
]
OUTPUT_COLUMNS = [
    "project_id_external",
    "project_name",
    "project_type",
    "contract_value_usd",
    "start_date",
    "end_date",
    "region",
    "subcontractor_count",
    "delay_days",
    "cost_overrun_pct",
    "safety_incidents",
    "payment_disputes",
    "final_status",
    "actual_duration_days",
    "anomaly_flags",
]
COMPLETED = "Completed"
IN_PROGRESS = "In Progress"
SOURCE_CSV = "csv"
SOURCE_MANUAL = "manual"

# Tokens a CSV reader treats as missing, in every column.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Anomaly thresholds (first two are strict, last two inclusive).
HIGH_OVERRUN_PCT = 25.0
HIGH_DELAY_DAYS = 150.0
HIGH_INCIDENTS = 5
HIGH_DISPUTES = 5
FLAG_CATEGORIES = [
    ("cost_overrun_high", "cost_overrun"),
    ("delay_days_high", "schedule_delay"),
    ("safety_incidents_high", "safety"),
    ("payment_disputes_high", "disputes"),
]

# Size buckets (upper bounds are exclusive).
SMALL_BELOW_USD = 25_000_000.0
MEDIUM_BELOW_USD = 75_000_000.0

# Risk score: dimensions in tie-break order, equal weights, default subscore.
RISK_DIMENSIONS = [
    "type_risk",
    "region_risk",
    "size_risk",
    "complexity_risk",
    "duration_risk",
]
RISK_WEIGHT = 0.2
UNKNOWN_RISK = 0.5

# Rules: z of the 95 % interval, outcome order, confidence multipliers.
Z_95 = 1.96
OUTCOMES = ["high_overrun", "high_delay", "any_safety_incident", "any_dispute"]
SCOPES = ["project_type", "region", "size_bucket"]
CONFIDENCE_MULTIPLIER = {"low": 0.5, "medium": 1.0, "high": 1.5}
OUTCOME_PHRASES = {
    "high_overrun": "cost overrun above 25%",
    "high_delay": "delays beyond 150 days",
    "any_safety_incident": "at least one safety incident",
    "any_dispute": "at least one payment dispute",
}

# Choices offered when a portfolio has no usable category of its own.
FALLBACK_TYPES = ["Commercial", "Energy", "Industrial", "Infrastructure", "Residential"]
FALLBACK_REGIONS = ["Midwest", "Mountain", "Northeast", "Southeast", "Southwest"]

# Screening: how many similar projects a bid may ask for.
MIN_K = 1
MAX_K = 20

# Dispute models.
BID_TIME_FEATURES = ["project_type", "region", "contract_value_usd", "subcontractor_count"]
LEAKY_FEATURES = ["delay_days", "cost_overrun_pct", "safety_incidents", "actual_duration_days"]
MIN_TRAINING_ROWS = 5

# Document chunks and retrieval.
CHUNK_WORDS = 400
CHUNK_OVERLAP = 50
MIN_CHUNK_CHARS = 20
DEFAULT_TOP_K = 3
MAX_TOP_K = 20
DEFAULT_THRESHOLD = 0.5
HIGH_SIMILARITY = 0.7
PREVIEW_CHARS = 200
MAX_REASON_CHARS = 500
# ----------------------------------------------------------------------------

RAW_PROJECT = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])

PROJECT_TYPES = {
    "project_id_external": T.StringType(),
    "project_name": T.StringType(),
    "project_type": T.StringType(),
    "contract_value_usd": T.DoubleType(),
    "start_date": T.DateType(),
    "end_date": T.DateType(),
    "region": T.StringType(),
    "subcontractor_count": T.IntegerType(),
    "delay_days": T.DoubleType(),
    "cost_overrun_pct": T.DoubleType(),
    "safety_incidents": T.IntegerType(),
    "payment_disputes": T.IntegerType(),
    "final_status": T.StringType(),
    "actual_duration_days": T.IntegerType(),
    "anomaly_flags": T.ArrayType(T.StringType()),
}
