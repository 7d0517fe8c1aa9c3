"""Fixed values and table schemas shared by every job.

The values in this module are part of the data contract: results are only
comparable when they are equal to these.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------

SEQUENCE_LENGTH = 10

FEATURES = [
    "amount_zscore",
    "hour_is_unusual",
    "is_new_device",
    "is_new_location",
    "is_foreign_location",
    "failed_logins_24h",
    "category_is_unusual",
    "txn_velocity_1h",
    "amount_pct_of_avg",
]

MODEL_INPUTS = FEATURES + ["risk_score"]

HOME_LOCATIONS = [
    "Hyderabad", "Mumbai", "Delhi", "Bangalore", "Chennai",
    "Kolkata", "Pune", "Ahmedabad", "Jaipur", "Lucknow",
]

DISPLAY_NAMES = {
    "amount_zscore": "Unusual Transaction Amount",
    "hour_is_unusual": "Unusual Transaction Time",
    "is_new_device": "New Device",
    "is_new_location": "New Location",
    "is_foreign_location": "Foreign Location",
    "failed_logins_24h": "Multiple Failed Logins",
    "category_is_unusual": "Unusual Merchant Category",
    "txn_velocity_1h": "High Transaction Velocity",
    "amount_pct_of_avg": "Amount Far Above Average",
    "risk_score": "Elevated Behavioral Risk Score",
}

UNUSUAL_FREQUENCY = 0.05
VELOCITY_SECONDS = 3600
FAILED_LOGIN_SECONDS = 86400
ZSCORE_LIMIT = 10.0
PCT_LIMIT = 1000.0
INPUT_LIMIT = 6.0
PROBABILITY_CAP = 0.999
REASON_THRESHOLD = 0.05
TOP_REASONS = 4
SIMILARITY_DECAY = 2.9
DECISION_THRESHOLD = 0.5
TEST_PERCENT = 20
VALIDATION_PERCENT = 15
BACKGROUND_ROWS = 200
MIN_RING_CUSTOMERS = 2
CUSTOMER_LIST_LIMIT = 50
TIMELINE_LIMIT = 100
DEFAULT_LOCATION = "Hyderabad"
DEFAULT_DEVICE_PATTERN = "DEV_{}_A"

ALERT_LEVELS = ["Low Risk", "Medium Risk", "High Risk", "Critical Risk"]
ALERT_CUTS = [25.0, 50.0, 80.0]

NO_REASONS_SENTENCE = "No significant fraud-indicating factors detected."

METRIC_MEANINGS = {
    "Risk Score": "Trajectory risk from prior activity, before this transaction",
    "Fraud Probability": "This specific transaction's own fraud likelihood",
    "Behavioral Similarity": "How closely this matches the customer's normal behavior",
    "Deviation": "How far this deviates from the customer's own historical norm",
}

# --- schemas ----------------------------------------------------------------

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("failed_logins_24h", T.IntegerType()),
    T.StructField("is_new_device", T.IntegerType()),
    T.StructField("is_new_location", T.IntegerType()),
    T.StructField("is_fraud", T.IntegerType()),
])

BATCH_REQUIRED = ["customer_id", "amount", "merchant_category"]

BATCH_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("failed_logins_24h", T.IntegerType()),
])

REASON_TYPE = T.ArrayType(T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("attribution", T.DoubleType()),
]))

SCORED_COLUMNS = [
    "transaction_id", "customer_id", "timestamp", "amount", "merchant_category",
    "device_id", "location", "failed_logins_24h", "risk_score",
    "fraud_probability", "similarity_pct", "deviation_pct", "alert_level",
]
