"""The display rules as SQL functions, for people who query the listing table in SQL.

They are plain SQL expressions, so Catalyst inlines them like any other expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from listwright import fixed_values as fv
from listwright.functions.text import WHITESPACE

_URL = f"trim(BOTH '{WHITESPACE}' FROM coalesce(url, ''))"
_FUNCTIONS = {
    "score_band(score INT) RETURNS STRING": f"""CASE WHEN score IS NULL THEN 'unscored'
        WHEN score >= {fv.HIGH_SCORE} THEN 'high' WHEN score >= {fv.MID_SCORE} THEN 'mid' ELSE 'low' END""",
    "safe_link(url STRING) RETURNS STRING": f"""CASE WHEN lower({_URL}) LIKE 'http://%'
        OR lower({_URL}) LIKE 'https://%' THEN {_URL} ELSE '#' END""",
    "dedupe_key(url STRING) RETURNS STRING": f"sha2(lower({_URL}), 256)",
    "relative_age(ts TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ) RETURNS STRING": """CASE
        WHEN ts IS NULL THEN ''
        WHEN timestampdiff(SECOND, ts, as_of) < 60 THEN 'just now'
        WHEN timestampdiff(MINUTE, ts, as_of) < 60 THEN timestampdiff(MINUTE, ts, as_of) || 'm ago'
        WHEN timestampdiff(HOUR, ts, as_of) < 24 THEN timestampdiff(HOUR, ts, as_of) || 'h ago'
        WHEN timestampdiff(DAY, ts, as_of) < 30 THEN timestampdiff(DAY, ts, as_of) || 'd ago'
        WHEN timestampdiff(DAY, ts, as_of) < 365 THEN timestampdiff(DAY, ts, as_of) div 30 || 'mo ago'
        ELSE timestampdiff(DAY, ts, as_of) div 365 || 'y ago' END""",
}


def register_sql_functions(spark: SparkSession) -> None:
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
