"""The engine's scalar functions for SQL text, as temporary SQL functions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BODIES = {
    "token_count(t STRING) RETURNS INT": "greatest(1, CAST(floor(length(t) / 4) AS INT))",
    "clamp01(x DOUBLE) RETURNS DOUBLE": "least(1D, greatest(0D, x))",
    "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "l2_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "cosine_of(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN l2_norm(a) > 0 AND l2_norm(b) > 0 THEN dot_product(a, b) / (l2_norm(a) * l2_norm(b)) ELSE 0D END",
    "jaccard_of(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END",
    "triple_key(h STRING, r STRING, t STRING) RETURNS STRING": "sha2(concat_ws('|', lower(trim(h)), lower(trim(r)), lower(trim(t))), 256)",
    "document_key(u STRING, p STRING) RETURNS STRING": "substring(sha1(concat(u, p)), 1, 16)",
    "short_title(t STRING) RETURNS STRING": "CASE WHEN length(t) > 60 THEN concat(substring(t, 1, 60), '…') ELSE t END",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in _BODIES]
