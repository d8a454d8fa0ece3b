"""The vector functions for SQL, as temporary functions whose bodies are expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_SUM = "if(size(a) = size(b), aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, z) -> s + z), NULL)"
#: Name to parameters, type and body.
FUNCTIONS = {
    "dot_product": (_V, "DOUBLE", _SUM.format("x * y")),
    "l2_distance": (_V, "DOUBLE", "sqrt(" + _SUM.format("(x - y) * (x - y)") + ")"),
    "l1_distance": (_V, "DOUBLE", _SUM.format("abs(x - y)")),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "cosine_similarity": (_V, "DOUBLE", "if(vector_norm(a) * vector_norm(b) = 0, 0D, dot_product(a, b) / (vector_norm(a) * vector_norm(b)))"),
    "is_valid_vector": ("a ARRAY<DOUBLE>", "BOOLEAN", "coalesce(size(a) > 0 AND forall(a, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')), false)"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", "filter(transform(split(coalesce(t, ''), '(?U)[\\\\s,;]+'), x -> lower(regexp_replace(x, '^[^\\\\p{IsAlphabetic}\\\\p{N}]+|[^\\\\p{IsAlphabetic}\\\\p{N}]+$', ''))), x -> octet_length(x) >= 2)"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all for this session; the names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
