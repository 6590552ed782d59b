"""The errors that rows and calls may carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, how severe each is, and which may be tried again.
SEVERITY = {
    "CONFIG_ERROR": "critical", "DEPENDENCY_ERROR": "critical", "AUTHENTICATION_ERROR": "critical",
    "BACKEND_CONNECTION_ERROR": "high", "MODEL_NOT_FOUND": "high", "RESOURCE_ERROR": "high",
    "PDF_PROCESSING_ERROR": "medium", "PDF_RENDERING_ERROR": "medium", "TEXT_EXTRACTION_ERROR": "medium", "OCR_ERROR": "medium", "INFERENCE_ERROR": "medium", "MARKDOWN_GENERATION_ERROR": "medium",
    "BACKEND_ERROR": "low", "MODEL_LOAD_ERROR": "low", "VALIDATION_ERROR": "low", "CACHE_ERROR": "low", "TIMEOUT_ERROR": "low", "RATE_LIMIT_ERROR": "low",
}
RETRIABLE = ["BACKEND_CONNECTION_ERROR", "TIMEOUT_ERROR", "RATE_LIMIT_ERROR", "MODEL_LOAD_ERROR"]


def error_table(spark: SparkSession) -> DataFrame:
    """code, severity, retriable."""
    rows = [F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(c in RETRIABLE).alias("retriable")) for c, s in SEVERITY.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def described(errors: DataFrame) -> DataFrame:
    """errors(code, ..) with severity and whether to try again; unknown codes are low and final."""
    found = errors.join(F.broadcast(error_table(errors.sparkSession)), "code", "left")
    return found.withColumns({"severity": F.coalesce("severity", F.lit("low")), "retriable": F.coalesce("retriable", F.lit(False))})


def wrapped(message: Column, code: Column, context: dict[str, Column]) -> Column:
    """An error as a struct: its code (or the general one), message and context as JSON."""
    known = F.to_json(F.struct(*[c.alias(k) for k, c in context.items()]))
    return F.struct(F.coalesce(code, F.lit("PDF_PROCESSING_ERROR")).alias("code"), message.alias("message"), known.alias("context"))
