"""The language dimension: a constant table of five rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LANGUAGE

# Code, voice, whether it is a news voice, and translation target of each language; all voices are male.
_ROWS = (
    ("en-US", "Matthew", True, "en"),
    ("es-US", "Pedro", True, "es"),
    ("fr-FR", "Remi", False, "fr"),
    ("de-DE", "Daniel", False, "de"),
    ("pt-BR", "Thiago", False, "pt"),
)
CODES = tuple(code for code, *_ in _ROWS)
SOURCE_LANGUAGE = "en"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(code, [(voice, news, "MALE")], target) for code, voice, news, target in _ROWS], LANGUAGE)
