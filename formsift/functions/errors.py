"""Failure texts that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.text import blank_to_empty, contains_any

# --- Fixed values ------------------------------------------------------------------------
CONNECTION_REFUSED = (
    "Сервер ИИ отказал в подключении (ошибка 61). "
    "Проверьте, что Ollama/LM Studio запущен, IP и порт указаны верно, "
    "а доступ к серверу разрешён в локальной сети."
)
UNKNOWN_ERROR = "Неизвестная ошибка компилятора"
INTERNAL_ERROR = "Внутренняя ошибка компилятора. Подробности — в журнале сервера."
SHOWN_TYPES = ["ValueError", "RuntimeError", "RecognitionError"]
# -----------------------------------------------------------------------------------------


def friendly_error(error_type: Column, message: Column) -> Column:
    """Connection failures get advice, expected failures their own text, the rest none."""
    raw = blank_to_empty(message)
    refused = F.contains(raw, F.lit("61")) | contains_any(
        F.lower(raw), ["connection refused", "connecterror"]
    )
    return (
        F.when(refused, CONNECTION_REFUSED)
        .when(error_type.isin(*SHOWN_TYPES), F.when(raw == "", UNKNOWN_ERROR).otherwise(raw))
        .otherwise(INTERNAL_ERROR)
    )
