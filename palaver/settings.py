"""What can be set from outside: by the session (spark.palaver.NAME), else the environment (PALAVER_NAME), else as it is by default."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from palaver.functions import patterns as P


@dataclass(frozen=True)
class Settings:
    verbatim: int = P.VERBATIM_TURNS
    max_store_rules: int = P.STORE_RULES
    review: bool = True
    rules_store: str = ""


def settings(spark: SparkSession | None = None) -> Settings:
    """The settings; a number that is none, or below 0, is an error."""

    def said(name: str) -> str | None:
        own = spark.conf.get(f"spark.palaver.{name}", None) if spark is not None else None
        return own if own is not None else os.environ.get(f"PALAVER_{name.upper()}")

    def number(name: str, default: int) -> int:
        value = said(name)
        if value is None:
            return default
        if not value.strip().isdecimal():
            raise ValueError(f"{name} is a number of 0 or more, not {value!r}")
        return int(value)

    config = os.environ.get("XDG_CONFIG_HOME") or str(Path.home() / ".config")
    review = said("review")
    return Settings(
        number("verbatim", P.VERBATIM_TURNS), min(number("max_store_rules", P.STORE_RULES), P.STORE_HARD_MAX), review is None or review.strip().lower() in ("1", "true", "yes"),
        said("rules_store") or f"file://{config}/palaver/rules",
    )
