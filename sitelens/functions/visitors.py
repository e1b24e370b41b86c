"""Visitor identity (P14 to P16): keyed digests that change with the day or the period."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A visitor is an address and an agent; joined and grouped as two columns.
PAIR = ["c_ip", "cs_user_agent"]


def has_address() -> Column:
    """Rows with a viewer's address; '-' and null are none."""
    return F.col("c_ip") != "-"


def salt(secret: str, *scope: str) -> str:
    """The salt of a day, or of a period's unit, zone, week start and bounds."""
    message = "|".join(["visitors", "1", *scope])
    return hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


def day_salts(spark: SparkSession, secret: str, days: Iterable[str]) -> DataFrame:
    """day, salt: one row per day asked for, computed where the secret is."""
    return spark.createDataFrame([(d, salt(secret, "day", d)) for d in days] or [], "day string, salt string")


def digest(salt_column: Column) -> Column:
    return F.upper(F.sha2(F.concat(salt_column, F.lit("|"), F.col("c_ip"), F.lit("|"), F.col("cs_user_agent")), 256))
