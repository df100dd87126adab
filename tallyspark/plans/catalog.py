"""All named queries. Importing the parts fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import rows  # noqa: F401
from tallyspark.plans import history  # noqa: F401
from tallyspark.plans import evaluation  # noqa: F401
from tallyspark.plans import rating  # noqa: F401
from tallyspark.plans import opponent  # noqa: F401
from tallyspark.plans import probability  # noqa: F401
from tallyspark.plans import feature  # noqa: F401
from tallyspark.plans import people  # noqa: F401
from tallyspark.plans import practice  # noqa: F401
from tallyspark.plans import models  # noqa: F401
from tallyspark.plans import served  # noqa: F401
from tallyspark.plans import exchange  # noqa: F401
from tallyspark.plans.history import prior_form_difference
from tallyspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior_form_difference(spark, sf_dir)
