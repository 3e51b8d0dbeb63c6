"""Upsert and delete as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame


def delete_by_ids(target: DataFrame, ids: DataFrame, id_field: str) -> DataFrame:
    """Unknown ids are no-ops; no version is looked at."""
    return target.join(ids.select(id_field).distinct(), id_field, "left_anti")


def replace_by_ids(target: DataFrame, rows: DataFrame, id_field: str) -> DataFrame:
    """Every stored row of an incoming id gives way to the incoming rows."""
    return delete_by_ids(target, rows, id_field).unionByName(rows)
