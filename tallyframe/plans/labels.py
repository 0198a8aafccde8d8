"""Codes and labels of chosen variables side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.operators.reshape import relocate, wider


def label_table(dictionary: DataFrame, variables: Sequence[str], last: str | None = None) -> DataFrame:
    """``{variable}_val, {variable}_lbl`` per variable, codes in order, one row per position.

    ``last`` names a variable to put at the end. A variable has as many rows as it has codes.
    """
    chosen = dictionary.filter(F.col("var_name").isin(*variables)).select("var_name", F.inline("val_labels"))
    numbered = chosen.withColumn("row", F.row_number().over(Window.partitionBy("var_name").orderBy("val")))
    table = wider(numbered, ["row"], "var_name", variables, ["val", "lbl"]).orderBy("row").drop("row")
    if last is None:
        return table
    tail = [f"{last}_val", f"{last}_lbl"]
    return relocate(table, tail, after=[c for c in table.columns if c not in tail][-1])
