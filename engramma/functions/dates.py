"""Partial dates: ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` strings, compared as far as both go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(when: Column, lo: Column, hi: Column) -> Column:
    """Whether a partial date lies in an inclusive window of partial dates; ``""`` leaves an end open.

    An empty date lies only in the window that is open at both ends; a month as upper end includes all of its days.
    """
    above = (lo == "") | (when >= F.substring(lo, F.lit(1), F.length(when))) | (F.substring(when, F.lit(1), F.length(lo)) >= lo)
    below = (hi == "") | (when <= F.concat(hi, F.lit("~")))
    return F.when(when == "", (lo == "") & (hi == "")).otherwise(above & below)


def conf_rank(conf: Column) -> Column:
    """low 0, med 1, high 2; anything else counts as med."""
    return F.when(conf == "low", 0).when(conf == "high", 2).otherwise(1)
