"""Transforms, quality checks and control: functions from DataFrames to DataFrames."""

from . import control, models, quality, relational, text  # noqa: F401
