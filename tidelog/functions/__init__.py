"""Scalar functions of the log model, as Spark column expressions."""

from tidelog.functions.scalar import *  # noqa: F403
