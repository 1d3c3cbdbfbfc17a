"""Scalar functions as Spark columns."""

from .scalar import expit, link_name, logit, odds, split_names

__all__ = ["expit", "link_name", "logit", "odds", "split_names"]
