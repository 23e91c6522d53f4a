"""Code analytics on Spark: classes, members, resources, use edges and renames as DataFrames."""

from .errors import DatasetUnavailable, InvalidArgument, NotFound, QuernError

__all__ = ["DatasetUnavailable", "InvalidArgument", "NotFound", "QuernError"]
