"""Two-period panel change analysis as Spark DataFrame operators."""

from driftpanel.session import get_spark, materialize, shared_dir

__all__ = ["get_spark", "materialize", "shared_dir"]
