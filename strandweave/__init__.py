"""String-graph sequence assembly expressed as Spark DataFrame transformations."""

from strandweave.session import build_session

__all__ = ["build_session"]
