"""faultloom: vehicle-fault analytics as Spark DataFrame jobs."""

from faultloom.params import Params

__all__ = ["Params"]
