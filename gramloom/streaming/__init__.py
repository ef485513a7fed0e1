"""Sums over streams: a sandwich is additive, so micro-batches add up."""

from .accumulate import SandwichStream
from .runs import RunningSandwich, running_moments

__all__ = ["RunningSandwich", "SandwichStream", "running_moments"]
