"""Design matrices and their reductions."""

from .coo import CooMatrix
from .matrix import DesignMatrix, accumulate, arranged, hstack
from .standardized import StandardizedView

__all__ = ["CooMatrix", "DesignMatrix", "StandardizedView", "accumulate", "arranged", "hstack"]
