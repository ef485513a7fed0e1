"""Design matrices over Spark DataFrames, and their reductions."""

from .functions.formula import Spec, from_formula, stateful_transform
from .operators import CooMatrix, DesignMatrix, StandardizedView, accumulate, arranged, hstack
from .operators.matrix import to_numpy
from .sources import as_design, dense, from_codes, from_coo, from_csc, from_df, from_pandas, single_categorical

__all__ = ["CooMatrix", "DesignMatrix", "Spec", "StandardizedView", "accumulate", "arranged", "as_design", "dense", "from_codes", "from_coo", "from_csc", "from_df", "from_formula", "from_pandas", "hstack", "single_categorical", "stateful_transform", "to_numpy"]
