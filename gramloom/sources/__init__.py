"""Where matrices come from: DataFrames, triplets and formulas."""

from .constructors import as_design, dense, from_codes, from_coo, from_csc, from_df, from_pandas, packed, single_categorical

__all__ = ["as_design", "dense", "from_codes", "from_coo", "from_csc", "from_df", "from_pandas", "packed", "single_categorical"]
