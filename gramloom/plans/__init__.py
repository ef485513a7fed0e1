"""The planner's view of a matrix: blocks, names, and the whitelist formula grammar."""
