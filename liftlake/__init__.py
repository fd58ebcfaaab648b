"""liftlake: controlled-experiment analytics as Spark jobs.

Tables of randomized units and event logs go in; validity checks, treatment
effects, power, segments, strata, funnels, guardrails, ship decisions and
ranked methodology text come out. Public functions take DataFrames and key
columns and return DataFrames.
"""

__version__ = "0.1.0"
