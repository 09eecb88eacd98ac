"""strata: cohort screening (validate, profile, clean, cross-validate, compare, cluster) on Spark."""

__version__ = "0.1.0"
