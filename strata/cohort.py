"""The cohort: one table with an ID column, numeric features and a 0/1 target.

Roles are positional by default (first column = ID, last = target, the rest
are features) and can be named explicitly.  A cohort is an immutable value:
cleaning returns a new cohort instead of mutating a registry.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Cohort:
    df: DataFrame
    id_col: str
    target_col: str
    feature_cols: tuple[str, ...]
    # intermediate tables derived from this exact value (profile value counts, fences, ...)
    cache: dict = field(default_factory=dict, compare=False, repr=False, hash=False)

    @classmethod
    def from_frame(cls, df: DataFrame, id_col: str | None = None, target_col: str | None = None,
                   feature_cols: list[str] | tuple[str, ...] | None = None) -> "Cohort":
        cols = list(df.columns)
        if len(cols) < 3:
            raise ValueError("Dataset must contain at least three columns (ID, feature(s), target).")
        id_col = id_col or cols[0]
        target_col = target_col or cols[-1]
        if feature_cols is None:
            feature_cols = [c for c in cols if c not in (id_col, target_col)]
        return cls(df, id_col, target_col, tuple(feature_cols), {})

    def with_df(self, df: DataFrame, feature_cols: list[str] | tuple[str, ...] | None = None) -> "Cohort":
        feats = self.feature_cols if feature_cols is None else tuple(feature_cols)
        return replace(self, df=df, feature_cols=feats, cache={})

    def require_features(self) -> tuple[str, ...]:
        if not self.feature_cols:
            raise ValueError("No feature columns available for model training. Please review the cleaning step.")
        return self.feature_cols

    @property
    def columns(self) -> list[str]:
        return [self.id_col, *self.feature_cols, self.target_col]
