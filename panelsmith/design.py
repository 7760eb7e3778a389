"""Resampling design: how many replicates and splits, how large, which seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Panel sizes of the study.
K_LIST = (3, 5, 10, 25, 50, 75, 100)
# Number of folds of every inner cross-validation.
N_FOLDS = 5


@dataclass(frozen=True)
class Design:
    """`n_reps` replicates of `n_splits` stratified Monte-Carlo splits.

    A *slot* is one (rep, split) pair. Per-sample facts about slots are kept as
    arrays in slot order, so a row carries all its roles and is never copied
    once per split just to be counted.
    """

    n_splits: int = 100
    first_rep: int = 0
    n_reps: int = 1
    test_size: float = 0.33
    seed: int = 42
    pos: str = "Cancer"
    neg: str = "Control"

    @property
    def n_slots(self) -> int:
        return self.n_splits * self.n_reps

    def slot_of(self, rep: Column, split: Column) -> Column:
        return ((rep - self.first_rep) * self.n_splits + split - 1).cast("int")

    def rep_of(self, slot: Column) -> Column:
        return (F.floor(slot / self.n_splits) + self.first_rep).cast("int")

    def split_of(self, slot: Column) -> Column:
        return (slot % self.n_splits + 1).cast("int")

    def draw_key(self, slot: Column, sample_ix: Column) -> Column:
        """Reproducible uniform sort key of a sample in a slot (md5 hex)."""
        return F.md5(F.concat_ws(
            "|",
            (self.rep_of(slot) + self.seed).cast("string"),
            self.split_of(slot).cast("string"),
            sample_ix.cast("string"),
        ).cast("binary"))
