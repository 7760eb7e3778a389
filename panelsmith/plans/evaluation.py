"""Every classifier over one set of cells, outer or nested."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, N_FOLDS
from panelsmith.operators import cells, resample, selection, smote
from panelsmith.operators.models import forest, knn, lasso, lda, nb, svm
from panelsmith.session import settle


class CellSet:
    """Cells of some slots and panels with the models fitted on them.

    `slots_per_split` is 1 for the splits themselves and the number of folds
    for the inner slots of the stack. `imbalanced` turns on oversampling and
    class weights where the study uses them.
    """

    def __init__(
        self, design: Design, n_slots: int, roles: DataFrame, panels: DataFrame, centre: list[float],
        fit: DataFrame | None = None, slots_per_split: int = 1, imbalanced: bool = False, trees: int = forest.TREES,
    ) -> None:
        self.design, self.n_slots, self.roles, self.panels = design, n_slots, roles, panels
        self.centre, self._fit = centre, fit
        self.slots_per_split, self.imbalanced, self.trees = slots_per_split, imbalanced, trees

    @cached_property
    def arrays(self) -> DataFrame:
        return settle(cells.panel_arrays(self.panels), "arrays")

    @cached_property
    def fit(self) -> DataFrame:
        """Class moments of every feature; those of the ranking where it has them."""
        if self._fit is not None:
            return self._fit
        slots = Design(n_splits=self.n_slots, pos=self.design.pos, neg=self.design.neg)
        return settle(selection.pooled_variance(selection.group_moments(self.roles, slots, self.centre)), "fit")

    @cached_property
    def rows(self) -> DataFrame:
        return cells.cell_rows(self.roles, self.arrays, self.design.pos)

    @property
    def test(self) -> DataFrame:
        return self.rows.where("not in_train")

    @cached_property
    def train(self) -> DataFrame:
        return self.rows.where("in_train")

    @cached_property
    def oversampled(self) -> DataFrame:
        """Training rows with synthetic minority rows where the study is imbalanced."""
        if not self.imbalanced:
            return self.train
        return settle(smote.oversampled(settle(self.train, "train"), self.design, self.slots_per_split), "oversampled")

    @cached_property
    def folded_train(self) -> DataFrame:
        """Training rows with their inner fold, stored in cell order."""
        roles = self.roles.drop("fold")
        folded = resample.with_folds(roles, resample.fold_ends(roles))
        rows = cells.cell_rows(folded, self.arrays, self.design.pos).where("in_train")
        return settle(_by_cell(rows), "folded-train")

    def widths(self) -> dict[tuple[int, int], int]:
        return {(r["slot"], r["K"]): r["n"] for r in self.arrays.select("slot", "K", F.size("idx").alias("n")).collect()}

    # --- models -------------------------------------------------------------------------

    def lda(self) -> DataFrame:
        return lda.predict(self.oversampled, self.test, self.design)

    def naive_bayes(self, weighted: bool | None = None) -> DataFrame:
        """Balanced priors belong to the classifier on its own; inside the stack priors are those of the data."""
        weighted = self.imbalanced if weighted is None else weighted
        models = settle(nb.fit_models(self.fit, self.panels, weighted), "nb")
        return nb.predict(self.test, models, self.design)

    def neighbours(self) -> DataFrame:
        if self.imbalanced:
            # synthetic rows come before scaling, so they count in the deviations
            scales = knn.scales_from_rows(self.oversampled)
        else:
            scales = knn.scales_from_fit(self.fit, self.panels)
        return knn.predict(self.oversampled, self.test, settle(scales, "scales"), self.design)

    def svm(self) -> DataFrame:
        fits = svm.fit_models(self.folded_train, self.imbalanced)
        return svm.predict(self.test, svm.model_table(self.train.sparkSession, fits), self.design)

    def forest(self) -> DataFrame:
        return forest.predict(self.train, self.test, self.design, self.imbalanced, self.trees)

    def lasso(self) -> DataFrame:
        """The l1 model on the panel, as the stack uses it."""
        if self.imbalanced:
            rows = settle(_by_cell(cells.fold_rows(self.oversampled)), "lasso-rows")
        else:
            rows = self.folded_train
        found = [(slot, slot, k, 0, n) for (slot, k), n in sorted(self.widths().items())]
        fits = lasso.fit_models(rows.withColumn("codes", F.array("fold")), found)
        return lasso.predict(self.test, lasso.model_table(rows.sparkSession, fits), self.design)

    def base_predictions(self) -> DataFrame:
        """Predictions of the six base models, stored once."""
        parts = [self.forest(), self.svm(), self.lasso(), self.neighbours(), self.lda(), self.naive_bayes(weighted=False)]
        return settle(reduce(DataFrame.unionByName, parts), "base-predictions")


def _by_cell(rows: DataFrame) -> DataFrame:
    """Rows laid out by cell: few cells per partition, and a large cell over many partitions."""
    order = ["slot", "K", "sample_ix"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def nested(outer: CellSet, folded: DataFrame) -> CellSet:
    """The inner cross-validation cells of the stack."""
    return CellSet(
        outer.design, outer.n_slots * N_FOLDS, cells.nested_slots(folded), cells.nested_panels(outer.panels),
        outer.centre, None, N_FOLDS, outer.imbalanced, outer.trees,
    )
