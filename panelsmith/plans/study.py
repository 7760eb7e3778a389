"""One study over one sample table: tables that several jobs share, built once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, cached_property

from pyspark.sql import DataFrame, functions as F

from panelsmith.design import Design, K_LIST
from panelsmith.operators import cells, metrics, resample, selection
from panelsmith.operators.models import forest, lasso, stack
from panelsmith.plans.evaluation import CellSet, nested
from panelsmith.session import settle, spread
from panelsmith.sources.tables import embedding_genes


class Study:
    """Splits, rankings and panels of `samples` under a design.

    Rankings are computed once for the largest panel and cut for every K; the
    same splits serve selection, fitting and scoring.
    """

    def __init__(
        self,
        samples: DataFrame,
        design: Design,
        k_list: Sequence[int] = K_LIST,
        genes: DataFrame | None = None,
        imbalanced: bool = False,
        trees: int = forest.TREES,
    ) -> None:
        self.samples = spread(samples, "samples")
        self.design = design
        self.k_list = tuple(k_list)
        self.imbalanced = imbalanced
        self.trees = trees
        self.genes = genes if genes is not None else embedding_genes(samples)

    @cached_property
    def any_features(self) -> list[float]:
        """The features of some one sample."""
        return self.samples.select("features").first()["features"]

    @property
    def n_features(self) -> int:
        return len(self.any_features)

    @cached_property
    def cuts(self) -> DataFrame:
        return resample.split_cuts(self.samples, self.design)

    @cached_property
    def roles(self) -> DataFrame:
        return resample.with_roles(self.samples, self.cuts, self.design)

    @cached_property
    def fold_ends(self) -> DataFrame:
        return resample.fold_ends(self.roles)

    @cached_property
    def folded(self) -> DataFrame:
        return resample.with_folds(self.roles, self.fold_ends)

    @cached_property
    def fit(self) -> DataFrame:
        moments = selection.group_moments(self.roles, self.design, self.any_features)
        return settle(selection.pooled_variance(moments), "fit")

    @cached_property
    def prior(self) -> DataFrame:
        return selection.variance_prior(self.fit)

    @cached_property
    def t_table(self) -> DataFrame:
        return selection.moderated_t(self.fit, self.prior)

    @cached_property
    def ranking(self) -> DataFrame:
        """(slot, rank, gene_ix, gene, t) down to the largest panel."""
        top = selection.rank_features(self.t_table, max(self.k_list))
        return settle(
            top.join(self.genes, "gene_ix").select("slot", "rank", "gene_ix", "gene", "t"), "ranking"
        )

    @cached_property
    def panels(self) -> DataFrame:
        """(rep, split, K, rank, gene_ix, gene, slot): the panel of every split and size."""
        return selection.cut_panels(self.ranking, self.k_list).select(
            self.design.rep_of(F.col("slot")).alias("rep"),
            self.design.split_of(F.col("slot")).alias("split"),
            "K", "rank", "gene_ix", "gene", "slot",
        )

    # --- evaluation ---------------------------------------------------------------------

    @cached_property
    def frozen(self) -> DataFrame:
        """(K, rank, gene, count): the fixed panels of stage 2."""
        return settle(selection.frozen_panels(selection.selection_frequency(self.panels)), "frozen")

    @cached_property
    def stage2_panels(self) -> DataFrame:
        """The fixed panels laid out for every slot."""
        slots = F.explode(F.sequence(F.lit(0), F.lit(self.design.n_slots - 1))).alias("slot")
        return self.frozen.join(self.genes, "gene").select(slots, "K", "rank", "gene_ix", "gene")

    @cache
    def cells(self, stage: int = 1) -> CellSet:
        """Stage 1 evaluates each split's own panels, stage 2 the frozen ones."""
        return CellSet(
            self.design, self.design.n_slots, self.roles, self.panels if stage == 1 else self.stage2_panels,
            self.any_features, self.fit, imbalanced=self.imbalanced, trees=self.trees,
        )

    def lasso_all_features(self) -> DataFrame:
        """The l1 model on all features; the same for every K and both stages, so fitted once per slot (K = 0)."""
        arrays = cells.all_features(self.n_features, self.design, self.samples.sparkSession)
        if self.imbalanced:
            every = CellSet(self.design, self.design.n_slots, self.roles, arrays.select(
                "slot", "K", F.posexplode("idx").alias("rank", "gene_ix")
            ), self.any_features, self.fit, imbalanced=True)
            return every.lasso()
        rows = settle(lasso.shared_rows(self.folded, self.design.pos), "lasso-rows")
        found = [(slot, -1, 0, slot, self.n_features) for slot in range(self.design.n_slots)]
        models = lasso.model_table(rows.sparkSession, lasso.fit_models(rows, found))
        test = cells.cell_rows(self.roles, arrays, self.design.pos).where("not in_train")
        return lasso.predict(test, models, self.design)

    def super_learner(self, stage: int = 1) -> tuple[DataFrame, DataFrame]:
        """(predictions of the stack and its base models, ensemble weights)."""
        outer = self.cells(stage)
        fits = stack.fit_meta(nested(outer, self.folded).base_predictions(), self.design)
        base = outer.base_predictions()
        stacked = stack.predict(base, fits, self.design)
        return base.unionByName(stacked), stack.weights(base.sparkSession, fits)

    def split_metrics(self, predictions: DataFrame) -> DataFrame:
        """(model, rep, split, K, MCE, Sensitivity, Specificity)."""
        counts = metrics.confusion(predictions, ["model", "slot", "K"], self.design.pos, self.design.neg)
        return metrics.split_metrics(counts).select(
            "model",
            self.design.rep_of(F.col("slot")).alias("rep"),
            self.design.split_of(F.col("slot")).alias("split"),
            "K", "MCE", "Sensitivity", "Specificity",
        )
