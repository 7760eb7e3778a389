"""Resampling and selection on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.design import Design
from panelsmith.operators import resample, selection
from panelsmith.plans.study import Study
from panelsmith.queries import sql_parts as parts
from panelsmith.queries.registry import query, rounded
from panelsmith.sources.tables import embedding_genes, embedding_samples, long_matrix as to_long

SPLITS = 20
REPS = 4


def study(spark, sf_dir, n_splits=SPLITS, rule="balanced", first_rep=0, n_reps=1, **kw) -> Study:
    design = Design(n_splits=n_splits, first_rep=first_rep, n_reps=n_reps)
    return Study(embedding_samples(spark, sf_dir, rule), design, imbalanced=rule == "imbalanced", **kw)


def keyed(df, design: Design, *columns: str):
    """Name the slot as (rep, split)."""
    return df.select(
        design.rep_of(F.col("slot")).alias("rep"), design.split_of(F.col("slot")).alias("split"), *columns
    )


@query(f"WITH {parts.samples()} SELECT sample_ix, 's' || sample_ix AS sample_id, 'g' || gene_ix AS gene, gene_ix, round(value, 6) AS value FROM long")
def long_matrix(spark, sf_dir):
    samples = embedding_samples(spark, sf_dir)
    return rounded(to_long(samples, embedding_genes(samples)), "value")


@query(f"WITH {parts.samples()} SELECT class, count(*) AS n FROM samples GROUP BY class")
def class_counts(spark, sf_dir):
    return resample.require_two_classes(embedding_samples(spark, sf_dir))


@query(f"WITH {parts.samples()} SELECT sample_ix, (class = 'Cancer')::INTEGER AS is_pos FROM samples")
def design_indicator(spark, sf_dir):
    return embedding_samples(spark, sf_dir).select(
        "sample_ix", (F.col("class") == Design().pos).cast("int").alias("is_pos")
    )


@query(f"WITH {parts.samples()}, {parts.splits(SPLITS)} SELECT rep, split, sample_ix, class, role FROM splits")
def mc_splits(spark, sf_dir):
    s = study(spark, sf_dir)
    return resample.memberships(s.roles, s.design)


@query(f"WITH {parts.samples()}, {parts.splits(100)} SELECT rep, split, class, role, count(*) AS n FROM splits GROUP BY ALL")
def mc_split_sizes(spark, sf_dir):
    s = study(spark, sf_dir, 100)
    return resample.memberships(s.roles, s.design).groupBy("rep", "split", "class", "role").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"WITH {parts.samples()}, {parts.splits(5, 1, REPS)} SELECT rep, split, sample_ix, class, role FROM splits")
def rep_splits(spark, sf_dir):
    s = study(spark, sf_dir, 5, first_rep=1, n_reps=REPS)
    return resample.memberships(s.roles, s.design)


@query(f"WITH {parts.samples()}, {parts.splits(SPLITS)}, {parts.folds()} SELECT rep, split, sample_ix, class, fold FROM folds")
def kfold(spark, sf_dir):
    s = study(spark, sf_dir)
    rows = resample.by_slot(s.folded).where("in_train")
    return keyed(rows, s.design, "sample_ix", "class", "fold")


@query(f"""WITH {parts.samples('imbalanced')}, {parts.splits(SPLITS)},
counts AS (SELECT rep, split, class, count(*) AS n FROM splits WHERE role = 'train' GROUP BY ALL)
SELECT rep, split, class, n,
       round((sum(n) OVER (PARTITION BY rep, split))::DOUBLE
             / ((count(*) OVER (PARTITION BY rep, split)) * n), 6) AS weight FROM counts""")
def balanced_weights(spark, sf_dir):
    s = study(spark, sf_dir, rule="imbalanced")
    return rounded(keyed(resample.balanced_weights(s.roles), s.design, "class", "n", "weight"), "weight")


@query(f"""WITH {parts.samples()}, {parts.splits(SPLITS)}, {parts.fit()}
SELECT rep, split, gene_ix, n1, n0, round(m1, 6) AS m1, round(m0, 6) AS m0, round(v1, 6) AS v1,
       round(v0, 6) AS v0, round(s2, 6) AS s2, round(b, 6) AS b, round(u, 6) AS u FROM fit""")
def group_fit(spark, sf_dir):
    s = study(spark, sf_dir)
    out = keyed(s.fit, s.design, "gene_ix", "n1", "n0", "m1", "m0", "v1", "v0", "s2", "b", "u")
    return rounded(out, "m1", "m0", "v1", "v0", "s2", "b", "u")


@query(f"""WITH {parts.samples('planted')}, {parts.splits(SPLITS)}, {parts.fit()}, {parts.prior()}
SELECT rep, split, d0 IS NULL AS infinite, round(s0sq, 6) AS s0sq, round(mean_e, 6) AS mean_e,
       round(evar, 6) AS evar FROM prior""")
def eb_prior(spark, sf_dir):
    s = study(spark, sf_dir, rule="planted")
    out = keyed(s.prior.withColumn("infinite", F.col("d0").isNull()), s.design, "infinite", "s0sq", "mean_e", "evar")
    return rounded(out, "s0sq", "mean_e", "evar")


@query(f"""WITH {parts.samples()}, {parts.splits(SPLITS)}, {parts.fit()}, {parts.prior()}, {parts.ranked()}
SELECT rep, split, gene_ix, round(t, 6) AS t FROM t_table""")
def moderated_t(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(keyed(s.t_table, s.design, "gene_ix", "t"), "t")


@query(f"""WITH {parts.samples('planted')}, {parts.splits(SPLITS)}, {parts.fit()}, {parts.prior()}, {parts.ranked()}
SELECT rep, split, gene_ix, round(t, 6) AS t FROM t_table""")
def moderated_t_planted(spark, sf_dir):
    s = study(spark, sf_dir, rule="planted")
    return rounded(keyed(s.t_table, s.design, "gene_ix", "t"), "t")


@query(f"""WITH {parts.selection(SPLITS)} SELECT rep, split, "K", rank, gene FROM panels""")
def topk_panels(spark, sf_dir):
    return study(spark, sf_dir).panels.select("rep", "split", "K", "rank", "gene")


@query(f"""WITH {parts.selection(SPLITS)} SELECT "K", gene, count(*) AS count FROM panels GROUP BY ALL""")
def selection_freq(spark, sf_dir):
    return selection.selection_frequency(study(spark, sf_dir).panels)


FROZEN_SQL = """
freq AS (SELECT rep, "K", gene, count(*) AS count FROM panels GROUP BY ALL),
frozen AS (
  SELECT * FROM (
    SELECT rep, "K", gene, count,
           (row_number() OVER (PARTITION BY rep, "K" ORDER BY count DESC, gene))::INTEGER AS rank FROM freq)
  WHERE rank <= "K")"""


@query(f"""WITH {parts.selection(SPLITS)}, {FROZEN_SQL} SELECT "K", rank, gene, count FROM frozen""")
def frozen_panel(spark, sf_dir):
    freq = selection.selection_frequency(study(spark, sf_dir).panels)
    return selection.frozen_panels(freq).select("K", "rank", "gene", "count")


@query(f"""WITH {parts.selection(5, 'balanced', (3, 5, 10, 25, 50, 75, 100), 1, REPS)}, {FROZEN_SQL}
SELECT rep, "K", rank, gene, count FROM frozen""")
def rep_panels(spark, sf_dir):
    s = study(spark, sf_dir, 5, first_rep=1, n_reps=REPS)
    freq = selection.selection_frequency(s.panels, "rep")
    return selection.frozen_panels(freq, "rep").select("rep", "K", "rank", "gene", "count")


@query(f"""WITH {parts.selection(SPLITS)}
SELECT "K", split, gene, rank FROM panels""")
def panel_rank_vector(spark, sf_dir):
    s = study(spark, sf_dir)
    lists = s.panels.groupBy("K", "split").agg(
        F.array_sort(F.collect_list(F.struct("rank", "gene"))).alias("ordered")
    ).select("K", "split", F.col("ordered.gene").alias("genes"))
    return selection.rank_vector(lists)
