"""SQL building blocks shared by the oracles: each part is one or more named CTEs.

The SQL states the definitions directly (a row number over a whole group, one
row per sample, split and feature), not the way the Spark jobs compute them.
"""

from __future__ import annotations

POSITIVE_RULES = {
    "balanced": "label >= 5",
    "imbalanced": "label = 0",
    "planted": "embedding[1]::DOUBLE + embedding[2]::DOUBLE + 0.5::DOUBLE * embedding[3]::DOUBLE > 0",
}


def samples(rule: str = "balanced") -> str:
    return f"""
samples AS (
  SELECT vec_id AS sample_ix, 's' || vec_id AS sample_id,
         CASE WHEN {POSITIVE_RULES[rule]} THEN 'Cancer' ELSE 'Control' END AS class,
         embedding::DOUBLE[] AS features
  FROM embeddings),
long AS (
  SELECT sample_ix, class, (unnest(range(len(features))))::INTEGER AS gene_ix, unnest(features) AS value
  FROM samples)"""


def quotas() -> str:
    return """
shares AS (
  SELECT class, n, total, total - ceil(0.33::DOUBLE * total)::BIGINT AS n_train
  FROM (SELECT class, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM samples GROUP BY class)),
quotas AS (
  SELECT class, n,
         (n_train * n) // total
         + CASE WHEN row_number() OVER (ORDER BY (n_train * n) % total DESC, class)
                     <= n_train - (sum((n_train * n) // total) OVER ())::BIGINT THEN 1 ELSE 0 END AS quota
  FROM shares)"""


def splits(n_splits: int, first_rep: int = 0, n_reps: int = 1) -> str:
    return f"""{quotas()},
drawn AS (
  SELECT r.rep::INTEGER AS rep, s.split::INTEGER AS split, sample_ix, class,
         row_number() OVER (PARTITION BY r.rep, s.split, class
           ORDER BY md5((42 + r.rep) || '|' || s.split || '|' || sample_ix), sample_ix) AS pos
  FROM samples, range({first_rep}, {first_rep + n_reps}) AS r(rep), range(1, {n_splits + 1}) AS s(split)),
splits AS (
  SELECT rep, split, sample_ix, class, CASE WHEN pos <= quota THEN 'train' ELSE 'test' END AS role
  FROM drawn JOIN quotas USING (class))"""


def folds() -> str:
    """Inner 5-fold assignment of the training rows, classes in order of first appearance."""
    return """
train_rows AS (
  SELECT rep, split, class, sample_ix,
         row_number() OVER (PARTITION BY rep, split, class ORDER BY sample_ix) - 1 AS rank0,
         count(*) OVER (PARTITION BY rep, split, class) AS n_class,
         min(sample_ix) OVER (PARTITION BY rep, split, class) AS first_ix
  FROM splits WHERE role = 'train'),
laid_out AS (
  SELECT rep, split, class, sample_ix, rank0,
         row_number() OVER (PARTITION BY rep, split ORDER BY first_ix, sample_ix) - 1 AS p
  FROM train_rows),
alloc AS (
  SELECT rep, split, class, p % 5 AS fold, count(*) AS cells FROM laid_out GROUP BY ALL),
upto AS (
  SELECT rep, split, class, fold,
         sum(cells) OVER (PARTITION BY rep, split, class ORDER BY fold) AS filled FROM alloc),
folds AS (
  SELECT t.rep, t.split, t.class, t.sample_ix, min(u.fold)::INTEGER AS fold
  FROM train_rows t JOIN upto u USING (rep, split, class)
  WHERE u.filled > t.rank0
  GROUP BY ALL)"""


def fit() -> str:
    return """
moments AS (
  SELECT rep, split, gene_ix,
         count(*) FILTER (class = 'Cancer') AS n1, count(*) FILTER (class <> 'Cancer') AS n0,
         avg(value) FILTER (class = 'Cancer') AS m1, avg(value) FILTER (class <> 'Cancer') AS m0,
         var_samp(value) FILTER (class = 'Cancer') AS v1, var_samp(value) FILTER (class <> 'Cancer') AS v0
  FROM splits JOIN long USING (sample_ix, class) WHERE role = 'train' GROUP BY rep, split, gene_ix),
fit AS (
  SELECT *, (n1 + n0 - 2)::DOUBLE AS df,
         ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS s2,
         m1 - m0 AS b, sqrt(1::DOUBLE / n1 + 1::DOUBLE / n0) AS u
  FROM moments)"""


def _recurrence(x: str, power: int) -> str:
    return " + ".join(f"1::DOUBLE / pow({x} + {i}, {power})" for i in range(6))


def sql_digamma(x: str) -> str:
    z = f"({x} + 6)"
    return (
        f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4))"
        f" - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - 1 / (132 * pow({z}, 10))"
        f" - ({_recurrence(x, 1)}))"
    )


def sql_trigamma(x: str) -> str:
    z = f"({x} + 6)"
    return (
        f"(1 / {z} + 1 / (2 * pow({z}, 2)) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5))"
        f" + 1 / (42 * pow({z}, 7)) - 1 / (30 * pow({z}, 9)) + 5 / (66 * pow({z}, 11))"
        f" + ({_recurrence(x, 2)}))"
    )


def sql_tetragamma(x: str) -> str:
    z = f"({x} + 6)"
    return (
        f"(-1 / pow({z}, 2) - 1 / pow({z}, 3) - 1 / (2 * pow({z}, 4)) + 1 / (6 * pow({z}, 6))"
        f" - 1 / (6 * pow({z}, 8)) + 3 / (10 * pow({z}, 10)) - 5 / (6 * pow({z}, 12))"
        f" - 2 * ({_recurrence(x, 3)}))"
    )


def prior() -> str:
    parts = [f"""
floors AS (
  SELECT rep, split, quantile_cont(s2, 0.5) AS med FROM fit GROUP BY rep, split),
floored AS (
  SELECT rep, split, df, greatest(s2, 1e-5::DOUBLE * CASE WHEN med = 0 THEN 1 ELSE med END) AS x
  FROM fit JOIN floors USING (rep, split)),
spread AS (
  SELECT rep, split, any_value(df) / 2 AS h, avg(x) AS mean_x, avg(ln(x)) AS mean_z, var_samp(ln(x)) AS var_z
  FROM floored GROUP BY rep, split),
evars AS (
  SELECT rep, split, mean_x, mean_z - {sql_digamma('h')} + ln(h) AS mean_e, var_z - {sql_trigamma('h')} AS evar
  FROM spread),
newton0 AS MATERIALIZED (
  SELECT *, CASE WHEN evar > 0 THEN 0.5::DOUBLE + 1 / evar END AS y FROM evars)"""]
    for i in range(1, 9):
        parts.append(f"""
newton{i} AS MATERIALIZED (
  SELECT rep, split, mean_x, mean_e, evar,
         y + tri * (1 - tri / evar) / {sql_tetragamma('y')} AS y
  FROM (SELECT *, {sql_trigamma('y')} AS tri FROM newton{i - 1}))""")
    parts.append(f"""
prior AS (
  SELECT rep, split, 2 * h0 AS d0, mean_e, evar,
         CASE WHEN h0 IS NULL THEN mean_x ELSE exp(mean_e + {sql_digamma('h0')} - ln(h0)) END AS s0sq
  FROM (SELECT *, CASE WHEN evar > 1e7 THEN 1 / sqrt(evar) WHEN evar > 0 AND evar < 1e-6 THEN 1 / evar
                       ELSE y END AS h0 FROM newton8))""")
    return ",".join(parts)


def ranked() -> str:
    return """
t_table AS (
  SELECT rep, split, gene_ix, 'g' || gene_ix AS gene,
         b / (u * sqrt(CASE WHEN d0 IS NULL THEN s0sq ELSE (d0 * s0sq + df * s2) / (d0 + df) END)) AS t
  FROM fit JOIN prior USING (rep, split)),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY rep, split ORDER BY abs(t) DESC, gene_ix))::INTEGER AS rank
  FROM t_table)"""


def panels(k_list=(3, 5, 10, 25, 50, 75, 100)) -> str:
    values = ", ".join(f"({k})" for k in k_list)
    return f"""
ks AS (SELECT k::INTEGER AS "K" FROM (VALUES {values}) AS v(k)),
panels AS (SELECT rep, split, "K", rank, gene_ix, gene FROM ranked JOIN ks ON rank <= "K")"""


def selection(n_splits: int, rule: str = "balanced", k_list=(3, 5, 10, 25, 50, 75, 100),
              first_rep: int = 0, n_reps: int = 1) -> str:
    return ",".join([
        samples(rule), splits(n_splits, first_rep, n_reps), fit(), prior(), ranked(), panels(k_list)
    ])


# --- models ---------------------------------------------------------------------------------

POPULATION = """
pop AS (
  SELECT *, (n1 * (p1 + pow(m1 - mean, 2)) + n0 * (p0 + pow(m0 - mean, 2))) / (n1 + n0) AS p
  FROM (SELECT rep, split, gene_ix, n1, n0, m1, m0, v1 * (n1 - 1) / n1 AS p1, v0 * (n0 - 1) / n0 AS p0,
               (n1 * m1 + n0 * m0) / (n1 + n0) AS mean FROM fit))"""


def naive_bayes(panels: str = "panels", balanced: bool = False, name: str = "nb_pred") -> str:
    prior = "0::DOUBLE" if balanced else "ln(any_value(n1)::DOUBLE / any_value(n0))"
    return f"""
{name}_cell AS (
  SELECT rep, split, "K", gene_ix, n1, n0, m1, m0, p1 + eps AS p1, p0 + eps AS p0
  FROM (SELECT *, 1e-9::DOUBLE * max(p) OVER (PARTITION BY rep, split, "K") AS eps
        FROM (SELECT rep, split, "K", gene_ix FROM {panels}) JOIN pop USING (rep, split, gene_ix))),
{name}_score AS (
  SELECT rep, split, "K", sample_ix, class,
         {prior} + sum((-0.5::DOUBLE * ln(p1) - pow(value - m1, 2) / (2 * p1))
                       - (-0.5::DOUBLE * ln(p0) - pow(value - m0, 2) / (2 * p0))) AS score
  FROM {name}_cell JOIN long USING (gene_ix) JOIN splits USING (rep, split, sample_ix, class)
  WHERE role = 'test' GROUP BY rep, split, "K", sample_ix, class),
{name} AS (
  SELECT 'DLDA' AS model, rep, split, "K", sample_ix, class, 1 / (1 + exp(-score)) AS p_pos,
         CASE WHEN 1 / (1 + exp(-score)) >= 0.5 THEN 'Cancer' ELSE 'Control' END AS predicted
  FROM {name}_score)"""


def neighbours(panels: str = "panels", name: str = "knn_pred") -> str:
    return f"""
{name}_vec AS (
  SELECT rep, split, "K", sample_ix, class, role,
         list(value / CASE WHEN p = 0 THEN 1 ELSE sqrt(p) END ORDER BY rank) AS v
  FROM (SELECT rep, split, "K", rank, gene_ix FROM {panels}) JOIN pop USING (rep, split, gene_ix)
       JOIN long USING (gene_ix) JOIN splits USING (rep, split, sample_ix, class)
  GROUP BY rep, split, "K", sample_ix, class, role),
{name}_near AS (
  SELECT q.rep, q.split, q."K", q.sample_ix, q.class, t.class AS near_class, list_distance(q.v, t.v) AS d,
         row_number() OVER (PARTITION BY q.rep, q.split, q."K", q.sample_ix
                            ORDER BY list_distance(q.v, t.v), t.sample_ix) AS nth
  FROM {name}_vec q JOIN {name}_vec t
    ON q.rep = t.rep AND q.split = t.split AND q."K" = t."K" AND q.role = 'test' AND t.role = 'train'),
{name}_vote AS (
  SELECT rep, split, "K", sample_ix, class,
         CASE WHEN min(d) = 0 THEN sum(CASE WHEN d = 0 AND near_class = 'Cancer' THEN 1.0::DOUBLE ELSE 0 END) / sum(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END)
              ELSE sum(CASE WHEN near_class = 'Cancer' THEN 1 / d ELSE 0 END) / sum(1 / d) END AS p_pos
  FROM {name}_near WHERE nth <= 3 GROUP BY rep, split, "K", sample_ix, class),
{name} AS (
  SELECT 'kNN' AS model, rep, split, "K", sample_ix, class, p_pos,
         CASE WHEN p_pos >= 0.5 THEN 'Cancer' ELSE 'Control' END AS predicted FROM {name}_vote)"""


def discriminant(panels: str = "panels", name: str = "lda_pred") -> str:
    """Pooled covariance of the panel, solved by elimination without exchanges (it is positive definite); needs WITH RECURSIVE."""
    return f"""
{name}_centred AS (
  SELECT rep, split, sample_ix, gene_ix, value - CASE WHEN class = 'Cancer' THEN m1 ELSE m0 END AS c
  FROM long JOIN splits USING (sample_ix, class) JOIN fit USING (rep, split, gene_ix) WHERE role = 'train'),
{name}_scatter AS (
  SELECT a.rep, a.split, a.gene_ix AS ga, b.gene_ix AS gb, sum(a.c * b.c) AS s
  FROM {name}_centred a JOIN {name}_centred b USING (rep, split, sample_ix) GROUP BY ALL),
{name}_rows AS (
  SELECT p.rep, p.split, p."K", p.rank, p.gene_ix, list(s ORDER BY q.rank) AS line
  FROM {panels} p JOIN {panels} q ON p.rep = q.rep AND p.split = q.split AND p."K" = q."K"
       JOIN {name}_scatter c ON c.rep = p.rep AND c.split = p.split AND ga = p.gene_ix AND gb = q.gene_ix
  GROUP BY ALL),
{name}_system AS (
  SELECT rep, split, "K", count(*) AS width, any_value(n1) AS n1, any_value(n0) AS n0, list((m1 + m0) / 2 ORDER BY rank) AS middle,
         list(list_append(list_transform(line, lambda v: v / (n1 + n0 - 2)), m1 - m0) ORDER BY rank) AS m
  FROM {name}_rows JOIN fit USING (rep, split, gene_ix) GROUP BY rep, split, "K"),
{name}_test AS (
  SELECT rep, split, "K", sample_ix, class, list(value ORDER BY rank) AS v
  FROM (SELECT rep, split, "K", rank, gene_ix FROM {panels}) JOIN long USING (gene_ix) JOIN splits USING (rep, split, sample_ix, class)
  WHERE role = 'test' GROUP BY ALL),
{eliminated(name)}"""


def eliminated(name: str) -> str:
    """Predictions of {name}_test(rep, split, K, sample_ix, class, v) from the systems {name}_system(rep, split, K, width, n1, n0, middle, m)."""
    return f"""
{name}_solved AS (
  SELECT rep, split, "K", width, 1::BIGINT AS i, m FROM {name}_system
  UNION ALL
  SELECT rep, split, "K", width, i + 1,
         list_transform(m, lambda line, j: CASE WHEN j = i THEN list_transform(line, lambda v: v / line[i])
             ELSE list_transform(list_zip(line, m[i]), lambda z: z[1] - line[i] / m[i][i] * z[2]) END)
  FROM {name}_solved WHERE i <= width),
{name}_model AS (
  SELECT rep, split, "K", n1, n0, middle, list_transform(s.m, lambda line: line[width + 1]) AS w
  FROM (SELECT rep, split, "K", m FROM {name}_solved WHERE i = width + 1) s JOIN {name}_system t USING (rep, split, "K")),
{name}_score AS (
  SELECT rep, split, "K", sample_ix, class, ln(n1::DOUBLE / n0) + list_dot_product(w, v) - list_dot_product(w, middle) AS score
  FROM {name}_test JOIN {name}_model USING (rep, split, "K")),
{name} AS (
  SELECT 'LDA' AS model, rep, split, "K", sample_ix, class, 1 / (1 + exp(-score)) AS p_pos,
         CASE WHEN 1 / (1 + exp(-score)) >= 0.5 THEN 'Cancer' ELSE 'Control' END AS predicted FROM {name}_score)"""


def metrics(predictions: str, name: str = "metrics") -> str:
    return f"""
{name}_counts AS (
  SELECT model, rep, split, "K",
         count(*) FILTER (class = 'Cancer' AND predicted = 'Cancer') AS tp,
         count(*) FILTER (class = 'Control' AND predicted = 'Control') AS tn,
         count(*) FILTER (class = 'Control' AND predicted = 'Cancer') AS fp,
         count(*) FILTER (class = 'Cancer' AND predicted = 'Control') AS fn,
         count(*) AS rows
  FROM {predictions} GROUP BY model, rep, split, "K"),
{name} AS (
  SELECT model, rep, split, "K", 1 - (tp + tn)::DOUBLE / rows AS "MCE",
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS "Sensitivity",
         CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END AS "Specificity"
  FROM {name}_counts)"""


SUMMARY_COLUMNS = """
  round(avg("MCE"), 6) AS "MCE_mean", round(stddev_samp("MCE") / sqrt(count(*)), 6) AS "MCE_se",
  round(avg("Sensitivity"), 6) AS "Sens_mean", round(stddev_samp("Sensitivity") / sqrt(count(*)), 6) AS "Sens_se",
  round(avg("Specificity"), 6) AS "Spec_mean", round(stddev_samp("Specificity") / sqrt(count(*)), 6) AS "Spec_se\""""
