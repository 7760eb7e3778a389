"""Host-level quality rules: rule failures by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import computed, same, spread_join, text_key
from panelsmith.session import settle

#: White space between words: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


#: Hashes of all windows of three words.
_WINDOWS = """
    case when size(hashes) < 3 then array() else
        slice(transform(hashes, (x, i) -> xxhash64(x, get(hashes, i + 1), get(hashes, i + 2))), 1, size(hashes) - 2) end
"""
#: Windows with their places, by hash; none if all differ.
_SORTED = """
    case when size(array_distinct(windows)) = size(windows) then cast(array() as array<struct<h: bigint, i: int>>)
        else sort_array(transform(windows, (x, i) -> struct(x as h, i as i))) end
"""
#: Places of windows that occur twice or more: their neighbours are equal.
_REPEATED = """
    sort_array(transform(
        filter(sorted, (x, j) -> coalesce(get(sorted, j - 1).h = x.h, false) or coalesce(get(sorted, j + 1).h = x.h, false)),
        x -> x.i
    ))
"""
#: Words that these windows cover.
_COVERED = "aggregate(transform(places, (x, j) -> least(3, coalesce(get(places, j + 1) - x, 3))), 0L, (n, x) -> n + x)"


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, node (text key), host and the counts that the rules look at, for every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_key(text_col).alias("node"), F.col(host_col).alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.regexp_count("text", F.lit(SYMBOLS)).cast("long")
    rows = computed(rows, words=words(F.col("text")), lines=lines, n_symbols=symbols).drop("text")
    rows = computed(
        rows, hashes=F.expr("transform(words, x -> xxhash64(x))"), n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
    ).drop("words")
    rows = computed(rows, windows=F.expr(_WINDOWS)).drop("hashes")
    rows = computed(rows, sorted=F.expr(_SORTED)).drop("windows")
    rows = computed(rows, places=F.expr(_REPEATED)).drop("sorted")
    return rows.select(
        "doc_id", "node", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"), F.size("lines").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def other_failed() -> Column:
    """Rules that count against a host: more than a symbol for every four words, or most lines repeated."""
    return (4 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failures, rate, spread, pooled): rates shrunk towards the hosts' common mean by a beta prior.

    The prior's mean is the pooled rate, its strength follows from the spread of the hosts beyond that of
    binomial draws (method of moments, at least one document's worth). `rate` and `spread` are mean and standard deviation of a
    host's beta posterior. `rows` has host and failed; rows without a host are left out. An empty table gives no hosts.
    """
    hosts = rows.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    hosts = settle(hosts, "hosts")
    total = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failures").alias("f"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("ff"),
    ).first()
    alpha = beta = mean = 0.5
    if total["n"]:
        mean = total["f"] / total["n"]
        noise = mean * (1 - mean)
        spread = total["ff"] / total["n"] - mean * mean - noise * total["hosts"] / total["n"]
        strength = min(max(noise / spread - 1, 1.0), 1e9) if spread > 0 else 1e9
        if noise > 0:
            alpha, beta = mean * strength, (1 - mean) * strength
        else:
            alpha, beta = (mean + 1e-9), (1 - mean + 1e-9)
    weight = F.col("n") + F.lit(alpha + beta)
    rate = (F.col("failures") + F.lit(alpha)) / weight
    hosts = hosts.withColumn("rate", rate).withColumn("spread", F.sqrt(rate * (1 - rate) / (weight + 1)))
    return hosts.withColumn("pooled", F.lit(float(mean)))


def surely_above(times: float, sigmas: float) -> Column:
    """Whether a host's failure rate is above `times` the pooled one for all but the last `sigmas` of its posterior (normal approximation).

    A pooled rate of which `times` is 1 or more leaves no host above it.
    """
    return (F.col("rate") - sigmas * F.col("spread")) > times * F.col("pooled")


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    reject_times: float = 2.5, doubt_times: float = 1.25, sigmas: float = 3.0,
) -> DataFrame:
    """One row per document: its counts, whether a base rule fails, its host's shrunk failure rate and verdict, and whether it is kept.

    A document that fails a base rule goes. Hosts are judged against the pooled failure rate of the corpus: all documents of a
    host go (`reject`) if its rate is surely above `reject_times` of that, those that fail another rule themselves go (`doubt`) if
    it is surely above `doubt_times`; sure means `sigmas` posterior deviations. Small hosts have wide posteriors and are
    left alone. A document without a host is judged by the base rules alone (null verdict). Null and empty texts have no words, so they fail. Equal rows get equal verdicts; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = settle(features(docs, id_col, text_col, host_col), "quality")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("other_failed", other_failed())
    rates = host_rates(rows.select("host", (F.col("base_failed") | F.col("other_failed")).alias("failed")))
    verdict = F.when(surely_above(reject_times, sigmas), "reject").when(surely_above(doubt_times, sigmas), "doubt").otherwise("accept")
    # a row per host: heavy hosts stay where they are
    hosts = settle(rates.select("host", F.col("rate").alias("host_rate"), verdict.alias("host_verdict")), "host-verdicts")
    rows = spread_join(rows, hosts, "host", "left")
    given = F.coalesce("host_verdict", F.lit("accept"))
    verdict = (given == "accept") | ((given == "doubt") & ~F.col("other_failed"))
    return rows.select(
        "doc_id", "node", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"), "host_rate", "host_verdict",
    )


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **how) -> DataFrame:
    """The documents that `host_quality` keeps, with all their columns; null and empty texts go, repeated rows share their verdict.

    An empty table gives an empty result.
    """
    kept = host_quality(docs, id_col, text_col, host_col, **how).where("kept")
    kept = kept.select(F.col("doc_id").alias("__llm_id"), F.col("node").alias("__llm_key")).distinct()
    on = same(F.col(id_col), F.col("__llm_id")) & (text_key(text_col) == F.col("__llm_key"))
    return docs.join(kept, on, "left_semi")
