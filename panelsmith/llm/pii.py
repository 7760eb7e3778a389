"""Personal data: fixed patterns, and terms whose co-occurrence in the corpus discloses a protected entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelsmith.llm.common import computed, same, text_key
from panelsmith.session import settle

KINDS = ("email", "ip", "card", "phone")
# The patterns as agreed, with possessive repeats, which find the same matches without going back. A run of
# characters that has no match from its start has none from its middle, unless a match ended there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, double).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def worth_a_look(kind: str, text: Column) -> Column:
    """Cheap test that every match passes."""
    if kind == "email":
        return text.contains("@")
    return text.contains("+") if kind == "phone" else text.rlike("[0-9][0-9 .-]{4}")


NONE = "cast(array() as array<struct<start:int,stop:int,found:string>>)"


def _matches(text: str | Column, kind: str) -> Column:
    """Array of (gap, m): the pieces of a text between the kind's matches, and the match after each (null after the last)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m")
    )


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (text key) and an array of (start, stop, found) for every kind, in code points; the texts are left out.

    Gaps and matches alternate, so a running sum over their lengths gives the places: matches become rows, a text has as many as
    it likes, and only valid ones are gathered again. Rows that repeat id and text have the same spans, null texts count
    as empty, an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_key(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kinds = [
        F.when(worth_a_look(k, F.col("text")), F.transform(_matches("text", k), lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"),
            F.when(x["m"].isNotNull(), valid(k, x["m"])).otherwise(F.lit(False)).alias("ok"),
            x["m"].alias("m"),
        ))).alias(k)
        for k in KINDS
    ]
    looked = settle(rows.select("doc_id", "node", *kinds), "pii-looked")
    found: DataFrame | None = None
    for k in KINDS:
        some = looked.where(F.exists(k, lambda x: x["ok"])).dropDuplicates(["doc_id", "node"])
        some = some.select("doc_id", "node", F.lit(k).alias("kind"), F.posexplode(k).alias("n", "x"))
        found = some if found is None else found.union(some)
    found = found.select("doc_id", "node", "kind", "n", "x.*")
    upto = W.partitionBy("doc_id", "node", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("stop", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto).cast("int")).where("ok")
    spans = found.groupBy("doc_id", "node", "kind").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("stop") - F.col("size")).alias("start"), "stop", F.col("m").alias("found")
    ))).alias("spans"))
    per_kind = [F.first(F.when(F.col("kind") == k, F.col("spans")), ignorenulls=True).alias(k) for k in KINDS]
    spans = spans.groupBy(F.col("doc_id").alias("i"), F.col("node").alias("k")).agg(*per_kind)
    rows = looked.select("doc_id", "node").join(spans, same(F.col("doc_id"), F.col("i")) & F.col("node").eqNullSafe(F.col("k")), "left")
    return rows.select("doc_id", "node", *[F.coalesce(k, F.expr(NONE)).alias(k) for k in KINDS])


def _normal(kind: str, found: Column) -> Column:
    return F.lower(found) if kind in ("email", "ip") else _digits(found)


#: Stands before a protected value among the words of a line; private to this module, so it is taken out of texts first.
MARK = "\ue000"
#: Hex digits of a value, and the letters that stand for them: no pattern matches in them.
LETTERS = ("0123456789ABCDEF", "abcdefghijklmnop")
#: Words on either side of a protected value that count as met by it.
REACH = 8


def _told(kind: str) -> Callable[[Column], Column]:
    """A gap and what follows it: a mark with the value for a valid match, any other match as it stands."""

    def told(x: Column) -> Column:
        value = F.concat(F.lit(f"{kind}:"), _normal(kind, x["m"]))
        mark = F.concat(F.lit(f" {MARK}"), F.translate(F.hex(F.encode(value, "UTF-8")), *LETTERS), F.lit(" "))
        return F.concat(x["gap"], F.when(x["m"].isNull(), "").when(valid(kind, x["m"]), mark).otherwise(x["m"]))

    return told


def with_words(lines: DataFrame) -> DataFrame:
    """`lines(line)` with words: in lower case, and every valid match in its place as MARK and kind:value in letters.

    Kinds are taken one after the other; a match that is not valid stays as it stands, so its words are words like any other.
    Each text is made once: the next kind looks at the finished one.
    """
    rows = lines.withColumn("marked", F.translate("line", MARK, ""))
    for kind in KINDS:
        told = F.array_join(F.transform(_matches("marked", kind), _told(kind)), "")
        rows = computed(rows, told=F.when(worth_a_look(kind, F.col("line")), told).otherwise(F.col("marked")))
        rows = rows.drop("marked").withColumnRenamed("told", "marked")
    return rows.withColumn("words", F.filter(F.split(F.lower("marked"), NOT_WORD), lambda w: w != "")).drop("marked")


def terms_of(line: Column) -> Column:
    """Distinct words of a line, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(line), NOT_WORD)), lambda w: w != "")


def disclosing_terms(
    docs: DataFrame, min_contexts: int = 3, min_bits: float = 3.0, most_left: float = 1.0, remove_left: float = 0.15,
    reach: int = REACH, text_col: str = "text",
) -> DataFrame:
    """(term, entity, contexts, share, bits, left, action): terms that give a protected entity away.

    Entities are the values of valid matches. A term meets an entity in a line if it stands within `reach` words of it. Of a term
    and an entity, share is the lines in which they meet over all lines with the term; left = -log2(share) is what the
    term leaves unknown about the entity, in bits, and bits = log2(share over the entity's share of all lines) is what it tells. A
    term discloses an entity if it tells `min_bits` or more, leaves `most_left` or less and they meet in `min_contexts`
    contexts, lines that differ beside their matches. If `remove_left` or less is left the term is removed, else it is generalised.

    All lines of all documents count, both counts on the same words of a line; repeated lines count each time but are one
    context. Null and empty texts have no lines with words; an empty table gives no terms. Counts are aggregated before they are
    shuffled, and a line gives at most 2 reach terms for each of its entities.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    look = worth_a_look("email", F.col("line")) | worth_a_look("ip", F.col("line")) | worth_a_look("phone", F.col("line"))
    # lines to look at are taken apart once; copies of one meet before anything is counted
    worded = settle(with_words(lines.where(look)).groupBy("words").agg(F.count("*").alias("n")), "pii-worded")
    marked = worded.where(F.exists("words", lambda w: w.startswith(MARK)))
    # each protected value with the words around it, once per line
    places = "filter(transform(words, (w, i) -> struct(w, i)), x -> startswith(x.w, mark))"
    around = f"filter(slice(words, greatest(e.i - {reach}, 0) + 1, {2 * reach + 1}), t -> not startswith(t, mark))"
    met = f"array_distinct(flatten(transform({places}, e -> transform({around}, t -> struct(e.w as entity, t as term)))))"
    bare = F.filter("words", lambda w: ~w.startswith(MARK))
    rows = marked.withColumn("mark", F.lit(MARK))
    pairs = rows.select(F.explode(F.expr(met)).alias("p"), F.xxhash64(bare).alias("context"), "n")
    pairs = pairs.groupBy("p.entity", "p.term", "context").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("together"))
    pairs = settle(pairs.where(F.col("contexts") >= min_contexts), "pii-pairs")
    # a line without a match to look at has its words as they stand
    plain = lines.where(~look).select(F.explode(terms_of(F.col("line"))).alias("term"), F.lit(1).cast("long").alias("n"))
    looked = worded.select(F.explode(F.array_distinct(F.filter("words", lambda w: ~w.startswith(MARK)))).alias("term"), "n")
    counts = plain.union(looked).join(pairs.select("term").distinct(), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("n").alias("lines"))
    entities = rows.select(F.explode(F.expr(f"array_distinct(transform({places}, e -> e.w))")).alias("entity"), "n")
    entities = entities.groupBy("entity").agg(F.sum("n").alias("entity_lines"))
    total = lines.count()
    out = pairs.join(counts, "term").join(entities, "entity").withColumn("share", F.col("together") / F.col("lines"))
    out = out.select(
        "term", F.decode(F.unhex(F.translate(F.expr("substring(entity, 2)"), *LETTERS[::-1])), "UTF-8").alias("entity"), "contexts", "share",
        F.log2(F.col("share") * total / F.col("entity_lines")).alias("bits"), (-F.log2("share")).alias("left"),
    )
    action = F.when(F.col("left") <= remove_left, "remove").otherwise("generalise")
    return out.where((F.col("bits") >= min_bits) & (F.col("left") <= most_left)).withColumn("action", action)


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, start, stop, found) of every occurrence of the terms, whatever their case; repeated rows are one.

    Null texts and an empty table give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("node"), F.col(text_col).alias("text"))
    rows = rows.where("text is not null").dropDuplicates(["doc_id", "node"])
    held = rows.select("doc_id", "node", F.explode(terms_of(F.col("text"))).alias("term"))
    held = held.join(terms.select("term").distinct(), "term", "left_semi").select("doc_id", "node").distinct()
    held = held.select(F.col("doc_id").alias("i"), F.col("node").alias("k"))
    hit = rows.join(held, same(F.col("doc_id"), F.col("i")) & (F.col("node") == F.col("k")), "left_semi")
    parts = F.arrays_zip(
        F.split("text", WORD, -1).alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word")
    )
    words = hit.select("doc_id", "node", F.posexplode(parts).alias("n", "p"))
    words = words.select("doc_id", "node", "n", F.length("p.gap").alias("gap"), F.col("p.word").alias("word"))
    upto = W.partitionBy("doc_id", "node").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.coalesce(F.length("word"), F.lit(0))).over(upto)
    words = words.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.length("word"))
    words = words.withColumn("term", F.lower("word")).where("term is not null")
    words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return words.select("doc_id", "node", "start", "stop", F.col("word").alias("found"))


def sensitive_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, **how
) -> DataFrame:
    """One row per document: doc_id, node, an array of (start, stop, found) per kind, and the same for terms.

    Spans are in code points of the text, ends exclusive. Base kinds are searched apart from each other; terms inside of a
    base span are left out. Null texts count as empty. Rows that repeat id and text have the same spans. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = settle(base_spans(docs, id_col, text_col), "pii-base")
    if terms is None:
        terms = settle(disclosing_terms(docs, text_col=text_col, **how), "pii-terms")
    none = F.expr(NONE)
    if terms.isEmpty():
        return rows.withColumn("term", none)
    found = term_spans(docs, terms, id_col, text_col)
    found = found.groupBy(F.col("doc_id").alias("i"), F.col("node").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "found"))).alias("terms")
    )
    rows = rows.join(found, same(F.col("doc_id"), F.col("i")) & (F.col("node") == F.col("k")), "left")
    base = F.flatten(F.array(*KINDS))
    outside = F.filter(
        F.coalesce("terms", none),
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    return rows.withColumn("base", base).select("doc_id", "node", *KINDS, outside.alias("term"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:stop of all spans, by kind as given, then start, with commas."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))

    return F.array_join(F.flatten(F.array(*map(of, kinds))), ",")


def generalised(word: Column) -> Column:
    """The class that stands for a disclosing term: [number] of digits, [code] with digits, [name] with a capital first, else [word]."""
    return (
        F.when(word.rlike(r"^[0-9]+$"), "[number]").when(word.rlike("[0-9]"), "[code]")
        .when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with base spans replaced by their kind, and disclosing terms replaced by their class or removed.

    All columns stay. Spans that overlap become one, marked like the first of them, or the longer of two that begin together. Null and empty texts stay as they are,
    rows that repeat id and text are treated alike, an empty table gives an empty result. A text is rebuilt from
    its characters' places once, whatever the number of its spans.
    """
    names = docs.columns
    terms = settle(disclosing_terms(docs, text_col=text_col, **how), "pii-terms")
    spans = settle(sensitive_spans(docs, id_col, text_col, terms=terms), "pii-spans")
    removed = terms.groupBy("term").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"[{kind}]").alias("mark"), s["found"].alias("found")
        ))

    marks = F.flatten(F.array(*map(marked, (*KINDS, "term"))))
    flat = spans.dropDuplicates(["doc_id", "node"]).select("doc_id", "node", F.explode(marks).alias("m"))
    flat = flat.select("doc_id", "node", "m.*")
    # spans that overlap become one
    order = W.partitionBy("doc_id", "node").orderBy("start", F.desc("stop"), "mark")
    done = F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    flat = flat.withColumn("new", (F.col("start") >= done).cast("int"))
    flat = flat.withColumn("piece", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.struct("start", (-F.col("stop")).alias("back"), "mark", "found"))
    flat = flat.groupBy("doc_id", "node", "piece").agg(first.alias("x"), F.max("stop").alias("stop"))
    flat = flat.select("doc_id", "node", "x.start", "stop", "x.mark", "x.found", F.lower("x.found").alias("key"))
    gone = removed.select(F.col("term").alias("key"), F.lit("[term]").alias("mark"), "gone")
    flat = flat.join(gone, ["key", "mark"], "left")
    mark = F.when(F.col("mark") != "[term]", F.col("mark")).when(F.col("gone") == 1, "").otherwise(generalised(F.col("found")))
    edits = flat.withColumn("mark", mark).groupBy("doc_id", "node").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "mark"))).alias("edits")
    )
    edits = edits.select(F.col("doc_id").alias("__llm_id"), F.col("node").alias("__llm_key"), F.col("edits").alias("__llm_edits"))
    on = same(F.col(id_col), F.col("__llm_id")) & (text_key(text_col) == F.col("__llm_key"))
    rows = docs.join(edits, on, "left").withColumnRenamed(text_col, "__llm_text")
    # UTF-32 has four bytes a character, so a piece is found without counting from the start
    piece = "decode(substring(w, 4 * {a} + 1, 4 * ({b} - {a})), 'UTF-32')"
    before = piece.format(a="if(i = 0, 0, __llm_edits[i - 1].stop)", b="e.start")
    rest = piece.format(a="__llm_edits[size(__llm_edits) - 1].stop", b="(length(w) div 4)")
    text = F.expr(f"""
        case when __llm_edits is null then __llm_text else transform(array(encode(__llm_text, 'UTF-32')), w -> concat(
            array_join(transform(__llm_edits, (e, i) -> concat({before}, e.mark)), ''), {rest}))[0] end
    """)
    return rows.withColumn(text_col, text).select(names)
