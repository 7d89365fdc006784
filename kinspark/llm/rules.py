"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is a boolean expression on the text's statistics, with the steps that it
takes on a row. One job over a sample, chosen by a hash of each row, estimates each rule's cost (mean steps,
weighted by their measured time) and selectivity (share that it rejects); rules then
run in order of rejections per cost, and a document that one rejects isn't shown to
the rest. The order changes time, never the verdict, and one table always gives one order.

Defined results: null and empty texts have no words and fail the base rule;
null doc_ids and repeated rows are kept as they are; an empty table gives no
rows; other columns are ignored by ``measure`` and carried by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS, SEED = 2000, 17
WINDOW = 5
_P = "__rule_"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL on __rule_text, __rule_words, n_words and word_chars. ``work``: SQL for the nanoseconds
    that it takes on a row; the factors per word and character were measured on 100,000 documents, one rule a
    job with counts at hand, and only their proportions matter."""

    name: str
    rejects: str
    work: str = "1"


#: Marks and bars between words, shouting, odd word lengths, few letters, repeated words and lines.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words", "20"),
    Rule("bangs", f"size(filter({_P}words, w -> w LIKE '%!!')) * 10 > n_words * 3", "220 * n_words"),
    Rule("capitals", f"size(filter({_P}words, w -> w = upper(w) AND w <> lower(w) AND char_length(w) > 1)) * 2 > n_words", "540 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "20"),
    Rule("few_letters", f"char_length(regexp_replace({_P}text, '[^\\\\p{{L}}]+', '')) * 2 < word_chars", "70 * char_length(__rule_text)"),
    # The share of different words that is too small falls with length, as texts repeat words the longer they are: a tenth, or the root of ten words to the word.
    Rule("same_word", f"size(array_distinct({_P}words)) * 10 < n_words AND bigint(size(array_distinct({_P}words))) * size(array_distinct({_P}words)) < 10 * n_words", "450 * n_words"),
    Rule("stutter", f"size(filter({_P}words, (w, i) -> coalesce(w = get({_P}words, i - 1), false))) * 10 > n_words * 3", "470 * n_words"),
    Rule("same_line", "n_dup_lines * 2 > n_lines", "20"),
)


def with_words(docs: DataFrame) -> DataFrame:
    """Adds the text without null and its words."""
    white = F.lit(" \t\n\x0b\x0c\r")
    return (
        docs.withColumn(f"{_P}text", F.coalesce("text", F.lit("")))
        .withColumn(f"{_P}trim", F.trim(f"{_P}text", white))
        .withColumn(f"{_P}words", F.when(F.col(f"{_P}trim") == "", F.array().cast("array<string>")).otherwise(F.split(f"{_P}trim", WHITE)))
    )


def with_counts(df: DataFrame) -> DataFrame:
    """Adds the cheap counts: words, their characters, symbols, lines and repeated lines."""
    lines = F.filter(F.split(f"{_P}text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        df.withColumn("n_words", F.size(f"{_P}words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join(f"{_P}words", "")).cast("long"))
        .withColumn("n_symbols", F.char_length(F.regexp_replace(f"{_P}text", r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn(f"{_P}lines", lines)
        .withColumn("n_lines", F.size(f"{_P}lines").cast("long"))
        .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct(f"{_P}lines")))
    )


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in five-word windows found twice or more, the first included.

    Windows are 64-bit hashes of word hashes; where all differ, nothing more is
    done. Otherwise equal neighbours in sorted order give the places covered.
    """
    h, w, s, p = (f"{_P}{x}" for x in ("hash", "window", "sorted", "place"))
    window = ", ".join(f"get({h}, i + {k})" for k in range(WINDOW))
    return (
        df.withColumn(h, F.expr(f"transform({_P}words, x -> xxhash64(x))"))
        .withColumn(w, F.expr(f"CASE WHEN n_words < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, CAST(n_words AS int) - {WINDOW}, 1), i -> xxhash64({window})) END"))
        .withColumn(s, F.expr(f"CASE WHEN size(array_distinct({w})) < size({w}) THEN sort_array(transform({w}, (x, i) -> struct(x AS h, i AS p))) END"))
        .withColumn(p, F.expr(f"sort_array(transform(filter({s}, (x, i) -> coalesce(x.h = get({s}, i - 1).h, false) OR coalesce(x.h = get({s}, i + 1).h, false)), x -> x.p))"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN {p} IS NULL THEN 0L ELSE aggregate(transform({p}, (x, i) -> coalesce(least({WINDOW}, get({p}, i + 1) - x), {WINDOW})), 0L, (a, x) -> a + x) END"))
    )


def cascade(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by falling rejections per cost, both estimated on the sample (with counts) in one job."""
    asked = [c for k, r in enumerate(rules) for c in (F.count_if(F.expr(r.rejects)).alias(f"hits{k}"), F.avg(F.expr(r.work)).alias(f"cost{k}"))]
    row = sample.agg(*asked).first()
    return [r for _, r in sorted(enumerate(rules), key=lambda x: (-row[f"hits{x[0]}"] / (row[f"cost{x[0]}"] or 1.0), x[0]))]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` documents of the whole table, chosen by a hash of doc_id (of the text where that is null), so that how a table is
    partitioned changes nothing; with counts. Only the order of rules hangs on it."""
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.col("text")))
    return with_counts(with_words(docs.where(F.pmod(key, F.lit(max(docs.count(), 1))) < rows).select("text")))


def verdict(order: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    return cascade(sampled(docs), rules)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The base statistics of every document and whether it is kept.

    The row is made by a generator, so that no later filter is pushed into the
    steps above it, where each use of a column would repeat them all."""
    order = ordered_rules(docs, rules)
    df = with_repeats(with_counts(with_words(docs.select(F.col("doc_id").cast("long"), "text"))))
    df = df.withColumn("base_failed", F.expr(BASE_FAILED))
    df = df.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(order)))
    df = df.withColumn("kept", F.col("rejected_by").isNull())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    return df.select(F.inline(F.array(F.struct(*names))))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Each row is exploded into none or one: a filter would be pushed below the
    steps that its statistics are made in, and repeat them for every use."""
    order = ordered_rules(docs, rules)
    own = docs.columns
    hidden = [f"{_P}own_{i}" for i in range(len(own))]
    df = docs.toDF(*hidden).withColumn("text", F.col(hidden[own.index("text")]))
    df = with_repeats(with_counts(with_words(df)))
    passes = F.when(F.expr(BASE_FAILED), False).otherwise(verdict(order).isNull())
    kept = df.select(*hidden, F.explode(F.when(passes, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias(f"{_P}kept"))
    return kept.select(*(F.col(h).alias(c) for h, c in zip(hidden, own, strict=True)))
