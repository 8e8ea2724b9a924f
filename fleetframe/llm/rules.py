"""Quality rules compiled into Spark projections (operator 12).

Built of DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import table

# White space, symbols, and the shortest text, the window and
# the share of the base rule.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Frequent function words of the languages the rules are meant for.
STOP_WORDS = (
    "a an and are as at be by for from had has have he his in is it not of on or that the this to was were which "
    "with you au ce dans de des du elle en est et il la le les ne par pas pour que qui se son sur un une con del el "
    "es lo los las no por su y al auf aus bei das dem den der die ein eine er für im ist mit nicht sich sie "
    "und von werden wie zu").split()


@dataclass(frozen=True)
class Rule:
    """A ratio (or count) and the range in which a text passes; an open end is
    None."""
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table.  Measures are counts of :func:`counted`, or
#: ``count/count`` ratios of two of them.
RULES = (
    Rule("word_length", "word_chars/n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols/n_words", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("letters", "n_letter_words/n_words", least=0.6),
    Rule("duplicate_lines", "n_dup_lines/n_lines", most=0.3),
    Rule("bullet_lines", "n_bullet_lines/n_lines", most=0.9),
    Rule("cut_lines", "n_cut_lines/n_lines", most=0.3),
)


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def _windows(words: Column, n: Column, width: int) -> Column:
    """The hash of every window of ``width`` words, in order."""
    return F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(
            F.array().cast("array<bigint>"))


def counted(df: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """``key`` and the counts of every text, a projection without a shuffle:
    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a
    word), ``n_dup_lines``, ``n_repeat_words``, ``n_stop_words``,
    ``n_letter_words``, ``n_bullet_lines``, ``n_cut_lines``.

    Windows are compared by their hashes first.  Only a text in which a hash
    comes twice sorts them: windows of equal hash lie side by side there, and
    one counts as repeated if a neighbour has the same words.
    """
    at = F.col
    # each column used twice or in a function of elements is a column of a
    # lower projection, so that it is evaluated once a text
    cut = df.select(at(f"`{key}`").alias("_key"), F.coalesce(at(f"`{text}`").cast("string"), F.lit("")).alias("_t")) \
        .select("_key", "_t", _words(at("_t")).alias("_w"),
                F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_l")) \
        .select("*", F.size("_w").alias("_n")) \
        .select("*", _windows(at("_w"), at("_n"), width).alias("_h"))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    cut = cut.select("*", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(
        h.alias("h"), (i + 1).alias("i"))))).alias("_s"))

    def same(x: Column, j: Column) -> Column:
        y = F.get("_s", j)
        return F.coalesce((x.h == y.h) & (F.slice("_w", x.i, width) == F.slice("_w", y.i, width)), F.lit(False))
    cut = cut.select("*", F.sort_array(F.transform(F.filter(
        "_s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.i)).alias("_r"))
    # words under the repeated windows: each adds what the next one leaves
    covered = F.aggregate("_r", F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, p: F.struct(
        (a.n + F.least(F.lit(width), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    size = lambda c: F.size(c).cast("long")
    return cut.select(
        at("_key").alias(key),
        size("_w").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        size("_l").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        size(F.filter("_l", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_cut_lines"))


def _fails(rule: Rule) -> Column:
    top, _, below = rule.measure.partition("/")
    value, scale = F.col(top), (F.col(below) if below else F.lit(1))
    low = value < rule.least * scale if rule.least is not None else F.lit(False)
    high = value > rule.most * scale if rule.most is not None else F.lit(False)
    return low | high


def quality_rules(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of :func:`counted` for every row, with ``base_failed``,
    ``failed`` (names of the rules that a text breaks, in the table's order)
    and ``kept``.

    The table becomes columns of one projection: a ratio is compared by
    multiplying its threshold with the lower count, so an empty text divides
    nothing.  ``base_failed``: fewer than 20 words, or over 30 % of them in
    8-word windows that come twice or more.  ``kept``: neither that nor any
    rule of the table.

    Defined cases: null texts count as empty, and these fail the base rule
    (no words); very long texts are taken whole; repeated rows each get their
    row, null keys are kept; an empty table gives no rows; other columns of
    ``df`` are ignored, whatever their names.
    """
    found = counted(df, key, text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules])) if rules \
        else F.array().cast("array<string>")
    return found.select("*", base.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules(docs, "doc_id", "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"))


def _sql() -> str:
    """The same over DuckDB's lists."""
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        top, _, below = r.measure.partition("/")
        scale = below or "1"
        tests.append(f"CASE WHEN {f'{top} < {r.least} * {scale}' if r.least is not None else 'false'} OR "
                     f"{f'{top} > {r.most} * {scale}' if r.most is not None else 'false'} THEN '{r.name}' END")
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
pos AS (SELECT id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) >= {WINDOW})),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS n FROM pos) WHERE n > 1),
cov AS (SELECT id, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n
        FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM rep) GROUP BY id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({words}))) AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
        len(list_filter(l, lambda x: left(ltrim(x), 1) IN ('-', '*', '•'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: suffix(rtrim(x), '...') OR suffix(rtrim(x), '…'))) AS n_cut_lines
      FROM w LEFT JOIN cov USING (id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             array_to_string(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL), ',') AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, failed FROM f
"""


OP12_SQL = _sql()

__all__ = ["Rule", "RULES", "STOP_WORDS", "counted", "quality_rules", "op12_rules", "OP12_SQL"]
