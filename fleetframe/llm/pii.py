"""Personal data: base patterns and bootstrapped contexts (operator 2).

Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import discard, materialize, numbered, scratch_scope, table

# The kinds in their listed order and their patterns.  Written
# so that the engine never goes back over a run: quantifiers that cannot give
# characters back are possessive, and a run that fails is not tried again from
# its middle (nothing behind it would change).
KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_ID = len(PATTERNS)
#: A token that may hold an identifier: white space around, a digit or @ inside.
_TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"


def _slot(word: Column) -> Column:
    """What stands for a word with a digit or @ in the context of another."""
    return F.when(word.contains("@"), F.lit("<email>")).otherwise(F.lit("<num>"))


#: What a text must hold for any match of each pattern.
_NEEDS = ("@", "[0-9]", "[0-9]", "[0-9]", "[0-9@]")


def _matches(text: DataFrame, number: int, pattern: str, to: str) -> DataFrame:
    """Add the matches of one pattern in ``_t`` as an array column.

    The text split at the matches gives what lies between them, so positions
    are sums of lengths in code points; both functions see the same matches.
    """
    ends = number == _ID  # only tokens need the words around them
    null = F.lit(None).cast("string")
    may = F.col("_t").rlike(_NEEDS[number])
    cut = text.withColumn("_gaps", F.when(may, F.split("_t", pattern, -1))).withColumn(
        "_found", F.when(may, F.regexp_extract_all("_t", F.lit(pattern), 0)))
    if ends:
        cut = cut.withColumn("_words", F.transform("_gaps", lambda g: F.nullif(
            F.trim(F.regexp_replace(g, r"\s++", " ")), F.lit("")))).withColumn("_slots", F.transform("_found", _slot))

    def before(i: Column) -> Column:
        """The two words before a token, whole, other tokens by their class."""
        last = lambda j: F.substring_index(F.get("_words", j), " ", -2)
        near = F.concat_ws(" ", F.get("_slots", i - 2), last(i - 1), F.get("_slots", i - 1), last(i))
        return F.substring_index(near, " ", -2)

    def after(i: Column) -> Column:
        return F.coalesce(F.substring_index(F.get("_words", i + 1), " ", 1), F.get("_slots", i + 1), F.lit(""))
    zipped = F.filter(F.arrays_zip(F.col("_gaps").alias("g"), F.col("_found").alias("m")), lambda z: z.m.isNotNull())
    found = F.transform(zipped, lambda z, i: F.struct(
        F.lit(number).alias("kind"), i.alias("at"), F.length(z.g).cast("long").alias("gap"), z.m.alias("found"),
        (before(i) if ends else null).alias("before"),
        (after(i) if ends else null).alias("after")))
    none = F.array().cast("array<struct<kind:int,at:int,gap:bigint,found:string,before:string,after:string>>")
    return cut.withColumn(to, F.coalesce(found, none)).drop("_gaps", "_found", "_words", "_slots")


def _stands(kind: Column, found: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == 2, n.between(13, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19)))
            .when(kind == 3, n.between(9, 15)).otherwise(F.lit(False)))


def _contexts() -> Column:
    """The lexical patterns of a token: the word before it, the two words
    before it, the word behind it, and the words on both sides."""
    two, right = F.lower("before"), F.lower("after")
    one = F.substring_index(two, " ", -1)
    return F.array_compact(F.array(
        F.when(one != "", F.concat(F.lit("1 "), one)),
        F.when(two.contains(" "), F.concat(F.lit("2 "), two)),
        F.when(right != "", F.concat(F.lit("r "), right)),
        F.when((one != "") & (right != ""), F.concat(F.lit("b "), one, F.lit(" _ "), right))))


def _bootstrap(tokens: DataFrame, rounds: int, min_score: float, min_support: int) -> DataFrame:
    """Contexts of high confidence, from tokens that base spans cover.

    The graph has an edge for each context that a token string (instance)
    occurs in.  Instances found by base patterns score 1 throughout.  In each
    round a context scores the sum of its instances' scores over their number
    plus two, and an instance ``1 - product(1 - score)`` over the contexts
    that pass ``min_score`` with at least ``min_support`` instances of score
    0.5 or more.  All sums are aggregates over distinct edges; both sides of
    every join are written first, so frequent contexts can be split.
    """
    edges = materialize(
        tokens.select(F.explode(_contexts()).alias("context"), "instance", "seed")
        .groupBy("context", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    scores = materialize(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "pii-scores")
    seeds, passed = scores, None
    for r in range(rounds):
        rated = (edges.select("context", "instance").join(scores, "instance").groupBy("context")
                 .agg(F.sum("score").alias("mass"), F.count("*").alias("n"),
                      F.sum((F.col("score") >= 0.5).cast("long")).alias("support")))
        passed = materialize(rated.withColumn("confidence", F.col("mass") / (F.col("n") + 2))
                             .filter((F.col("confidence") >= min_score) & (F.col("support") >= min_support))
                             .select("context", "confidence"), "pii-contexts")
        if r + 1 < rounds:
            lifted = edges.select("context", "instance").join(passed, "context").groupBy("instance").agg(
                (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("lift"))
            last, scores = scores, materialize(seeds.join(lifted, "instance", "left").select(
                "instance", F.greatest("score", F.coalesce("lift", F.lit(0.0))).alias("score")), "pii-scores")
            discard(passed, *([last] if last is not seeds else []))
    discard(edges, seeds, scores)
    return passed


def pii_spans(df: DataFrame, key: str, text: str, rounds: int = 3, min_score: float = 0.8,
              min_support: int = 8) -> DataFrame:
    """``(key, text_md5, spans)`` for every row: ``spans`` is an array of
    (kind, start, end), by kind as listed in ``KINDS`` and then start, in code
    points with exclusive ends.

    Base spans are the leftmost non-overlapping matches of each kind that pass
    its check (parts of an address at most 255, Luhn, numbers of digits).
    The contexts of tokens that base spans cover are then scored against all
    tokens of the corpus (:func:`_bootstrap`); a token (a word with a digit or
    @) that no base span covers, in a context of high confidence, becomes a
    span of kind ``id``.  Contexts are made of the next words whatever these
    hold; other tokens stand in them by their class.

    Every text is read once; what is shuffled are matches, not texts, and no
    window or list spans more than one text.

    Defined cases: null and empty texts have no spans; repeated rows each get
    their row, and null keys are kept; ties and copies weigh once, as edges
    are distinct; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
                     F.monotonically_increasing_id().alias("_row"))
    for i, p in enumerate((*PATTERNS, _TOKEN)):
        rows = _matches(rows, i, p, f"_m{i}")
    # written once: row numbers stay as they are in everything below
    raw = materialize(rows.select("_row", "_key", F.md5(F.col("_t").cast("binary")).alias("text_md5"),
                                  F.concat(*[f"_m{i}" for i in range(_ID + 1)]).alias("_all")), "pii-matches")
    upto = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (raw.select("_row", F.inline("_all"))
              .withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto))
              .withColumn("start", F.col("end") - F.length("found"))
              .filter((F.col("kind") == _ID) | _stands(F.col("kind"), F.col("found"))))
    core = F.regexp_extract("found", r"(?s)[A-Za-z0-9+].*[A-Za-z0-9]", 0)
    lead = F.length(F.regexp_extract("found", r"(?s)^[^A-Za-z0-9+]*+", 0))
    token = F.col("kind") == _ID
    placed = (placed.withColumn("instance", F.when(token, F.lower(core)))
              .withColumn("start", F.when(token, F.col("start") + lead).otherwise(F.col("start")))
              .withColumn("end", F.when(token, F.col("start") + F.length(core)).otherwise(F.col("end")))
              .filter(~token | (F.col("instance") != "")))
    # a token is covered if a base span that begins before its end reaches
    # into it: the largest base end among those before it, or the next begin
    forth = Window.partitionBy("_row").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_row").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = materialize(
        placed.withColumn("_ended", F.max(F.when(~token, F.col("end"))).over(forth))
        .withColumn("_begins", F.min(F.when(~token, F.col("start"))).over(back))
        .withColumn("seed", F.when(token, F.coalesce(F.col("_ended") > F.col("start"), F.lit(False)) | F.coalesce(
            F.col("_begins") < F.col("end"), F.lit(False))).cast("int"))
        .select("_row", "kind", "start", "end", "instance", "before", "after", "seed"), "pii-spans")
    tokens = spans.filter(token)
    contexts = _bootstrap(tokens, rounds, min_score, min_support)
    open_ = tokens.filter(F.col("seed") == 0)
    more = (open_.select("_row", "kind", "start", "end", F.explode(_contexts()).alias("context"))
            .join(contexts, "context", "left_semi").select("_row", "kind", "start", "end").distinct())
    found = (spans.filter(~token).select("_row", "kind", "start", "end").unionByName(more)
             .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans")))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return raw.select("_row", "_key", "text_md5").join(found, "_row", "left").select(
        F.col("_key").alias(key), "text_md5", F.coalesce("spans", none).alias("spans"))


def redact(df: DataFrame, text: str, **options) -> DataFrame:
    """``df`` with every span of :func:`pii_spans` in ``text`` replaced by its
    kind in angle brackets (overlapping spans: once, by the first one's kind).

    Rows are known by their place in ``df``'s files, so rows alike in every
    column are one each; texts meet their spans in one join on that place.

    Defined cases: null texts stay null, empty ones empty; texts without spans
    stay as they are, very long ones are taken whole; repeated rows are all
    kept; an empty table gives no rows; other columns pass unchanged, whatever
    their names.
    """
    df, place = numbered(df)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    with scratch_scope() as keep:
        spans = pii_spans(df.select(place.alias("place"), F.col(f"`{text}`").alias("text")), "place", "text", **options)
        flat = spans.filter(F.size("spans") > 0).select("place", F.inline("spans"))
        order = Window.partitionBy("place").orderBy("start", "kind")
        runs = (flat.withColumn("_till", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
                .withColumn("_run", F.sum(F.coalesce(F.col("start") >= F.col("_till"), F.lit(True)).cast("long"))
                            .over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy("place", "_run")
                .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                     F.min_by("kind", F.struct("start", "kind")).alias("kind"))
                .groupBy("place").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts")))
        runs = keep(materialize(runs.select(F.col("place.row_index").alias("_at"), F.col("place.file_path").alias("_in"),
                                            "_cuts"), "pii-cuts"))

    def piece(cut: Column, i: Column) -> Column:
        frm = F.when(i == 0, F.lit(0)).otherwise(F.get("_cuts", i - 1).end)
        return F.concat(F.substring("_body", frm.cast("int") + 1, (cut.start - frm).cast("int")),
                        F.get(names, cut.kind))
    tail = F.substring("_body", F.element_at("_cuts", -1).end.cast("int") + 1, F.length("_body"))
    # all other columns as one struct, so that no name can clash
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(rest.alias("_row"), F.col(f"`{text}`").alias("_body"), place.getField("row_index").alias("_of_at"),
                     place.getField("file_path").alias("_of_in"))
    joined = rows.join(runs, (F.col("_of_at") == F.col("_at")) & (F.col("_of_in") == F.col("_in")), "left")
    body = F.col("_body").cast("string")
    clean = F.when(F.col("_cuts").isNull(), body).otherwise(
        F.concat(F.array_join(F.transform("_cuts", piece), ""), tail))
    return joined.select(*[clean.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = pii_spans(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    names = F.array(*[F.lit(k) for k in KINDS])
    digest = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(digest(F.filter("spans", lambda s: s.kind != _ID)), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))


__all__ = ["KINDS", "pii_spans", "redact", "op2_pii"]
