"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets integer text statistics, and from these a few rule scores (0 to SCALE, larger is worse).  A rule
rejects a document whose score is above its cutoff, and a document goes if any rule rejects it.  The cutoffs come from
labels alone:

  A share of the labelled documents (FIT, by a hash of the doc_id) tells how bad a score is: the share of bad ones
  among those that have this score of the rule or more, one good one added.  So the scores of all rules come to one
  scale, a document's badness is its worst, and a limit on badness is a cutoff for each rule.
  The good documents of the others, the holdout, certify limits: for each stratum, limits are tested from the loosest
  to the strictest (fixed sequence), and one holds if the exact binomial test rejects "more than `risk` of the good
  documents are lost" for the verdict of all rules together, at level `delta` / (strata + 1), the Bonferroni share.
  The strictest one that holds is used, but none below MAJORITY: with fewer bad documents than good ones beyond it, a
  score says nothing against a document.

So with probability 1 - delta, no stratum loses more than `risk` of its good documents (that pass the base check) to
the rules.  A stratum with too few good labels for any limit gets the one that all labelled documents certify
together; the bound then holds for the documents of all strata as a whole.  Where even these are too few, rules
reject nothing.

Defined cases: null text counts as no text (no words, so the base check fails); null lang or one that `strata` doesn't
name is in the stratum "other", which has the limit of all; a very long text is measured whole, as one row; equal
scores share a verdict; a document with several labels is good only if all agree, and one whose quality is null has no
label; rows with one doc_id twice are judged each by its own text; empty tables give empty results; an empty label
table certifies nothing, so only the base check rejects; quality_rules() reads doc_id, text and lang only, and
quality_filter() carries a row's own columns in a struct, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.llm.common import only, written

#: White space that parts words, as characters for translate().
SPACE = " \t\n\u000b\u000c\r"
SYMBOLS = "#*$%&|<>"
SCALE = 1000


@dataclass(frozen=True)
class Risk:
    """risk: largest share of good documents that the rules may lose in a stratum; delta: chance of exceeding it anywhere."""

    risk: float = 0.025
    delta: float = 0.05
    strata: tuple[str, ...] = ("de", "en", "es", "fr")


#: Rule name: its score, from the counts of measured() (0 for empty texts).
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "long_words": "greatest(0, word_chars / greatest(n_words, 1) - 4) / 40",
}
#: First hexadecimal digits of the doc_id's MD5 that put a labelled document in the fitting share, a quarter.
FIT = ("0", "1", "2", "3")
#: Badness from which on more documents are bad than good.
MAJORITY = SCALE // 2


def _without(col: Column, chars: str) -> Column:
    return F.length(F.translate(col, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks.

    A text is one row all along: its words and 3-word windows stay in arrays, so nothing is shuffled.
    Windows are compared by 64-bit hashes chained over their words, which decide n_repeat_words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.withColumn("_t", text).withColumn("_w", F.regexp_extract_all("_t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    one = one.withColumn("n_words", F.size("_w").cast("long"))
    one = one.withColumn("_h", F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")).otherwise(F.expr("array()").cast("array<bigint>")))
    one = one.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), null, sort_array(transform(_h, (x, i) -> struct(x, i))))"))
    # Where windows that occur twice begin, in text order; each covers its three words once.
    one = one.withColumn("_b", F.expr("sort_array(filter(transform(_s, (e, k) -> if(e.x = get(_s, k - 1).x or e.x = get(_s, k + 1).x, e.i, -1)), i -> i >= 0))"))
    covered = F.expr("aggregate(_b, named_struct('last', -3, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: _without(x, SPACE) > 0)
    one = one.withColumn("_l", lines)
    return one.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_words",
        _without(F.col("_t"), SPACE).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - _without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length("_t") - _without(F.col("_t"), "!?")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def scored(stats: DataFrame, risk: Risk) -> DataFrame:
    """Adds the stratum and a score s_<rule> for each rule."""
    score = {f"s_{k}": F.least(F.lit(SCALE), F.floor(F.expr(e) * SCALE)).cast("int") for k, e in RULES.items()}
    lang = F.when(F.col("lang").isin(*risk.strata), F.col("lang")).otherwise(F.lit("other"))
    return stats.withColumn("stratum", lang).withColumns(score)


def _lgamma(x: str) -> str:
    """SQL for log gamma of a positive x: Stirling's series above 8, and the recurrence below."""
    z = f"({x} + 8)"
    product = " * ".join(f"({x} + {i})" for i in range(8))
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7)) - ln({product}))"


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); k and n are column names, 0 <= k <= n.  Exact to double precision.

    Terms are summed downwards from k by their ratio, over at most 40 standard deviations.
    """
    n_, k_ = f"double({n})", f"double({k})"
    first = f"exp({_lgamma(f'({n_} + 1)')} - {_lgamma(f'({k_} + 1)')} - {_lgamma(f'({n_} - {k_} + 1)')} + {k_} * ln({p!r}D) + ({n_} - {k_}) * ln({1 - p!r}D))"
    span = f"least({k}, bigint(40 * sqrt({n_} * {p * (1 - p)!r}D) + 40))"
    step = f"named_struct('t', a.t * ({k_} - i) / ({n_} - {k_} + i + 1) * {(1 - p) / p!r}D, 's', a.s + a.t)"
    tail = f"aggregate(sequence(0L, {span}), named_struct('t', {first}, 's', 0D), (a, i) -> {step}, a -> least(1D, a.s))"
    return F.when(F.col(k) >= F.col(n) * p, F.lit(1.0)).otherwise(F.expr(tail))  # no test at level < 1/2 passes above the mean


def badness(fit: DataFrame) -> DataFrame:
    """(rule, score, badness): what each score of each rule says, never less than a smaller score of it.

    The result has len(RULES) * (SCALE + 1) rows, whatever the input.
    """
    tall = fit.select("good", F.posexplode(F.array(*[F.col(f"s_{k}") for k in RULES])).alias("rule", "score"))
    seen = tall.groupBy("rule", "score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    every = fit.sparkSession.range(len(RULES) * (SCALE + 1)).select(F.expr(f"int(id div {SCALE + 1})").alias("rule"), F.expr(f"int(id % {SCALE + 1})").alias("score"))
    beyond, up = W.partitionBy("rule").orderBy(F.desc("score")), W.partitionBy("rule").orderBy("score")
    sums = every.join(seen, ["rule", "score"], "left").na.fill(0, ["g", "b"]).withColumns({c: F.sum(c).over(beyond) for c in ("g", "b")})
    return sums.select("rule", "score", F.max(F.floor(F.col("b") * SCALE / (F.col("b") + F.col("g") + 1)).cast("int")).over(up).alias("badness"))


def cutoffs(labelled: DataFrame, risk: Risk) -> DataFrame:
    """One row for each stratum: c_<rule>, the cutoff of the strictest certified limit (SCALE: the rule rejects nothing).

    labelled: scored() rows with a doc_id and a boolean `good`.  The result has len(strata) + 1 rows, whatever the input.
    """
    fitting = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(*FIT)
    table = written(badness(labelled.filter(fitting)), "badness")
    held = labelled.filter(~fitting).filter("good").select("stratum", *[f"s_{k}" for k in RULES])
    for i, k in enumerate(RULES):
        held = held.join(F.broadcast(table.filter(F.col("rule") == i).select(F.col("score").alias(f"s_{k}"), F.col("badness").alias(f"b_{k}"))), f"s_{k}")
    held = held.withColumn("badness", F.greatest(*[F.col(f"b_{k}") for k in RULES]))
    both = held.select(F.explode(F.array("stratum", F.lit("all"))).alias("stratum"), "badness").filter("stratum <> 'other'")
    hist = both.groupBy("stratum", "badness").agg(F.count(F.lit(1)).alias("c"))  # at most SCALE + 1 rows a stratum
    lost = hist.withColumn("n", F.sum("c").over(W.partitionBy("stratum"))).withColumn("k", F.col("n") - F.sum("c").over(W.partitionBy("stratum").orderBy("badness")))
    # A limit at an observed badness loses the good documents above it; between two of them nothing changes.
    sure = lost.withColumn("p", binomial_tail("k", "n", risk.risk)).filter(F.col("p") <= risk.delta / (len(risk.strata) + 1))
    best = written(sure.groupBy("stratum").agg(F.greatest(F.min("badness"), F.lit(MAJORITY)).alias("badness")), "limits")
    spark = labelled.sparkSession
    rows = spark.createDataFrame([(x, "all") for x in (*risk.strata, "other")], "stratum string, whole string")
    whole = best.select(F.col("stratum").alias("whole"), F.col("badness").alias("other"))
    limits = rows.join(best, "stratum", "left").join(whole, "whole", "left").select("stratum", F.coalesce("badness", "other").alias("limit"))
    # The highest score whose badness the limit allows, rule by rule.
    scale = table.groupBy("rule").agg(F.sort_array(F.collect_list("badness")).alias("scale"))
    each = limits.withColumn("rule", F.explode(F.lit(list(range(len(RULES)))))).join(scale, "rule")
    each = each.withColumn("cutoff", F.coalesce(F.expr("if(limit is null, null, size(filter(scale, x -> x <= limit)) - 1)"), F.lit(SCALE)))
    return each.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"c_{k}") for i, k in enumerate(RULES)])


def labelled_good(labels: DataFrame) -> DataFrame:
    """One row for each labelled document: good if every label calls it of quality and none toxic."""
    good = (F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    return only(labels, "doc_id", "quality", "toxic").filter("quality is not null").groupBy("doc_id").agg(good.alias("good"))


def judged(stats: DataFrame, limits: DataFrame, risk: Risk) -> DataFrame:
    """Adds base_failed and kept.  limits is cutoffs(): len(strata) + 1 rows, so it may be broadcast."""
    rows = scored(stats, risk).join(F.broadcast(limits), "stratum", "left")
    over = F.lit(False)
    for k in RULES:
        over = over | (F.col(f"s_{k}") > F.col(f"c_{k}"))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row for each document: its statistics, scores, its stratum's cutoffs, base_failed and kept.

    Texts are read once; the statistics are written to the shared folder, for the cutoffs and the verdicts.
    """
    stats = written(measured(only(docs, "doc_id", "text", "lang")).drop("text"), "quality")
    good = scored(stats, risk).filter(~base_failed()).join(labelled_good(labels), "doc_id")
    return judged(stats, cutoffs(good, risk), risk).drop("lang")


def quality_filter(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that quality_rules() keeps, with their own columns.

    Documents and statistics are written to the shared folder: cutoffs read the statistics alone, and the
    verdict's filter stands on stored columns (over the expressions it would be pushed down into each).
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text"), "lang")
    stats = written(measured(whole).drop("text"), "quality")
    good = scored(stats.drop("row"), risk).filter(~base_failed()).join(labelled_good(labels), "doc_id")
    return judged(stats, written(cutoffs(good, risk), "cutoffs"), risk).filter("kept").select("row.*")
