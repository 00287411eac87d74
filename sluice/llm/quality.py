"""Quality rules: base rules, and thresholds that each language and source sets itself, from mergeable quantile sketches.

For each rule a text has a count of events among places: symbols among words, repeated lines among lines, repeated windows
(ten words in windows found twice or more are one event) among as many words, capitals among characters of words, words
equal to the one before among words. Rates, counts / places, are aggregated to a KLL sketch for each language and source;
sketches of a language's sources merge to the language's, and these to that of all.

A group's limit is the upper fence of its rates, third quartile + `reach` * interquartile range: no rule has a constant
cutoff, and where most texts have no such event at all, the limit is zero. A text fails a rule if its rate lies above the
limit for certain: it would, had it `sure` standard deviations fewer events (the deviation of a count is its square
root), so that one odd event, or a short text, condemns nothing. Limits of small groups lean on those of larger ones: a
source's is the mean of its own and its language's, weighed by its rows and by `lean` rows, and the language's so with
that of all. A source whose junk reaches its third quartile doesn't lift its own limit: the fence is at most the greater
of that of the language (of all, for a language) and the one that the lower half gives, median + (1 + 2 * `reach`) *
(median - first quartile), which is also the most for all. Over half of a source (or of all) must be alike to be taken for
its style; if that is junk, it stays.

All of it is built-in functions; sketches and counts take every row, and no text is shuffled.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups. An empty table gives an
empty result. Rows repeated are judged alike; a rate equal to its limit passes. Very long texts are judged whole. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, documents
from .native import let

WINDOW = 5
RULES = ("symbols", "dup_lines", "repeats", "capitals", "stutter")
REACH, SURE = 3.0, 3.0
#: Rows of the wider group that stand beside a group's own; accuracy of the sketches.
LEAN, SKETCH_K = 20, 400


def repeated_words(n: Column, hashes: Column) -> Column:
    """Words that lie in windows of five found twice or more."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def of(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(ordered, lambda o: let(repeated(o), covered)))

    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))
    return F.when(n < WINDOW, 0).otherwise(let(grams, of))


def features(text: Column) -> Column:
    """Struct of counts, all long."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        fields = {
            "n_words": n,
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
            "n_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "n_repeat": let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(repeated_words(n, h).cast("long").alias("words"), F.size(F.filter(h, lambda x, i: x == F.get(h, i - 1))).alias("stutter"))),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        }
        return F.struct(*[(v if k in ("n_lines", "n_repeat") else v.cast("long")).alias(k) for k, v in fields.items()])

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


def rated(text: Column, sure: float = SURE) -> Column:
    """Struct of counts, base_failed, and structs of each rule's rate (v) and of the rate that is certain (s)."""

    def of(x: Column) -> Column:
        n, dup = x["n_words"], x["n_lines"]["dup"]
        events = {
            "symbols": (x["n_symbols"], n), "dup_lines": (dup, x["n_lines"]["n"]), "repeats": (x["n_repeat"]["words"] / (2 * WINDOW), n / (2 * WINDOW)),
            "capitals": (x["n_capitals"], x["word_chars"]), "stutter": (x["n_repeat"]["stutter"], n),
        }
        rate = {k: F.when(m > 0, c / m).otherwise(0.0) for k, (c, m) in events.items()}
        certain = {k: F.when(c > sure * sure, rate[k] * (1 - sure / F.sqrt(c))).otherwise(0.0) for k, (c, _) in events.items()}
        return F.struct(
            n.alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), x["n_repeat"]["words"].alias("n_repeat_words"),
            ((n < 10) | (100 * x["n_repeat"]["words"] > 20 * n)).alias("base_failed"), F.struct(*[rate[k].alias(k) for k in RULES]).alias("v"), F.struct(*[certain[k].alias(k) for k in RULES]).alias("s"),
        )

    return let(features(text), of)


def thresholds(rows: DataFrame, reach: float = REACH, lean: float = LEAN) -> DataFrame:
    """t_lang, t_source, limits (a struct with each rule's), one row of each group; from columns lang, source, v."""
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(f"v.{k}"), F.lit(SKETCH_K)).alias(k) for k in RULES])

    def merged(*by: str) -> DataFrame:
        tag = "_lang" if by else "_all"
        return own.groupBy(*by).agg(F.sum("n").alias(f"n{tag}"), *[F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(f"{k}{tag}") for k in RULES])

    by_lang = merged("lang").withColumnRenamed("lang", "l")
    all_ = own.join(by_lang, own["lang"].eqNullSafe(by_lang["l"])).drop("l").join(F.broadcast(merged()))  # the last has one row

    def limit(k: str) -> Column:
        def fences(sketch: str) -> tuple[Column, Column]:
            q1, q2, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(p)) for p in (0.25, 0.5, 0.75))
            return q3 + reach * (q3 - q1), q2 + (1 + 2 * reach) * (q2 - q1)  # the same where both halves are alike

        def leaning(sketch: str, n: Column, wider: Column) -> Column:
            upper, lower = fences(sketch)
            return (n * F.least(upper, F.greatest(lower, wider)) + lean * wider) / (n + lean)

        return leaning(k, F.col("n"), leaning(f"{k}_lang", F.col("n_lang"), F.least(*fences(f"{k}_all"))))

    return all_.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*[limit(k).alias(k) for k in RULES]).alias("limits"))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (with lang, source, base_failed, s) with `kept`."""
    within = F.lit(True)
    for k in RULES:
        within &= F.col(f"s.{k}") <= F.col(f"limits.{k}")
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"]))
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(within)).drop("t_lang", "t_source", "limits")


def quality(docs: DataFrame, reach: float = REACH, lean: float = LEAN, sure: float = SURE) -> DataFrame:
    """doc_id, counts, base_failed and kept of each row."""
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.save(docs.select("doc_id", "lang", "source", rated(F.col("text"), sure).alias("q")).select("doc_id", "lang", "source", "q.*"), "features")
    return judged(rows, ws.save(thresholds(rows, reach, lean), "limits")).drop("v", "s", "lang", "source")


def accepted(docs: DataFrame, reach: float = REACH, lean: float = LEAN, sure: float = SURE) -> DataFrame:
    """The rows of docs that pass, all columns as they are. They are written with their rates beside them, so these are worked out once and no text is shuffled."""
    ws = Workspace(docs.sparkSession, "quality")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "lang", "source", rated(F.col("text"), sure).alias("q"))
    rows = ws.save(whole.select("doc", "lang", "source", "q.base_failed", "q.v", "q.s"), "rated")
    return judged(rows, ws.save(thresholds(rows, reach, lean), "limits")).filter("kept").select("doc.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return quality(documents(spark, sf_dir))


QUERIES = {"op7_quality": op7_quality}
