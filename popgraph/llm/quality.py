"""Quality rules: base counts, and the divergence of a document's histograms from its language's.

Two histograms describe a text: its character classes, and its share of each of the language's COMMON_WORDS
commonest words in lower case (and of all others). The references are the same histograms over all texts of the
language in the corpus. A text whose Jensen-Shannon distance
from a reference (base 2, between 0 and 1) is above the limit is rejected; texts under the least length
are not compared, as short histograms are noise.

Everything is DataFrame code: no Python runs on the rows.

Defined cases: null text is empty: no words, base rules reject it; a null language is a language of its
own; texts are read whole; repeated rows are judged each by itself; a language without a reference is
not compared; an empty table gives an empty result; other columns stay apart in `doc`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.llm.common import kept, let, lower_words, numbered, words

MIN_WORDS = 50
COMMON_WORDS = 20
MIN_CHARS_COMPARED = 200
MIN_WORDS_COMPARED = 50
MAX_CHAR_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.42
MAX_BROADCAST_LANGUAGES = 10_000
FEW = 64

# Character classes counted by pattern. White space is what words leave over, all others count as letters; bytes
# beyond one per character (accents and other scripts) are a class of their own.
CLASSES = {"digit": "[0-9]", "upper": "[A-Z]", "other": r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]"}


def repeated_window_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, of an array column of words."""

    def covered(positions: Column) -> Column:
        """3 a window, less what it shares with the one before."""
        shared = let(positions, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.when(i > 0, F.greatest(F.lit(0), 3 - (x - F.get(p, i - 1)))).otherwise(0)),
            F.lit(0), lambda a, b: a + b,
        ))
        return 3 * F.size(positions) - shared

    def few(h: Column, repeated: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(repeated, F.get(h, i)))

    def many(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda t: F.filter(t, lambda x, k: (
            F.coalesce((k > 0) & (F.get(t, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
            | F.coalesce(F.get(t, k + 1)["h"] == x["h"], F.lit(False))
        )))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def doubled(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, F.greatest(i - 1, F.lit(0)))))))

    def count(h: Column) -> Column:
        found = let(doubled(h), lambda d: F.when(F.size(d) <= FEW, let(few(h, d), covered)).otherwise(let(many(h), covered)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(found)

    def hashes(a: Column) -> Column:
        every = F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)))
        return F.slice(every, 1, F.size(a) - 2)

    return F.when(F.size(w) >= 4, let(let(w, hashes), count)).otherwise(0).cast("long")


def measure(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the array `words` and the counts of character
    classes `chars` to every row, all named with two underscores in front."""
    value = F.coalesce(F.col(text), F.lit(""))
    cut = rows.withColumn("__text", value).withColumn("__words", words(value))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.withColumns({
        "__lines": lines, "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        **{f"__{n}": F.regexp_count("__text", F.lit(p)).cast("long") for n, p in CLASSES.items()},
    })
    rest = F.col("__word_chars") - sum((F.col(f"__{n}") for n in CLASSES), F.lit(0))
    length, size = F.length("__text").cast("long"), F.octet_length("__text").cast("long")
    return cut.withColumns({
        "__n_words": F.size("__words").cast("long"), "__n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_repeat_words": repeated_window_words(F.col("__words")),
        "__chars": F.array(length - F.col("__word_chars"), rest, size - length, *(F.col(f"__{n}") for n in CLASSES)),
    })


def common_words(docs: DataFrame, common: int, text: str, lang: str) -> DataFrame:
    """(ref_lang, ref_words, ref_shares): the commonest words of every language over the whole corpus, and the shares of
    each and of all others.

    Languages are rows, so the table is as long as the list of languages. Counting is a two-step
    aggregation, and each task hands on only its commonest words: a language that holds most of the
    corpus is no hot key.
    """
    each = docs.select(F.col(lang).alias("lang"), F.explode(lower_words(F.col(text))).alias("word"))
    each = kept(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = each.groupBy(F.col("lang").alias("__l")).agg(F.sum("n").alias("total"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = each.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= common)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("__rank", "word", "n"))).alias("top"))
    rest = F.col("total") - F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    found = top.join(totals, F.col("lang").eqNullSafe(F.col("__l"))).select(
        F.col("lang").alias("ref_lang"), F.transform("top", lambda t: t["word"]).alias("ref_words"),
        shares(F.array_append(F.transform("top", lambda t: t["n"]), rest)).alias("ref_shares"),
    )
    return kept(found, "references")


def char_shares(measured: DataFrame) -> DataFrame:
    """(char_lang, ref_chars): the character classes of every language over the whole corpus."""
    sums = measured.groupBy(F.col("lang").alias("char_lang")).agg(*(F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(3 + len(CLASSES))))
    return kept(sums.select("char_lang", shares(F.array(*sums.columns[1:])).alias("ref_chars")), "references")


def _by_language(rows: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    small = F.broadcast(refs) if refs.count() <= MAX_BROADCAST_LANGUAGES else refs
    return rows.join(small, F.col("lang").eqNullSafe(F.col(name)), "left")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, let(total, lambda t: F.transform(counts, lambda x: x / t)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two share arrays."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """(row, doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept) for every row of `docs`, which must be a table.

    `doc` has the columns `carry` (default: all). Distances are null where nothing is compared. The texts are read
    twice, for the commonest words and for all counts; the counts are written, and what follows works on these.
    """
    doc = F.struct(*(F.col(c) for c in (docs.columns if carry is None else carry)))
    rows = numbered(docs).select(F.col("__row").alias("row"), doc.alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("__own"))
    met = _by_language(measure(rows, "__own"), common_words(docs, COMMON_WORDS, text, lang), "ref_lang")
    hits = F.transform(F.filter("__words", lambda w: F.array_contains("ref_words", F.lower(w))), F.lower)
    met = met.withColumn("__common", F.when(F.col("ref_words").isNotNull(), hits))
    each = F.transform("ref_words", lambda c: F.size("__common") - F.size(F.array_remove("__common", c)))
    found = F.array_append(each, F.size("__words") - F.size("__common"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    met = met.select("row", "doc", "lang", *(F.col(f"__{c}").alias(c) for c in counts), F.col("__chars").alias("chars"),
                     F.transform(found, lambda x: x.cast("long")).alias("hist"), "ref_shares")
    met = kept(met, "measured")
    met = _by_language(met, char_shares(met), "char_lang")
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    long_enough = (total >= MIN_CHARS_COMPARED) & (F.col("n_words") >= MIN_WORDS_COMPARED)
    met = met.select(
        "row", "doc", *counts, ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.when(long_enough, divergence(shares(F.col("chars")), F.col("ref_chars"))).alias("char_distance"),
        F.when(long_enough, divergence(shares(F.col("hist")), F.col("ref_shares"))).alias("word_distance"),
    )
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return met.withColumn("kept", ~F.col("base_failed") & fits)
