"""Quality rules with thresholds that adapt to each language and source.

One pass computes five counts for each document with built-in functions. A
mergeable quantile sketch of each ratio is kept for every (language, source),
every language and the whole corpus; a document is then judged against the
fences of the narrowest of these groups that has enough documents.

The sketch counts values in fixed bins whose width follows their size, in integer
arithmetic. Counts are added per task and then merged, so a source with a third
of all rows is no hot spot; and as addition commutes, the thresholds do not
depend on the order in which parts arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.llm.common import SPACE, let, tail, words
from passagelake.session import materialise

#: Characters counted as symbols (fixed values of the result's definition).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Values are counted in units of 1 / UNIT, and of a value's units only the leading BITS bits are kept: bins are as wide as
#: a thousandth of their values, and a sketch has at most 2^(BITS - 1) bins for each power of two.
UNIT = 1 << 20
BITS = 11
#: ratio -> (numerator, denominator)
PARTS = {
    "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
}
#: A group with fewer documents is judged by its language, then by the corpus.
MIN_GROUP = 100
#: ratio -> (upper fence: quartile distances above the third quartile, least distance from the median)
UPPER = {"symbol_ratio": (6.0, 0.05), "dup_line_ratio": (6.0, 0.50), "repeat_ratio": (6.0, 0.40), "word_length": (6.0, 3.0)}
#: ratio -> (lower fence: quartile distances below the first quartile, least distance from the median)
LOWER = {"word_length": (6.0, 2.0)}

#: Bits of a position in the packed sort keys; a text with more words takes the longer way.
_POSITION_BITS = 26


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text has at least twice."""

    def covered(positions: Column) -> Column:
        """Length of the union of [p, p + 3) over sorted positions."""
        steps = F.zip_with(positions, tail(positions), lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(rows: Column, same) -> Column:
        """Elements of a sorted array that equal a neighbour under ``same``."""

        def twin(x: Column, at: Column) -> Column:
            return F.coalesce(same(x, F.get(rows, at)), F.lit(False))

        return F.filter(rows, lambda x, i: twin(x, i + 1) | twin(x, i - 1))

    def windows(v: Column) -> Column:
        count = F.greatest(F.size(v) - 2, F.lit(0))
        return F.arrays_zip(F.slice(v, 1, count).alias("a"), F.slice(v, 2, count).alias("b"), F.slice(v, 3, count).alias("c"))

    def candidates(z: Column) -> Column:
        """Positions whose window may occur again: equal leading bits of its hash."""
        low = (1 << _POSITION_BITS) - 1
        packed = F.sort_array(
            F.transform(z, lambda x, i: F.xxhash64(x["a"], x["b"], x["c"]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        )
        found = let(
            packed,
            lambda p: F.transform(
                repeated(p, lambda x, y: F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)),
                lambda k: k.bitwiseAND(F.lit(low)).cast("int"),
            ),
        )
        every = F.when(F.size(z) > 0, F.sequence(F.lit(0), F.size(z) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(z) <= low, found).otherwise(every)

    def exact(z: Column) -> Column:
        rows = F.transform(candidates(z), lambda i: F.struct(F.get(z, i).alias("w"), i.alias("p")))
        kept = let(F.sort_array(rows), lambda r: repeated(r, lambda x, y: x["w"] == y["w"]))
        return let(F.sort_array(F.transform(kept, lambda r: r["p"])), covered)

    return let(windows(w), exact)


def features(docs: DataFrame, *more: str) -> DataFrame:
    """Adds to ``doc_id, lang, source, text`` the counts and ratios of each whole text.

    A null or empty text has zero everywhere. Of other columns only
    those named in ``more`` stay.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_distinct")))
    out = docs.select(
        "doc_id", "lang", "source", "text", *more,
        counted.alias("_words"),
        line_counts.alias("_lines"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
    )
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return out.select(
        "doc_id", "lang", "source", "text", *more,
        F.col("_words.n_words").alias("n_words"),
        "word_chars", "n_symbols",
        (F.col("_lines.n_lines") - F.col("_lines.n_distinct")).cast("long").alias("n_dup_lines"),
        F.col("_words.n_repeat_words").alias("n_repeat_words"),
        F.col("_lines.n_lines").cast("long").alias("n_lines"),
    ).select(
        "*",
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / per_word).alias("repeat_ratio"),
        (F.col("word_chars") / per_word).alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def _bin(numerator: str, denominator: str) -> Column:
    """The lower end of the bin of a ratio, in units."""
    units = F.expr(f"({numerator} * {UNIT}) div greatest({denominator}, 1)")
    low = F.greatest(F.length(F.bin(units)) - BITS, F.lit(0))
    return let(F.struct(units.alias("units"), low.alias("low")), _leading)


def _leading(x: Column) -> Column:
    """The units without their ``low`` last bits."""
    return x["units"] - F.pmod(x["units"], F.pow(F.lit(2.0), x["low"]).cast("long"))


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences of every (language, source), language and the corpus, from merged quantile sketches.

    Only documents that pass the base rules count. Columns: ``level`` (0: language and source, 1: language,
    3: corpus), ``lang``, ``source``, ``n_docs`` and ``hi_<ratio>``, ``lo_<ratio>``. A quartile is the lower end of
    its bin.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _bin(*PARTS[r]).alias("bin")) for r in UPPER])).alias("_value")
    counted = measured.where(~F.col("base_failed")).select("lang", "source", bins).select("lang", "source", "_value.ratio", "_value.bin")
    sketches = materialise(counted.groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n")), "quality-sketches")
    merged = sketches.groupingSets(
        [["lang", "source", "ratio", "bin"], ["lang", "ratio", "bin"], ["ratio", "bin"]], "lang", "source", "ratio", "bin"
    ).agg(F.shiftright(F.grouping_id(), 2).cast("int").alias("level"), F.sum("n").alias("n"))
    group = Window.partitionBy("level", "lang", "source", "ratio")  # the bins of one sketch
    placed = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("n_docs", F.sum("n").over(group))

    def at(ratio: str, k: int) -> Column:
        """The smallest bin up to which k quarters of the documents lie."""
        reached = (F.col("ratio") == ratio) & (4 * F.col("upto") >= k * F.col("n_docs"))
        return F.min(F.when(reached, F.col("bin"))) / F.lit(float(UNIT))

    quartiles = [F.array(*[at(r, k) for k in (1, 2, 3)]).alias(f"q_{r}") for r in UPPER]
    sketched = placed.groupBy("level", "lang", "source").agg(F.max("n_docs").alias("n_docs"), *quartiles)

    def quartile(ratio: str, k: int) -> Column:
        return F.col(f"q_{ratio}")[k]

    def spread(ratio: str) -> Column:
        return quartile(ratio, 2) - quartile(ratio, 0)

    upper = [
        F.greatest(quartile(r, 2) + times * spread(r), quartile(r, 1) + least).alias(f"hi_{r}")
        for r, (times, least) in UPPER.items()
    ]
    lower = [
        F.least(quartile(r, 0) - times * spread(r), quartile(r, 1) - least).alias(f"lo_{r}")
        for r, (times, least) in LOWER.items()
    ]
    return sketched.select("level", "lang", "source", "n_docs", *upper, *lower)


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``kept`` and ``group_docs`` to measured documents.

    The fences are joined by language and source. The fence table is read from storage, so Spark broadcasts it
    only if its stored size is below the session's limit and otherwise shuffles, splitting hot sources. Every
    (language, source) of the measured rows has a row at level 0 unless all its documents failed the base
    rules; those and small groups fall back on the language, then on the corpus. Without any fence, a
    document that passes the base rules is kept.
    """
    names = [f"hi_{r}" for r in UPPER] + [f"lo_{r}" for r in LOWER]
    fence = F.struct("n_docs", *names)
    by_lang = fences.where((F.col("level") == 1) & (F.col("n_docs") >= MIN_GROUP)).select(F.col("lang").alias("_lang_only"), fence.alias("_by_lang"))
    by_both = fences.where((F.col("level") == 0) & (F.col("n_docs") >= MIN_GROUP)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), fence.alias("_by_both"))
    joined = (
        measured.join(by_both, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("_lang_only")), "left")
    )
    corpus = fences.where("level = 3").select("n_docs", *names).first()  # one row
    known = F.struct(*[F.lit(corpus[c]).alias(c) for c in ("n_docs", *names)]) if corpus else F.lit(None).cast(by_lang.schema["_by_lang"].dataType)
    used = F.coalesce("_by_both", "_by_lang", known)
    inside = F.lit(True)
    for r in UPPER:
        inside &= F.coalesce(F.col(r) <= used[f"hi_{r}"], F.lit(True))
    for r in LOWER:
        inside &= F.coalesce(F.col(r) >= used[f"lo_{r}"], F.lit(True))
    return joined.select(
        *measured.columns, (~F.col("base_failed") & inside).alias("kept"), F.coalesce(used["n_docs"], F.lit(0)).alias("group_docs")
    )


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and final verdict of every document, without its text.

    Needs ``doc_id, lang, source, text``; other columns are left out. Null languages and sources are groups of
    their own. Repeated rows are judged one by one. An empty table gives no rows.
    """
    measured = materialise(features(docs).drop("text"), "quality-features")
    return judge(measured, materialise(thresholds(measured), "quality-fences"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their five columns.

    The counts are first written without texts to derive the fences and computed again while the texts are
    filtered, so no text is shuffled or stored a second time.
    """
    fences = materialise(thresholds(materialise(features(docs).drop("text"), "quality-features")), "quality-fences")
    measured = features(docs, "n_chars")
    return judge(measured, fences).where("kept").select("doc_id", "text", "lang", "source", "n_chars")
