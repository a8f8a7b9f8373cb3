"""Personal data: base patterns plus candidates that boosted trees accept.

High-recall generators propose spans, which may overlap. Each candidate falls into
one cell of a bounded grid of format and context features. Over the whole corpus the
cells are counted by an aggregation, with the strict base rules as labels (an address
with ``[at]`` or ``(dot)`` is labelled and placed by its plain form); the trees see neither the plus sign nor the check digit nor the range of an address part, so a
candidate that looks like personal data in form and context scores high although it
misses a strict rule. Trees are fitted on one half of the documents; on the other half
the lowest score that still reaches the wanted precision becomes the threshold of a
kind. Everything that runs over documents is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.llm.common import let, prefix_sums
from passagelake.session import materialise

#: Kinds in the order in which spans with the same start are listed (fixed values of the result's definition).
KINDS = ["email", "ip", "card", "phone"]

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: The base patterns, written so that no start is tried twice in a run and no group recurses: time stays
#: linear in the text. E.g. an address starts where its run starts or where the last match ended (``\G``).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_HOST}++\.{_HOST})(?:(?!\.(?!{_HOST}))[A-Za-z0-9.-])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns that propose candidates.
WIDE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}++ ?(?:@|[\[(] ?at ?[\])]) ?{_HOST}++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?{_HOST}++){{0,6}}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,20}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00 ?)?[(]?[0-9][0-9 ().-]{5,20}[0-9](?![0-9])",
}
#: What a text needs before a kind's patterns are tried at all.
_NEEDS = {"email": r"(?i)@|[\[(] ?at ?[\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

_BRACKET = r"[(\[]"
_KEYWORDS = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|card|visa|credit|account|\bip\b|host|server|address)"

#: Feature -> number of values. Their product (28,224) bounds the cells and with them the training rows.
GRID = {"kind": 4, "digits": 21, "groups": 7, "paren": 2, "left": 2, "keyword": 2, "right": 3, "ending": 2}

PRECISION = 0.95
TREES, DEPTH, SEED = 20, 3, 7

_SPANS = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches with their code point positions and the characters around them."""

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        return let(
            prefix_sums(steps),
            lambda at: F.transform(
                found,
                lambda m, i: let(
                    F.get(at, i) + F.length(F.get(gaps, i)),
                    lambda s: F.struct(
                        s.alias("start"),
                        (s + F.length(m)).alias("end"),
                        m.alias("found"),
                        F.right(F.get(gaps, i), F.lit(24)).alias("before"),
                        F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                    ),
                ),
            ),
        )

    found = let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")),
        lambda r: placed(r["m"], r["g"]),
    )
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(_SPANS))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """Validated spans of the base patterns: ``array<struct<start, kind, end>>``, sorted."""

    def of(n: int, kind: str) -> Column:
        valid = F.filter(_matches(text, BASE[kind], _NEEDS[kind]), lambda s: _valid(kind, s["found"]))
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    return F.sort_array(F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)]))


def _plain_address(found: Column) -> Column:
    """An address with ``[at]`` and ``(dot)`` written as signs."""
    return F.regexp_replace(F.regexp_replace(found, r"(?i) ?[\[(] ?at ?[\])] ?", "@"), r"(?i) ?[\[(] ?dot ?[\])] ?", ".")


def _strict_when_plain(kind: int, span: Column) -> Column:
    """Whether a candidate with brackets is, in its plain form, an address of the base pattern."""
    if kind:
        return F.lit(False)
    return span["found"].rlike(_BRACKET) & _plain_address(span["found"]).rlike(rf"^{_LOCAL}++@{_HOST}++(?:\.{_HOST}++){{1,7}}$")


def _cell(kind: int, span: Column) -> Column:
    """The candidate's place in the grid as one number; an address is placed by its plain form."""
    found, email = span["found"] if kind else _plain_address(span["found"]), F.lit(kind == 0)
    values = {
        "kind": F.lit(kind),
        "digits": F.least(F.length(_digits(found)), F.lit(20)),
        "groups": F.least(F.size(F.split(found, "[^0-9]+" if kind else "[.@ ]+")), F.lit(6)),
        "paren": found.rlike(_BRACKET).cast("int") if kind else F.lit(0),
        "left": span["before"].rlike(r"\S$").cast("int"),
        "keyword": span["before"].rlike(_KEYWORDS).cast("int"),
        "right": F.when(span["after"].rlike(r"^(?:[\s,.;:!?)]|$)"), 0).when(span["after"].rlike(r"^\p{L}"), 1).otherwise(2),
        "ending": (email & found.rlike(r"\.[A-Za-z]{2,6}$")).cast("int"),
    }
    code = F.lit(0)
    for name, size in GRID.items():
        code = code * size + values[name]
    return code.cast("int")


def _candidates(text: Column) -> Column:
    def of(n: int, kind: str) -> Column:
        return F.transform(
            _matches(text, WIDE[kind], _NEEDS[kind]),
            lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), _cell(n, s).alias("cell"), _strict_when_plain(n, s).alias("plain")),
        )

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def propose(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns in ``more``, ``base`` (validated spans) and ``extra`` (all candidates, labelled).

    A null text counts as empty. Texts are read whole; a repeated row is handled like any other.
    """
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", *more, _base(text).alias("base"), _candidates(text).alias("_proposed"))

    def labelled(c: Column) -> Column:
        plain = F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
        return F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["cell"].alias("cell"),
            (c["plain"] | F.array_contains(F.col("base"), plain)).cast("int").alias("label"),
            F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).alias("covered"),
        )

    return both.withColumn("extra", F.transform("_proposed", labelled)).drop("_proposed")


@dataclass(frozen=True)
class Detector:
    """Accepted cells of the grid, at most its size."""

    cells: tuple[int, ...]

    def spans(self) -> Column:
        """All spans, sorted: the base ones and accepted candidates that touch none of them."""
        if not self.cells:
            return F.col("base")
        accepted = F.filter("extra", lambda c: ~c["covered"] & c["cell"].isin(list(self.cells)))
        added = F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        return F.sort_array(F.array_distinct(F.concat("base", added)))


def fit(proposed: DataFrame) -> Detector:
    """Trees over the counted cells, thresholds from the other half of the documents.

    The rows that reach the trees are cells, not documents: at most ``prod(GRID)`` of them, whatever the
    corpus. Without candidates of both labels nothing is accepted.
    """
    cells = materialise(
        proposed.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.explode("extra").alias("c"))
        .where(~F.col("c.covered") | (F.col("c.label") == 1))
        .groupBy(F.col("c.cell").alias("cell"))
        .agg(*[F.count_if((F.col("half") == h) & (F.col("c.label") == y)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]),
        "pii-cells",
    )
    rest, values = F.col("cell"), {}
    for name, size in reversed(GRID.items()):
        values[name] = F.pmod(rest, F.lit(size)).cast("double")
        rest = F.floor(rest / size)
    cells = VectorAssembler(inputCols=list(GRID), outputCol="features").transform(cells.withColumns(values))
    rows = cells.select("cell", "features", F.explode(F.array(*[F.struct(F.lit(float(y)).alias("label"), F.col(f"n0{y}").cast("double").alias("weight")) for y in (0, 1)])).alias("r"))
    rows = rows.select("cell", "features", "r.*").where("weight > 0").coalesce(1).sortWithinPartitions("cell", "label")
    if rows.select(F.count_distinct("label")).first()[0] < 2:
        return Detector(())
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=max(GRID.values()) + 1, minInstancesPerNode=1, weightCol="weight", seed=SEED).fit(rows)
    scored = trees.transform(cells).withColumn("score", vector_to_array("probability")[1])
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    precision = F.sum("n11").over(above) / F.greatest(F.sum(F.col("n10") + F.col("n11")).over(above), F.lit(1))
    ranked = scored.withColumn("precision", precision)
    limits = ranked.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("score").alias("threshold"))
    accepted = ranked.join(limits, "kind").where("score >= threshold").select("cell")
    return Detector(tuple(sorted(r.cell for r in accepted.toLocalIterator())))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """Spans of every document: counts per kind, hash of the base spans, all spans as text.

    Needs ``doc_id, text``; other columns are left out. A null or empty text has no span. Repeated rows give
    repeated results; an empty table gives no rows.
    """
    proposed = materialise(propose(docs), "pii-spans")
    detector = fit(proposed)

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")

    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return proposed.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(detector.spans()).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The five document columns with every span replaced by ``[KIND]``.

    Of overlapping spans the first one names the replacement, which covers all of them. A null text stays null;
    ``n_chars`` becomes the new length.
    """
    detector = fit(materialise(propose(docs), "pii-spans"))
    found = propose(docs, "text", "lang", "source", "n_chars").withColumn("_spans", detector.spans())

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] < F.coalesce(last["end"], F.lit(0))), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(s))
        )

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    merged = F.aggregate("_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"), merge)

    def cut(spans: Column) -> Column:
        pieces = F.transform(
            spans,
            lambda s, i: F.concat(
                F.substring("text", F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int") + 1, (s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))).cast("int")),
                F.get(names, s["kind"]),
            ),
        )
        rest = F.substring("text", F.element_at(spans, -1)["end"].cast("int") + 1, F.length("text"))
        return F.concat(F.concat_ws("", pieces), rest)

    text = F.when(F.size("_spans") > 0, let(merged, cut)).otherwise(F.col("text"))
    out = found.select("doc_id", text.alias("text"), "lang", "source", "n_chars")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
