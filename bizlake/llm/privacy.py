"""Personal data: patterns, and terms that disclose what the patterns found.

The base kinds are found by patterns.  The corpus then tells which terms give a
protected value away: a term's disclosure of a value is their pointwise mutual
information over documents, as a share of the value's own information,

    log2(n(t, e) * N / (n(t) * n(e))) / log2(N / n(e)),

1 for a term that stands nowhere without the value.  Terms are runs of letters
anywhere in a text but inside found values.  From ``GENERALISE`` on a term is put
in general words, from ``REMOVE`` on it is taken out, if at least ``SUPPORT``
documents show the pair.  Documents whose value stands in the same context
(``REACH`` characters around its place; of several places the one with the least
hash) are copies of a passage and count once.  Terms are marked wherever they
stand, in all texts.

Everything is DataFrame and SQL functions.  Patterns are possessive and anchored
so that they run in linear time and constant stack on any text; they find what
the plain ones of the contract find.

Work on one text is in proportion to its length: spans are handled in blocks, so
that no step copies or walks the whole text once per span.

Defined cases: null is empty; rows that share id and text share their spans;
without found values nothing is marked; an empty table gives an empty one; other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import documents, keyed_text

#: Fixed by the contract, in the order in which kinds are listed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 12 to 19 digits; shorter and longer runs fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

REACH = 60
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.97
#: Terms of counted pairs that are sent to all tasks, so that other words are left out where they are read.
TERMS_SENT = 200_000
#: Matches of one text whose places are summed up at a time.
BLOCK = 256
LETTERS = r"\p{L}++"
#: What stands for a span in sanitised text; removed terms leave nothing.
MARKS = {kind: f"[{kind.upper()}]" for kind in KINDS} | {TERM: "[WORD]"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches, in code points.

    The texts between matches and the matches themselves alternate, so starts
    are running sums of lengths; they are summed up in blocks, as each step of a
    sum copies the spans so far.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"])))
        opens = F.aggregate(
            sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("opens")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["opens"], F.array(s["at"])).alias("opens")),
            lambda s: s["opens"],
        )
        return F.flatten(F.zip_with(
            blocks, opens,
            lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step, lambda s: s["spans"]),
        ))

    def blocked(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return _let(F.transform(numbers, lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK)), placed)

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.when(F.size(found) > 0, _let(pairs, blocked)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _low_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _passing(good: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: good(span["value"])


def _named(order: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
    )


def base_spans(text: Column) -> Column:
    """Array of (start, order, kind, end, value) of the base kinds, by start, then kind."""
    ways = [
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, F.contains(text, F.lit(".")), lambda v: F.forall(F.split(v, r"\."), _low_part)),
        (CARD, F.lit(True), lambda v: F.call_function("luhn_check", _digits(v))),
        (PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    ]
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>")
    arrays = []
    for order, (kind, (pattern, may, good)) in enumerate(zip(KINDS, ways)):
        found = F.filter(matches(text, pattern), _passing(good))
        arrays.append(F.when(may, F.transform(found, _named(order, kind))).otherwise(none))
    return F.array_sort(F.concat(*arrays))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_blocks(spans: Column) -> Column:
    """The spans as an array of arrays of at most ``BLOCK``; none of no spans."""
    numbers = F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(BLOCK))
    cut = F.transform(numbers, lambda at: F.slice(spans, at, BLOCK))
    return F.when(F.size(spans) > 0, cut).otherwise(F.filter(F.array(spans), lambda x: F.lit(False)))


def _replaced(text: Column, spans: Column, stands: Callable[[Column, Column], Column]) -> Column:
    """The text with ``stands(at, span)`` in place of each span; ``at`` is the end of what is covered so far.

    Spans are in order of their starts and may overlap.  Every block of spans works
    on its own stretch of the text, and the stretches are joined once at the end.
    """

    def last(block: Column) -> Column:
        return F.array_max(F.transform(block, lambda s: s["end"]))

    def opened(blocks: Column) -> Column:
        """(block, from, to): the stretch of each block, from the end of all earlier spans."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("opens"))
        ends = F.aggregate(
            F.transform(blocks, last), zero,
            lambda s, n: F.struct(F.greatest(s["at"], n).alias("at"), F.concat(s["opens"], F.array(F.greatest(s["at"], n))).alias("opens")),
            lambda s: s["opens"],
        )
        starts = F.concat(F.array(F.lit(0)), ends)
        return F.zip_with(blocks, F.arrays_zip(F.slice(starts, 1, F.size(ends)).alias("low"), ends.alias("high")), lambda b, p: F.struct(
            b.alias("block"), p["low"].alias("low"), F.substring(text, p["low"] + 1, p["high"] - p["low"]).alias("part"), p["high"].alias("high")
        ))

    def written(piece: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            gap = F.substring(piece["part"], state["at"] - piece["low"] + 1, span["start"] - state["at"])
            return F.struct(
                F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], gap, stands(state["at"], span)).alias("out")
            )

        return F.aggregate(piece["block"], F.struct(piece["low"].alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    def joined(pieces: Column) -> Column:
        rest = F.substring(text, F.element_at(pieces, -1)["high"] + 1, F.length(text))
        return F.array_join(F.concat(F.transform(pieces, written), F.array(rest)), "")

    return F.when(F.size(spans) > 0, _let(_let(_in_blocks(spans), opened), joined)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its spans."""
    return _replaced(text, spans, lambda at, span: F.repeat(F.lit(" "), span["end"] - F.greatest(at, span["start"])))


def _contexts(text: Column, spans: Column) -> Column:
    """Array of (value, context) of the spans; the context is a hash of the text around it."""

    def around(block: Column) -> Column:
        low = F.greatest(block[0]["start"] - REACH, F.lit(0))
        high = F.array_max(F.transform(block, lambda s: s["end"])) + REACH
        stretch = F.struct(block.alias("block"), low.alias("low"), F.substring(text, low + 1, high - low).alias("part"))
        return _let(stretch, lambda t: F.transform(t["block"], lambda s: told(t["part"], s, t["low"])))

    def told(part: Column, s: Column, low: Column) -> Column:
        left = F.greatest(s["start"] - REACH, F.lit(0))
        before, after = F.substring(part, left - low + 1, s["start"] - left), F.substring(part, s["end"] - low + 1, REACH)
        return F.struct(F.concat_ws(":", s["kind"], s["value"]).alias("value"), F.xxhash64(before, after).alias("context"))

    return F.flatten(F.transform(_in_blocks(spans), around))


def _words(text: Column) -> Column:
    """Distinct letter runs of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.lower))


def _on_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id and text_hash; a null id equals a null id."""
    right = right.withColumnsRenamed({"doc_id": "_of", "text_hash": "_of_text"})
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("text_hash") == F.col("_of_text"))
    return left.join(right, same, how).drop("_of", "_of_text")


def disclosures(found: DataFrame) -> DataFrame:
    """(term, disclosure): the largest of each term that reaches ``GENERALISE`` for a value.

    Pairs are counted over whole documents, terms over the letter runs of all texts.
    """
    total = found.count()
    each = found.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    told = each.select("doc_id", "text_hash", F.explode(_contexts(F.col("text"), F.col("spans"))).alias("t")).select("doc_id", "text_hash", "t.*")
    told = settle(told.groupBy("doc_id", "text_hash", "value").agg(F.min("context").alias("context")), "contexts")
    values = told.groupBy("value").agg(F.count("*").alias("n_value"), F.countDistinct("context").alias("contexts"))
    # a pair has no more contexts than its value
    values = settle(values.filter(F.col("contexts") >= SUPPORT).drop("contexts"), "values")
    held = told.join(values.select("value"), "value").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("value", "context")).alias("held"))
    shown = _on_row(each.select("doc_id", "text_hash", _words(_blanked(F.col("text"), F.col("spans"))).alias("words")), held)
    shown = shown.select("held", F.explode("words").alias("term")).select("term", F.inline("held"))
    pairs = shown.groupBy("value", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("value", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts"))
    pairs = settle(pairs.filter(F.col("contexts") >= SUPPORT), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    paired = pairs.select("term").distinct()
    words = found.select(F.explode(_words(F.col("text"))).alias("term"))
    if paired.limit(TERMS_SENT + 1).count() <= TERMS_SENT:
        terms = words.join(F.broadcast(paired), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:
        terms = words.groupBy("term").agg(F.count("*").alias("n_term")).join(paired, "term", "left_semi")
    joined = pairs.join(values, "value").join(terms, "term")
    information = F.log2(F.lit(float(total)) / F.col("n_value"))
    shared = F.log2(F.col("n_pair") * float(total) / (F.col("n_term") * F.col("n_value")))
    scored = joined.withColumn("disclosure", F.when(information > 0, shared / information).otherwise(0.0))
    return scored.filter(F.col("disclosure") >= GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans) with base spans and disclosing terms, in order.

    A span is (start, order, kind, end, value); a term's value is its disclosure as text.
    One row per row of ``docs``.
    """
    found = settle(keyed_text(docs, id_col, text_col).withColumn("spans", base_spans(F.col("text"))), "found")
    telling = settle(disclosures(found), "telling")
    words = found.select("doc_id", "text_hash", F.explode(_words(F.col("text"))).alias("term"))
    known = words.join(telling, "term").groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("known")
    )
    # written, so that its size is known: as long as it is small, no text moves
    known = settle(known, "known")
    runs = matches(_blanked(F.col("text"), F.col("spans")), LETTERS)
    runs = F.filter(runs, lambda r: F.map_contains_key("known", F.lower(r["value"])))
    terms = F.transform(runs, lambda r: F.struct(
        r["start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.lit(TERM).alias("kind"), r["end"].alias("end"),
        F.element_at("known", F.lower(r["value"])).cast("string").alias("value"),
    ))
    joined = _on_row(found, known, "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return joined.select("doc_id", "text_hash", "spans", F.when(F.col("known").isNull(), none).otherwise(terms).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with values masked, telling terms generalised or removed; other columns as they are.

    Spans that overlap are covered as one, under the first one's mark.
    """
    found = find_private(docs, id_col, text_col)
    spans = found.select("doc_id", "text_hash", F.array_sort(F.concat("spans", "terms")).alias("spans"))
    spans = settle(spans.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the row travels as one value, so that its column names meet no others
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = _on_row(keyed, spans, "left")
    mark = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))

    def stands(at: Column, span: Column) -> Column:
        removed = (span["kind"] == TERM) & (span["value"].cast("double") >= REMOVE)
        return F.when((span["start"] < at) | removed, F.lit("")).otherwise(F.element_at(mark, span["kind"]))

    old = F.col("row")[text_col]
    new = F.when(F.col("spans").isNull(), old).otherwise(_replaced(F.coalesce(old.cast("string"), F.lit("")), F.col("spans"), stands))
    return joined.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_private(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = found.select(
        "doc_id", "text_hash", *(count(kind) for kind in KINDS), F.sha2(_written(F.col("spans")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("spans", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )
    return rows.drop("text_hash")


def sanitise_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without personal data; documents stay."""
    return sanitise(docs)
