"""Personal data by candidate gradient boosting (DataFrame functions and Spark's own boosted trees).

Generators with high recall propose spans, which may overlap: the four base patterns whether or not
their checks hold, addresses with the at sign or the dot spelt out, and any run of digits with
separators.  Base matches that pass their checks are found for certain and are the trees' positives.
Negatives are matches whose checks fail, numbers without a cue word, and words that merely read like an
address ("at home. Then").  A spelt-out address or a number after a cue word is neither: it is scored, not
learned from, and no cut-off counts it as an error.  Inputs are format (digits, groups, letters, marks) and
context (cue words before, what is glued to the sides).  Spelt signs count as the signs they stand for, and
what only tells a base pattern from another form (plus sign, brackets, country code) is left out.  For each
kind the cut-off is the lowest score grade, one half at least, from which on the examples of a held-out fold
are right to the wanted share.  Proposals above it are added unless they touch a base span; among
overlapping ones the most probable stays.

The trees are fitted on a bounded sample of proposals; proposing, scoring and cut-offs cover all.

Positions come from the text between matches: the pattern's split and its matches alternate, so
running sums of their lengths are the spans, in code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are each reported; with too few
examples of either sort no span is added; equally probable overlapping spans give way to the earliest; very
long texts are taken whole, their spans ordered once and never paired; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadquarry.session import discard, spool

KIND_NAMES = ("email", "ip", "card", "phone")

# The base patterns.  Possessive where nothing can be won by giving back, so that long
# runs neither recurse nor start over at every character; the matches are those of the plain forms.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators beyond them.
MORE = {
    "spelt": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]++)++",
    "digits": r"(?<![0-9+])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
CUES = {"email": "mail|contact|write", "ip": "ip|host|addr|server", "card": "card|visa|credit|pay|iban", "phone": "tel|phone|call|fax|mobil"}
#: Signs of an address, spelt out or not.
MARKED_AT, MARKED_DOT = r"@|\(at\)|\[at\]|\{at\}", r"\.|\(dot\)|\[dot\]|\{dot\}"
BEFORE, AFTER = 20, 8  # context characters

#: Proposals that the trees are fitted on, at most.
TRAINING_ROWS = 30_000
TREES, DEPTH = 20, 4
PRECISION = 0.95
GRADES = 100


def _proposed(text: Column, pattern: str) -> Column:
    """What lies between and in the matches: array of (gap length, before, match, after); null without a match."""
    gaps = F.split(text, pattern, -1)
    bare = F.transform(gaps, lambda g: F.struct(
        F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("before"), F.left(g, F.lit(AFTER)).alias("first")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.arrays_zip(bare.alias("g"), found.alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: Column, m: Column) -> Column:
    """Whether a base match passes its checks."""
    n = F.length(_digits(m))
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.lpad(p, 3, "0"), F.lit("999")) <= 255))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", small)
            .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False))
            .otherwise(n.between(8, 15)))


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all rows, their proposals): row_id, doc_id; row_id, kind, base, label, start, end, match, before, after."""
    body = F.coalesce(F.col(text), F.lit(""))
    maybe = F.regexp_like(body, F.lit("[0-9@]|(?i:at)[)\\]} ]"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
        *[F.when(maybe, _proposed(body, p)).alias(name) for name, p in (BASE | MORE).items()])
    rows = spool(rows)
    each = F.array(*[F.struct(F.lit(name).alias("by"), F.col(name).alias("zs")) for name in BASE | MORE])
    named = rows.select("row_id", F.explode(each).alias("e")).where("e.zs IS NOT NULL")
    z = named.select("row_id", F.col("e.by").alias("by"), F.posexplode_outer("e.zs").alias("i", "z"))
    z = z.select("row_id", "by", "i", F.col("z.m").alias("match"), F.col("z.g.gap").alias("gap"),
                 F.col("z.g.before").alias("before"), F.col("z.g.first").alias("first"))
    run = Window.partitionBy("row_id", "by").orderBy("i")
    z = z.withColumns({"start": F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(run) - F.coalesce(F.length("match"), F.lit(0)),
                       "after": F.lead("first").over(run)}).where("match IS NOT NULL")
    n = F.length(_digits(F.col("match")))
    dotted = F.regexp_like("match", F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"))
    # A run of 13 to 15 digits may be a phone or a card: both are proposed.
    digits = F.when(dotted, F.array(F.lit("ip"))).when(n < 13, F.array(F.lit("phone"))).when(n > 15, F.array(F.lit("card"))).otherwise(
        F.array(F.lit("card"), F.lit("phone")))
    kinds = F.when(F.col("by") == "spelt", F.array(F.lit("email"))).when(F.col("by") == "digits", digits).otherwise(F.array("by"))
    z = z.select("row_id", F.explode(kinds).alias("kind"), "by", F.col("by").isin(list(BASE)).alias("proper"), F.col("start").cast("long").alias("start"),
                 (F.col("start") + F.length("match")).cast("long").alias("end"), "match", "before", F.coalesce("after", F.lit("")).alias("after"))
    holds = F.when(F.col("proper"), _holds(F.col("kind"), F.col("match"))).otherwise(False)
    return rows.select("row_id", "doc_id"), spool(z.withColumn("base", holds).withColumn("label", _label()).drop("proper", "by"))


def _label() -> Column:
    """1 for a base span, 0 for what is none for certain, null for what only the trees can tell."""
    cued = lambda *kinds: F.regexp_like(F.lower("before"), F.lit("|".join(CUES[k] for k in kinds)))
    open_ = (F.when(F.col("by") == "spelt", F.regexp_like("match", F.lit(MARKED_AT)))
             .when(F.col("by") == "digits", cued("ip", "card", "phone"))
             .otherwise((F.col("by") == "card") & cued("phone")))  # a number after "tel" that is no card may be a phone
    return F.when(F.col("base"), 1.0).when(~open_, 0.0)


def _facts(p: DataFrame) -> DataFrame:
    """The trees' inputs: format and context, not the checks and not the base form."""
    plain = F.regexp_replace(F.regexp_replace("match", f" ?(?:{MARKED_AT}| at ) ?", "@"), f" ?(?:{MARKED_DOT}| dot ) ?", ".")
    m, before, after = F.when(F.col("kind") == "email", plain).otherwise(F.regexp_replace("match", "[+()]", "")), F.lower("before"), F.lower("after")
    digits = _digits(m)
    facts = {
        "f_kind": F.array_position(F.array(*[F.lit(k) for k in KIND_NAMES]), F.col("kind")),
        "f_length": F.length(m), "f_digits": F.length(digits), "f_letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "f_groups": F.size(F.split(m, "[^0-9]+")), "f_dots": F.length(F.regexp_replace(m, r"[^.]", "")),
        "f_dashes": F.length(F.regexp_replace(m, "[^-]", "")), "f_last_group": F.length(F.regexp_extract(m, "[0-9]*$", 0)),
        "f_marked_at": F.regexp_like("match", F.lit(MARKED_AT)), "f_sentence": F.regexp_like("match", F.lit(r"\. ")),
        "f_distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "f_glued_left": F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$")), "f_glued_right": F.regexp_like(after, F.lit(r"^[\p{L}\p{N}]")),
        "f_quoted": F.regexp_like(before, F.lit("[\"'=/#]$")), "f_line_start": before == "",
        **{f"f_cue_{k}": F.regexp_like(before, F.lit(c)) for k, c in CUES.items()},
    }
    return p.withColumns({k: c.cast("double") for k, c in facts.items()})


def _added(found: DataFrame) -> DataFrame:
    """row_id, kind, start, end of the proposals that the trees add."""
    none = found.select("row_id", "kind", "start", "end").where("1 = 0")
    place = ["row_id", "kind", "start", "end"]
    # A proposal that touches a base span shows nothing and is left out: such a base span starts no later and
    # ends inside or after it, or starts within it.  Both come from running extremes, which take one pass each.
    span = lambda c: F.when(F.col("base"), F.col(c))
    upto = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row_id").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("reached", F.max(span("end")).over(upto)).withColumn("next", F.min(span("start")).over(after))
    touches = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    # The same span may come from several generators; a sure negative decides over an open one.
    seen = F.struct(F.col("label").isNotNull().alias("sure"), "label", "base", "match", "before", "after")
    open_ = placed.where(F.col("base") | ~touches).groupBy(*place).agg(F.max(seen).alias("x")).select(*place, "x.*")
    examples = spool(_facts(open_).withColumn("draw", F.pmod(F.xxhash64("row_id", "start", "match"), F.lit(1 << 20))))
    n, right = examples.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if right < 20 or n - right < 20:
        discard(examples)
        return none
    inputs = [c for c in examples.columns if c.startswith("f_")]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features")
    learning = examples.where("label IS NOT NULL").where(F.col("draw") < int(min(0.75, TRAINING_ROWS / n) * (1 << 20)))
    sample = spool(vectors.transform(learning).select("features", "label"))
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        discard(examples, sample)
        return none
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(sample)
    scored = model.transform(vectors.transform(examples)).select(
        *place, "base", "label", "draw", vector_to_array("probability")[1].alias("p"))
    scored = spool(scored.withColumn("grade", F.least(F.floor(F.col("p") * GRADES), F.lit(GRADES - 1)).cast("int")))
    # Cut-offs: for each kind the lowest grade from which on the held-out examples are right often enough.
    held = scored.where("label IS NOT NULL").where(F.col("draw") >= int(0.75 * (1 << 20))).groupBy("kind", "grade").agg(F.count("*").alias("n"), F.sum("label").alias("right"))
    upward = Window.partitionBy("kind").orderBy(F.desc("grade"))  # GRADES rows a kind at most
    held = held.withColumns({"n": F.sum("n").over(upward), "right": F.sum("right").over(upward)})
    cut = {r.kind: r.grade for r in held.where(F.col("right") >= PRECISION * F.col("n")).groupBy("kind").agg(F.min("grade").alias("grade")).collect()}
    least = F.lit(GRADES)
    for kind, grade in cut.items():
        least = F.when(F.col("kind") == kind, F.lit(max(grade, GRADES // 2))).otherwise(least)
    good = scored.where(~F.col("base") & (F.col("grade") >= least))
    # Overlapping ones: runs of spans that touch, of which the most probable stays.
    by_start = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_start))
    best = runs.groupBy("row_id", "run").agg(F.max(F.struct("p", (-F.col("start")).alias("back"), "end", "kind")).alias("b"))
    out = spool(best.select("row_id", "b.kind", (-F.col("b.back")).alias("start"), "b.end"))
    discard(examples, sample, scored)
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), in the order of kinds, then of starts."""
    rows, found = proposals(docs, doc_id, text)
    added = _added(found)
    spans = found.where("base").select("row_id", "kind", "start", "end", F.lit(True).alias("base")).unionByName(
        added.select("row_id", "kind", "start", "end", F.lit(False).alias("base")))
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_NAMES]), F.col("kind")).alias("order")
    per_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(order, "start", "end", "kind", "base"))).alias("all"))
    bare = lambda a: F.transform(a, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    full = F.coalesce("all", F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean>>"))
    return rows.join(per_row, "row_id", "left").select(
        "doc_id", bare(F.filter(full, lambda s: s.base)).alias("base"), bare(full).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
