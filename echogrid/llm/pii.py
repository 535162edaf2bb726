"""Personal data: high-recall candidate spans, scored by boosted trees, cut at a calibrated threshold. Column expressions only.

All matches of a pattern and the gaps between them come from one split and one extraction; running sums of their lengths give
code point offsets. The trees are fitted by pyspark.ml on a bounded sample and read back as CASE expressions, so scoring is
one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.session import materialize

#: Fixed order of the kinds; the first four have base rules, the rest is found by the model alone.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Patterns in linear time: possessive groups never step back, and a run of address characters is entered at its start only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9_]))[A-Za-z0-9_]{20,}+",
}
#: Loose forms of the same kinds: the generators of the model.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}(?:\x20?(?:\.|[(\[](?:\.|dot)[)\]])\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    # groups of digits that stop before a dotted quad
    "phone": r"(?:\+|(?<![0-9.+]))(?:[0-9]{1,3}[\x20.-]{0,2}(?=\())?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20.-]{0,2}\([0-9]{1,5}\)|[\x20.-]{1,2}(?![0-9]{1,3}(?:\.[0-9]{1,3}){3})[0-9]{2,8}){1,6}(?![0-9])",
    "secret": PATTERNS["secret"],
}
#: A text without a match of the hint has no match of the pattern, loose or not.
HINTS = {"email": "@|[(\\[]at[)\\]]", "ip": "[0-9]\\x20?[.(\\[]", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9_]{20}"}
CUES = "(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|bearer|card|phone|tel|mobile|fax|call|mail|contact|address|ip|host|server)"
SECRET_CUES = "(?i)(?:token|secret|passw(?:or)?d|key|bearer)[\\x20\"'=:]{0,6}$"
#: Words of a kind shortly before a candidate.
OWN_CUES = {
    "email": "(?i)(?:mail|contact|write|address)[^\\n]{0,12}$",
    "ip": "(?i)(?:\\bip|host|server|address)[^\\n0-9]{0,12}$",
    "card": "(?i)(?:card|visa|amex|credit|debit)[^\\n0-9]{0,12}$",
    "phone": "(?i)(?:phone|\\btel|mobile|\\bcell|\\bfax|\\bcall|dial|whatsapp)[^\\n0-9]{0,12}$",
    "secret": SECRET_CUES,
}
#: Possessive as above: a long host name is read without recursion.
ADDRESS = r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"
ENDING = r"\.[A-Za-z]{2,}$"
#: An area code in brackets, no year, and two groups at least.
AREA = r"^\+?(?:[0-9]{1,3}[\x20.-]{0,2})?\((?!(?:19|20)[0-9]{2}\))[0-9]{2,5}\)[\x20.-]{0,3}[0-9]{2,4}[\x20.-]{1,3}[0-9]{2,5}"
#: Dotted quads and dates are no telephone numbers.
NO_PHONE = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|[0-9]{4}([-.])[0-9]{1,2}\1[0-9]{1,2}\b|[0-9]{1,2}([-.])[0-9]{1,2}\2[0-9]{4}\b)"
CONTEXT = 24
BLOCK = 64
#: Characters of the parts that a text is cut into before pieces of it are read.
PART = 2048
#: Format and context. What the weak labels rest on (a kind's own cue, its form, its sign, its number of digits) is not among them.
FEATURES = ("kind", "n", "letters", "upper", "seps", "parts", "distinct", "cue", "word_before", "word_after", "groups")
#: Rows of the trees' fit: at most so many candidates, an equal part by hash for each kind and label. The cuts see all candidates.
SAMPLE = 20_000
PRECISION = 0.95
#: Cut where the calibration part names none.
NEVER = 2.0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Does the digit string pass the Luhn test?"""
    d = lambda i: F.substring(s, F.length(s) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 0, d(i)).otherwise(d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0)))
    return (F.length(s) > 0) & (total % 10 == 0)


def valid(kind: str, s: Column) -> Column:
    """The base rule of a kind on a matched string."""
    digits = _digits(s)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(s, "\\."), lambda x: (F.length(part(x)) <= 3) & (F.concat(F.lit("0"), F.substring(part(x), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def plain_address(s: Column) -> Column:
    """An email candidate with its spelled-out [at] and [dot] written as signs."""
    return F.regexp_replace(F.regexp_replace(s, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")


def evidence(kind: str, s: Column, before: Column) -> Column:
    """Weak label of a candidate, from a cue of the kind before it, its form, and forms that speak against it.

    None of it is a feature of the trees, and none asks whether the base rule of the kind matches: an address counts in its normalised form, a telephone number by
    its sign, its bracketed area code or a cue before it, a card by its check digit (a short one beside a cue only).
    """
    cue, size = before.rlike(OWN_CUES[kind]), F.length(_digits(s))
    if kind == "email":
        plain = plain_address(s)
        return plain.rlike(ADDRESS) & plain.rlike(ENDING)
    if kind == "ip":
        plain = F.regexp_replace(s, r"\x20?[(\[]?(?:\.|dot)[)\]]?\x20?", ".")
        return valid("ip", plain) & (cue | (plain == s))
    if kind == "card":
        form = F.when(size.between(12, 19), luhn(_digits(s))).otherwise(False)
        return form & ((size >= 14) | cue)
    if kind == "phone":
        form, refuted = s.rlike(AREA), s.rlike(NO_PHONE)
        return ~refuted & (form | (cue & size.between(8, 15)) | (s.startswith("+") & size.between(10, 15)))
    return cue & s.rlike("[0-9]")


def once(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out a single time however often `use` reads it: a variable of a higher-order function is bound, an expression repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(lengths: Column) -> Column:
    """Sum of all earlier values, for every value of an array; in blocks, so that long arrays stay cheap."""
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    zero = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

    def summed(lengths: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
        return once(F.transform(blocks, lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))), inner)

    def inner(cut: Column) -> Column:
        sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        starts = F.aggregate(sums, zero(F.lit(0)), add)["out"]
        return F.flatten(F.zip_with(cut, starts, lambda c, at: F.aggregate(c, zero(at), add)["out"]))

    return once(lengths, lambda x: F.when(F.size(x) > 0, summed(x)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, hint: str, context: bool = False) -> Column:
    """array<struct<start, end, found>> of the leftmost matches, offsets in code points, end exclusive.

    With `context` also `before`, the last CONTEXT characters since the match before it began, and `after`, the next one. All of
    it comes from the gaps between matches, so the time grows with the text, not with its square.
    """
    kind = "start: int, end: int, found: string" + (", before: string, after: string" if context else "")
    none = F.array().cast(f"array<struct<{kind}>>")

    def spans(found: Column, gaps: Column, heads: Column) -> Column:
        step = F.zip_with(heads, found, lambda g, m: F.length(g) + F.length(m))
        ends = once(step, lambda step: F.zip_with(running_sums(step), step, lambda a, s: a + s))
        out = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))
        if context:
            earlier = F.slice(F.concat(F.array(F.lit("")), found), F.lit(1), F.size(found))
            before = F.zip_with(earlier, heads, lambda m, g: F.substring(F.concat(m, g), -CONTEXT, CONTEXT))
            later = F.slice(F.concat(found, F.array(F.lit(""))), F.lit(2), F.size(found))
            after = F.zip_with(F.slice(gaps, F.lit(2), F.size(found)), later, lambda g, m: F.substring(F.concat(F.substring(g, 1, 1), F.substring(m, 1, 1)), 1, 1))
            around = F.zip_with(before, after, lambda x, y: F.struct(x.alias("before"), y.alias("after")))
            out = F.zip_with(out, around, lambda m, c: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), c["before"].alias("before"), c["after"].alias("after")))
        return out

    # the gaps are cut out only where something was found
    cut = lambda found: once(F.split(text, pattern, -1), lambda gaps: once(F.slice(gaps, F.lit(1), F.size(found)), lambda heads: spans(found, gaps, heads)))
    every = once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, cut(found)).otherwise(none))
    return F.when(text.rlike(hint), every).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the four base rules, sorted by start, then kind."""
    def kept(n: int, kind: str) -> Column:
        return F.transform(F.filter(matches(text, PATTERNS[kind], HINTS[kind]), lambda m: valid(kind, m["found"])),
                           lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[kept(n, k) for n, k in enumerate(BASE)]))


def candidates(text: Column) -> Column:
    """Spans of all loose generators, overlapping as they may, with the features of format and context."""
    def described(n: int, kind: str) -> Column:
        def one(m: Column) -> Column:
            s, before, after = m["found"], m["before"], m["after"]
            count = lambda p: F.length(F.regexp_replace(s, p, "")).cast("double")
            good = evidence(kind, s, before)
            values = {
                "kind": F.lit(float(n)), "n": F.length(s).cast("double"), "letters": count("[^A-Za-z]"), "upper": count("[^A-Z]"), "seps": count("[A-Za-z0-9]"),
                "parts": count("[^.]"), "distinct": F.size(F.array_distinct(F.split(s, ""))).cast("double"), "cue": before.rlike(CUES + "[^\\n]{0,8}$").cast("double"),
                "word_before": before.rlike("[A-Za-z0-9]$").cast("double"), "word_after": after.rlike("[A-Za-z0-9]").cast("double"),
                "groups": F.size(F.split(s, "[^0-9]+")).cast("double")}
            return F.struct(m["start"].alias("start"), F.lit(n).alias("kind_no"), m["end"].alias("end"), good.alias("good"), *[values[f].alias(f) for f in FEATURES])
        return F.transform(matches(text, LOOSE[kind], HINTS[kind], context=True), one)

    return F.concat(*[described(n, k) for n, k in enumerate(KINDS)])


# -- boosted trees -------------------------------------------------------------------------------------------------------

def _tree(lines: list[str], value) -> Column:
    """One tree of the model's published text form as nested conditions."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    test = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line)
    low = _tree(lines, value)
    lines.pop(0)  # Else
    high = _tree(lines, value)
    column = value(FEATURES[int(test[1])])
    return F.when(column <= float(test[3]) if test[2] == "<=" else column > float(test[3]), low).otherwise(high)


def _trees(model: GBTClassificationModel) -> list[tuple[float, list[str]]]:
    return [(weight, [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]) for tree, weight in zip(model.trees, model.treeWeights, strict=True)]


class Model:
    """Boosted trees and the threshold of each kind."""

    def __init__(self, trees: list[tuple[float, list[str]]], cuts: dict[int, float]):
        self.trees, self.cuts = trees, cuts

    def score(self, value) -> Column:
        margin = reduce(lambda a, b: a + b, [_tree(list(lines), value) * weight for weight, lines in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def chosen(self, c: Column) -> Column:
        cut = reduce(lambda acc, kv: F.when(c["kind_no"] == kv[0], kv[1]).otherwise(acc), self.cuts.items(), F.lit(NEVER))
        return self.score(lambda f: c[f]) >= cut


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, loose: Column | None = None) -> Model:
    """Fit on a bounded draw of candidates, at most `sample` in all and as many for each kind and label, and calibrate on all.

    Candidates of equal features are one row with their number. Rows are drawn by a hash of label and features, so the same
    documents give the same model however they are dealt out.

    Labels are weak and rest on `evidence`, not on the base rules, so that loose forms outside the base can be good. The cut of
    a kind is the lowest tenth of the score from which on at least `precision` of the candidates of all documents are good; a
    kind without one adds nothing. Where all candidates are good, all are added; where none is, nothing. `loose` is what
    `candidates` gives for the texts, if the caller has it.
    """
    counted = docs.select(F.explode(candidates(F.coalesce("text", F.lit(""))) if loose is None else loose)).select("col.*").groupBy("kind_no", "good", *FEATURES).agg(F.count("*").alias("n_rows"))
    counted = materialize(counted.withColumn("draw", F.xxhash64("kind_no", "good", *FEATURES, F.lit(3))))
    strata = counted.select("kind_no", "good").distinct().orderBy("kind_no", "good").collect()
    if not any(r["good"] for r in strata):
        return Model([], {})
    if all(r["good"] for r in strata):
        return Model([(1.0, ["Predict: 1.0"])], {r["kind_no"]: 0.5 for r in strata})
    drawn = reduce(DataFrame.unionByName, [counted.where((F.col("kind_no") == r["kind_no"]) & (F.col("good") == r["good"])).orderBy("draw", *FEATURES).limit(max(sample // (2 * len(KINDS)), 1)) for r in strata])
    # the weight grows with the logarithm of the number: a thousand copies of a page teach little more than a few
    data = drawn.withColumn("label", F.col("good").cast("double")).withColumn("weight", F.log2(F.col("n_rows") + 1))
    data = materialize(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("label", "weight", "features"))
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=5, weightCol="weight").fit(data)
    trees = _trees(model)
    score = Model(trees, {}).score(F.col)
    bins = counted.groupBy("kind_no", F.floor(score * 10).alias("bin")).agg(F.sum("n_rows").alias("n"), F.sum(F.when(F.col("good"), F.col("n_rows")).otherwise(0)).alias("good")).collect()
    cuts = {}
    for kind in {r["kind_no"] for r in bins}:
        for low in range(5, 10):
            above = [r for r in bins if r["kind_no"] == kind and r["bin"] >= low]
            if above and sum(r["good"] for r in above) >= precision * sum(r["n"] for r in above):
                cuts[kind] = low / 10
                break
    return Model(trees, cuts)


def found_spans(docs: DataFrame, model: Model | None = None) -> Column:
    """struct<base, every>: the base spans, and all spans: the model's join the base ones, equal spans of a kind once.

    Without a model one is fitted on `docs`. The patterns are put into columns once, for the fit and the search, and before the
    fit: its many short jobs let the driver's heap grow, and what the driver makes afterwards fills that room.
    """
    text = F.coalesce("text", F.lit(""))
    loose, fixed = candidates(text), base_spans(text)
    model = model or fit(docs, loose=loose)
    added = F.transform(F.filter(loose, model.chosen), lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind"), c["end"].alias("end")))
    return once(fixed, lambda base: F.struct(base.alias("base"), F.array_sort(F.array_distinct(F.concat(base, added))).alias("every")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def pii_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row. Null and empty texts have no spans.

    Repeated rows and null doc_ids stay rows of their own. An empty table gives no rows.
    """
    spanned = docs.select("doc_id", found_spans(docs, model).alias("found"))
    number = lambda n: F.size(F.filter("found.base", lambda s: s["kind"] == n)).cast("long")
    counts = [number(n).alias(f"n_{k}") for n, k in enumerate(BASE)]
    return spanned.select("doc_id", *counts, F.sha2(_written(F.col("found.base")), 256).alias("base_sha256"), _written(F.col("found.every")).alias("spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets, overlapping spans by the kind of the first.

    Null texts stay null. A column n_chars, where there is one, follows the new text.
    """
    every = found_spans(docs, model)["every"]
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    # spans inside lambdas only, so that no column name is taken; blocks, so that long arrays and texts stay cheap
    block = lambda spans, b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))
    keep = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"), F.get(names, s["kind"]).alias("name"))))).alias("out"))
    zero = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<struct<from: int, to: int, name: string>>").alias("out"))

    def cuts(spans: Column) -> Column:
        """What lies before each kept span, and its name: struct(at, array of arrays)."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<from: int, to: int, name: string>>>").alias("out"))
        return F.aggregate(blocks, start, lambda acc, b: F.element_at(F.transform(F.array(F.aggregate(block(spans, b), zero(acc["at"]), keep)), lambda one: F.struct(
            one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))), 1))

    def written(parts: Column, cut: Column) -> Column:
        """The text again: pieces between the cuts, read from parts of PART characters."""
        first = lambda a: F.floor(a / PART).cast("int")
        piece = lambda a, b: F.substring(F.array_join(F.slice(parts, first(a) + 1, first(b) - first(a) + 1), ""), a - first(a) * PART + 1, b - a)
        said = F.array_join(F.transform(F.flatten(cut["out"]), lambda c: F.concat(piece(c["from"], c["to"]), c["name"])), "")
        return F.concat(said, piece(cut["at"], F.length(text)))

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PART), F.lit(0))
    clean = F.element_at(F.transform(F.array(every), lambda spans: F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), cuts(spans).alias("cut"))), lambda x: written(
        x["parts"], x["cut"])), 1)).otherwise(text)), 1)
    out = docs.withColumn("text", F.when(text.isNotNull(), clean))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
