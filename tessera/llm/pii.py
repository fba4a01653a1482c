"""Personal data: base patterns, and candidates chosen by gradient-boosted trees.

Everything is DataFrame expressions; a row's spans are found without a shuffle.

* Base spans are the leftmost non-overlapping matches of four patterns that pass their check. They
  are always selected. The patterns are written without needless backtracking (a run is entered
  at its start only), so long runs cost linear time.
* High-recall generators propose more spans, overlapping ones too: loose digit groups, spelled-out
  addresses, key-value secrets and long mixed tokens. Secrets and tokens are proposed whole, however long.
* Boosted trees (fitted by Spark on every document) score a candidate from its format and from
  the text around it. The labels do not follow the base patterns, which are always selected anyway.
  Positive: base spans of the table written in forms that the base patterns miss (``PHONE_FORMS``,
  ``CARD_FORMS``, ``MAIL_FORMS``, values of secrets without their key word), such forms of made-up numbers and names, and
  strict secret formats. Negative: made-up runs (``RUN_FORMS``: dates, ranges, decimals, long numbers;
  digests, joined words, sentences around "at"), and the table's own candidates whose shape no
  positive form has. Candidates of such a shape are unlabelled and take no part. The made-up ones
  are there whatever the table holds. The trees are applied as nested SQL conditions, one expression per row.
* Per kind, the threshold is the lowest score from which on the precision on the
  calibration part (a quarter of the documents) is at least ``PRECISION``; a kind that never reaches it adds nothing. Strict
  secrets are chosen at any score, as the trees have not seen all lengths. Chosen
  candidates that overlap a base span or an earlier chosen one are left out.
* A bare run of lower-case hex digits counts as a digest, not as a secret. Loose digit groups are
  proposed up to 32 characters and spelled-out addresses of at most 64 characters a part and six
  parts after the first.

Every row teaches, repeated ones each time. Examples of equal features and label are counted and
enter the trees and thresholds once, with their number as weight.

Nulls: a null text is empty. Null ids and repeated rows are returned as they are; a row without an
id is put to the trees or the calibration by its text. A table without rows is read by what the made-up
examples teach. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import explode_array, let
from tessera.llm.common import materialise, prepare

PRECISION = 0.995
TREES, DEPTH, STEP = 10, 5, 0.5
#: Made-up examples of each form.
MADE_UP = 200
#: Distinct examples of a partition of the trees' input.
EXAMPLES_EACH = 100_000
CONTEXT = 24
#: Items of an array handled together, and characters of a text cut together: speed only, no effect on results.
BLOCK, PART = 256, 4096

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]

# The base patterns. Possessive quantifiers and the look-behinds change no match: they only keep
# the matcher from entering a run again that it has already refused.
_MAIL_CHAR = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL_CHAR})){_MAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind, or a candidate of the generator.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]",
          "digits": r"[0-9][0-9 ().\-/]{5}", "spelled": r"(?i)[\[(] ?at ?[\])]",
          "keyed": r"(?i)(?:passw|secret|token|api.?key)", "mixed": r"[A-Za-z0-9]{16}"}
GENERATORS = {
    "digits": r"(?<![0-9])\+?\(?[0-9][0-9 ().\-/]{5,30}[0-9]",
    "spelled": r"(?i)(?<![\w.%+-])[\w.%+-]{1,64} ?[\[(] ?at ?[\])] ?[\w-]{1,64}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]{1,64}){1,6}",
    "keyed": r"(?i)(?:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}\"?[^\s\"]{6,}+\"?",
    "mixed": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: Secrets whose format alone tells them.
STRICT_SECRET = (r"^(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}"
                 r"\"?(?=[^\s\"]*[0-9])[^\s\"]{8,}+\"?)$")
# Forms of numbers: each d takes the next digit. Positive ones are not matched by the base patterns.
PHONE_FORMS = ["(ddd) ddd-dddd", "(ddd) ddd dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "(0dd) dddd dddd", "(0dd) dddddddd",
               "0dd dddd dddd", "0dd dddddddd", "0ddd-ddddddd", "0dd-dddddddd", "0ddd/dddddd", "0dd/dddddddd"]
CARD_FORMS = ["dddd.dddd.dddd.dddd", "dddd - dddd - dddd - dddd", "dddd/dddd/dddd/dddd"]
RUN_FORMS = ["20dd-0d-1d", "1d.0d.20dd", "0d/1d/19dd", "19dd-20dd", "19dd - 20dd", "20dd-0d-1d 1d", "dd.ddd.ddd", "d ddd ddd",
             "d ddd ddd ddd", "ddd,ddd.dd", "d.ddddddd", "dd.dddddddddd", "978-d-dd-dddddd-d", "d.d.d.d.d", "dddd-dddd", "dd-dd-dd-dd",
             "(19dd) 20dd", "ddddddd", "ddddddddd", "dddddddddd", "dddddddddddd", "dddddddddddddddd dddddddddddddddd", *CARD_FORMS]
MAIL_FORMS = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), (" (at) ", ".")]
_CUES = {"phone": ["call ", "tel. ", "phone: ", "reach us on "], "card": ["card ", "paid with ", "visa: "],
         "email": ["mail ", "contact: ", "write to "], "secret": ["key ", "use ", "aws: "]}
_NEUTRAL = ["it was ", "and the ", "of ", "(", "que la ", "von der ", "is "]
_RUN_CUES = ["on ", "in ", "order ", "page ", "total of ", "version ", "commit ", "sha256 "]
_AFTER = [" and th", ".", ", ", " ", ") it", "\n"]

_WORDS_BEFORE = {"mail": "mail|contact", "phone": "tel|phone|call|fax|mobil",
                 "card": "card|visa|karte|carte|tarjeta", "host": r"\bip\b|server|host|addr",
                 "secret": "passw|secret|token|key|aws"}

_SPAN = "array<struct<start:long,end:long,s:string,before:string,after:string>>"
_KINDED = "array<struct<start:long,end:long,kind:string>>"
_CANDIDATE = "array<struct<kind:string,start:long,end:long,s:string,before:string,after:string>>"


def running(items: Column, zero: Column, step, state: str) -> Column:
    """The state (of type ``state``) after each item. An array is copied when it grows, so states are gathered in
    blocks of ``BLOCK``. ``items`` should be a bound value."""
    def block(acc, b):
        own = F.slice(items, b * BLOCK + 1, F.lit(BLOCK))

        def one(st, x):
            return let(step(st["last"], x), lambda s: F.struct(s.alias("last"), F.array_append(st["out"], s).alias("out")))

        return F.aggregate(own, F.struct(acc["last"].alias("last"), F.array().cast(f"array<{state}>").alias("out")), one,
                           lambda st: F.struct(st["last"].alias("last"), F.array_append(acc["out"], st["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int"))
    begin = F.struct(zero.alias("last"), F.array().cast(f"array<array<{state}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, begin, block, lambda acc: acc["out"]))


def found(text: Column, pattern: str, needs: str) -> Column:
    """Matches of a pattern: start and end in code points, text, and the text around them.

    The pieces between the matches give the positions: a match starts after all earlier pieces
    and matches.
    """
    gap = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), gap.alias("gap"),
                         F.slice(gap, 2, F.greatest(F.size(gap), F.lit(1))).alias("next"))
    def spans(parts):
        ends = running(parts, F.lit(0).cast("long"), lambda at, x: at + F.length(x["gap"]) + F.length(x["s"]), "bigint")
        return F.zip_with(parts, ends, lambda x, end: F.struct(
            (end - F.length(x["s"])).alias("start"), end.alias("end"), x["s"].alias("s"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(8)).alias("after")))

    return (F.when(text.rlike(needs), let(F.filter(parts, lambda x: x["s"].isNotNull()), spans))
            .otherwise(F.array().cast(_SPAN)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i):
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits_of(s))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(s))).otherwise(F.lit(False))
    return n.between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, BASE[kind], _NEEDS[kind]), lambda x: _passes(kind, x["s"]))


def _kind_of(generator: str, s: Column) -> Column:
    if generator == "digits":
        n = F.length(digits_of(s))
        return (F.when(s.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
                .when(n.between(13, 19) & ~s.startswith("+"), "card").otherwise("phone"))
    return F.lit("email" if generator == "spelled" else "secret")


def candidates(text: Column) -> Column:
    """Proposed spans of all generators; they may overlap."""
    def proposed(generator):
        return F.transform(found(text, GENERATORS[generator], _NEEDS[generator]), lambda x: F.struct(
            _kind_of(generator, x["s"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))

    return F.flatten(F.array(*map(proposed, GENERATORS))).cast(_CANDIDATE)


def _overlaps(x: Column, kinds: list[Column]) -> Column:
    """Whether x overlaps a span of one of ``kinds``, each a list of disjoint spans in order (binary search)."""
    def hits(spans):
        n = F.size(spans)
        powers = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

        def further(at, power):
            def to(there):
                inside = (there <= n) & (F.get(spans, there - 1)["start"] < x["end"])
                return F.when(inside, there).otherwise(at)
            return let(at + F.pow(F.lit(2), power).cast("int"), to)

        # of the spans that start before x ends, the last one ends last
        last = F.aggregate(powers, F.lit(0), further)
        return let(last, lambda i: (i > 0) & (F.get(spans, i - 1)["end"] > x["start"]))

    out = F.lit(False)
    for spans in kinds:
        out = out | F.when(F.size(spans) > 0, hits(spans)).otherwise(F.lit(False))
    return out


def features(x: Column) -> dict[str, Column]:
    """Numbers that describe a candidate's format and surroundings."""
    s, length = x["s"], F.length(x["s"])

    def n(chars):
        return length - F.length(F.regexp_replace(s, chars, ""))

    out = {"length": length, "digits": n("[0-9]"), "letters": n("[A-Za-z]"), "upper": n("[A-Z]"),
           "dots": n(r"\."), "dashes": n("-"), "blanks": n(" "), "brackets": n(r"[()\[\]]"),
           "equals": n("[=:]"), "quotes": n('"'), "slashes": n("/"),
           "distinct": F.size(F.array_distinct(F.split(s, ""))),
           "plus": s.startswith("+"), "hex": s.rlike("^[0-9a-f]+$"),
           "changes": F.size(F.split(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1,
           "groups": F.size(F.split(s, "[0-9]+")) - 1, "first": F.length(F.regexp_extract(s, "[0-9]+", 0)),
           "last": F.length(F.regexp_extract(s, "([0-9]+)[^0-9]*$", 1)), "zero": s.rlike(r"^\(?0"), "gaps": n(r"[.\])] "),
           "classes": sum((s.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0)),
           "luhn": F.when(x["kind"] == "card", luhn(digits_of(s))).otherwise(F.lit(False)),
           "after_word": x["before"].rlike(r"\w$"), "before_word": x["after"].rlike(r"^\w")}
    out |= {f"near_{k}": x["before"].rlike(f"(?i){w}") for k, w in _WORDS_BEFORE.items()}
    out |= {f"is_{k}": x["kind"] == k for k in KINDS}
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class SpanModel:
    """Fitted trees as nested tuples (feature, threshold, left, right) or leaf values."""

    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def score(self, x: Column) -> Column:
        return let(F.array(*features(x).values()), lambda v: self.of(lambda i: F.get(v, F.lit(i))))

    def of(self, value) -> Column:
        """The score, given how to read a feature by its number."""
        return sum((w * _walk(t, value) for t, w in zip(self.trees, self.weights)), F.lit(0.0))

    def selects(self, x: Column) -> Column:
        strict = x["s"].rlike(STRICT_SECRET)  # whatever the table held
        if not self.thresholds:
            return strict
        least = F.coalesce(*[F.when(x["kind"] == k, F.lit(t)) for k, t in self.thresholds.items()])
        return F.coalesce(self.score(x) >= least, F.lit(False)) | strict


def _walk(node, value) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    i, t, left, right = node
    return F.when(value(i) <= t, _walk(left, value)).otherwise(_walk(right, value))


def _tree(node):
    if node.numDescendants() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """Per kind, the lowest score bin from which on the precision is high enough."""
    bins = (scored.groupBy("kind", F.floor(F.col("score") * 50).alias("bin"))
            .agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect())
    out = {}
    for kind in KINDS:
        good = n = 0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            good, n = good + b["good"], n + b["n"]
            if good >= PRECISION * n:
                out[kind] = b["bin"] / 50
    return out


def _written(form: str, digits: Column) -> Column:
    """A form with its d's replaced by the leading digits."""
    parts, at = [], 1
    for run in re.findall("d+|[^d]+", form):
        parts.append(F.substring(digits, at, len(run)) if run[0] == "d" else F.lit(run))
        at += len(run) if run[0] == "d" else 0
    return F.concat(*parts)


def _example(kind: Column, s: Column, before: Column, after: Column, good: bool | Column) -> Column:
    # the generator takes an opening bracket with the digits
    opened = kind.isin("phone", "card") & before.endswith("(") & ~s.startswith("(")
    s = F.when(opened, F.concat(F.lit("("), s)).otherwise(s)
    before = F.when(opened, F.left(before, F.length(before) - 1)).otherwise(before)
    at = F.length(before).cast("long")
    x = F.struct(kind.alias("kind"), at.alias("start"), (at + F.length(s)).alias("end"), s.alias("s"),
                 before.alias("before"), after.alias("after"))
    return F.struct(x.alias("x"), F.lit(good).alias("good"))


def _rewriter(kind: str):
    """From a base span of the table, its examples in all forms that the base pattern misses."""
    return lambda x: _rewritten(kind, x)


def _rewritten(kind: str, x: Column) -> Column:
    if kind == "email":
        user, host = F.substring_index(x["s"], "@", 1), F.substring_index(x["s"], "@", -1)
        forms = [F.concat(user, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in MAIL_FORMS]
    elif kind == "phone":
        forms = [_written(f, F.rpad(F.right(digits_of(x["s"]), F.lit(10)), 10, "5")) for f in PHONE_FORMS]
    else:
        forms = [F.when(F.length(digits_of(x["s"])) == 16, _written(f, digits_of(x["s"]))) for f in CARD_FORMS]
    return F.transform(F.filter(F.array(*forms), lambda s: s.isNotNull()),
                       lambda s: _example(F.lit(kind), s, x["before"], x["after"], True))


def _made_up(spark) -> DataFrame:
    """``MADE_UP`` examples of each form, from hashes of their numbers: ``_order``, ``_m``."""
    hashed = F.col("_hash")
    digits, pick = F.translate(hashed, "abcdef", "135792"), F.col("_order")
    letters = F.translate(hashed, "0123456789", "ghiklmnoprst"[:10])
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hashed, hashed))), "[^A-Za-z0-9]", "")

    def one_of(words, by):
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))

    def checked(number):  # sixteen digits that pass Luhn
        ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda e: F.concat(F.substring(number, 1, 15), e.cast("string")))
        return F.element_at(F.filter(ends, luhn), 1)

    odd = F.pmod(F.shiftright(pick, 24), F.lit(4))
    user = F.concat(F.substring(letters, 1, 4), F.when(odd == 0, F.concat(F.lit("."), F.substring(letters, 8, 4)))
                    .when(odd == 1, F.substring(digits, 20, 2)).otherwise(F.lit("")))
    host = F.concat(F.substring(letters, 30, 5), F.when(odd > 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.substring(letters, 40, 2))))
    top = one_of(["com", "org", "net", "de", "edu", "co.uk"], F.shiftright(pick, 32))
    words = F.concat(F.initcap(F.substring(letters, 1, 6)), F.initcap(F.substring(letters, 9, 7)), F.initcap(F.substring(letters, 20, 6)))
    # kind (None: as the generator tells it), text, label
    forms = [("phone", _written(f, digits), True) for f in PHONE_FORMS]
    forms += [("card", _written(f, checked(digits)), True) for f in CARD_FORMS]
    forms += [("email", F.concat(user, F.lit(at), host, F.lit(dot), F.replace(top, F.lit("."), F.lit(dot))), True) for at, dot in MAIL_FORMS]
    forms += [("secret", F.substring(mixed, 1, n), True) for n in (20, 32, 40)]
    forms += [(None, _written(f, digits), False) for f in RUN_FORMS]
    forms += [("email", F.concat(F.substring(letters, 1, 4), F.lit(f" {at} "), F.initcap(F.substring(letters, 9, 6)), F.lit(". "),
                                 F.initcap(F.substring(letters, 20, 3))), False) for at in ("(at)", "[at]")]
    forms += [("secret", s, False) for s in
              (F.substring(hashed, 1, 32), F.substring(hashed, 1, 40), hashed, words, F.lower(words), F.upper(words),
               F.substring(digits, 1, 18), F.concat(F.lower(words), F.substring(digits, 1, 4)))]
    rows = spark.range(MADE_UP * len(forms)).select(
        F.pmod("id", F.lit(len(forms))).cast("int").alias("_form"), F.xxhash64("id").alias("_order"),
        F.sha2(F.col("id").cast("string"), 256).alias("_hash"))
    rows = rows.select("_order", "_form", F.coalesce(*[F.when(F.col("_form") == i, s) for i, (_, s, _) in enumerate(forms)]).alias("_s"))
    told = F.get(F.array(*[F.lit(k) for k, _, _ in forms]), F.col("_form"))
    rows = rows.select("_order", "_s", F.coalesce(told, _kind_of("digits", F.col("_s"))).alias("_kind"),
                       F.get(F.array(*[F.lit(g) for _, _, g in forms]), F.col("_form")).alias("_good"))
    # half of the contexts are those of the label, half any
    half = F.shiftright(pick, 8)
    cues = one_of(_RUN_CUES, half)
    for kind, words_before in _CUES.items():
        cues = F.when(F.col("_good") & (F.col("_kind") == kind), one_of(words_before, half)).otherwise(cues)
    before = F.when(F.pmod(pick, F.lit(2)) == 0, cues).otherwise(one_of([*_NEUTRAL, *_RUN_CUES, *sum(_CUES.values(), [])], half))
    good = F.col("_good") | ((F.col("_kind") == "card") & luhn(digits_of(F.col("_s"))))
    return rows.select("_order", _example(F.col("_kind"), F.col("_s"), before, one_of(_AFTER, F.shiftright(pick, 16)), good).alias("_m"))


def _own(x: Column, overlapping: Column) -> Column:
    """The label of a candidate of the table; null where it is not known."""
    shapes = [f.replace("d", "0") for f in PHONE_FORMS + CARD_FORMS]
    strict, s = x["s"].rlike(STRICT_SECRET), x["s"]
    loose = x["kind"].isin("phone", "card") & ~F.regexp_replace(F.regexp_replace(s, r"^\((?=[^)]*$)", ""), "[0-9]", "0").isin(shapes)
    digest = s.rlike("^[0-9a-f]+$") & ~x["before"].rlike(f"(?i){_WORDS_BEFORE['secret']}")
    plain = (x["kind"] == "secret") & (s.rlike("^[A-Za-z]+$|^[0-9]+$") | digest)
    return F.when(strict, True).when(overlapping, None).when(loose | plain, False)


def _counted(rows: DataFrame) -> DataFrame:
    """Examples (``_order``, ``_m``) as kind, label, part and features, each distinct one once with its ``weight``."""
    named = {f"f_{k}": v for k, v in features(F.col("x")).items()}
    rows = rows.select("_order", "_m.x", "_m.good").select(
        "x.kind", F.col("good").cast("double").alias("label"), F.pmod("_order", F.lit(4)).alias("_part"),
        *[v.alias(k) for k, v in named.items()])
    return rows.groupBy("kind", "label", "_part", *named).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _examples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the documents teach, every row of them: their own candidates, and their base spans in other forms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bases = [f"_base_{k}" for k in BASE_KINDS]
    spans = docs.select(F.col(id_col).cast("string").alias("_id"), text.alias("_text")).select(
        F.xxhash64(F.coalesce("_id", "_text")).alias("_order"), candidates(F.col("_text")).alias("_all"),
        *[base_spans(F.col("_text"), k).alias(b) for k, b in zip(BASE_KINDS, bases)])
    own = F.transform("_all", lambda x: F.struct(x.alias("x"), _own(x, _overlaps(x, [F.col(b) for b in bases])).alias("good")))
    bare = F.transform(F.filter("_all", lambda x: x["s"].rlike(STRICT_SECRET)), lambda x: _example(
        F.lit("secret"), F.regexp_extract(x["s"], r"[=:][ \t]{0,3}\"?([A-Za-z0-9]{16,})\"?$", 1), F.lit(""), x["after"], True))
    other = [F.flatten(F.transform(b, _rewriter(k))) for k, b in zip(BASE_KINDS, bases) if k != "ip"]
    kept = F.filter(F.concat(own, *other, F.filter(bare, lambda e: ~e["x"]["s"].rlike("^[0-9a-f]*$"))), lambda m: m["good"].isNotNull())
    return explode_array(spans.select("_order", kept.alias("_ms")), "_ms", "_at", "_m").select("_order", "_m")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Trees and thresholds from every document."""
    prepare(docs.sparkSession)
    # each stored by a job of its own: a projection over their union would be planned and compiled twice at once
    taught = [materialise(_counted(rows), "pii-examples")
              for rows in (_examples(docs, id_col, text_col), _made_up(docs.sparkSession))]
    rows = taught[0].unionByName(taught[1])
    named = [c for c in rows.columns if c.startswith("f_")]
    vectors = VectorAssembler(inputCols=named, outputCol="features")
    own = rows.where("_part > 0")
    # partitions follow the data alone, so that the same table gives the same trees
    own = own.repartition(max(4, -(-own.count() // EXAMPLES_EACH)), *named).sortWithinPartitions("kind", "label", "_part", *named, "weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, cacheNodeIds=False, weightCol="weight").fit(
        vectors.transform(own))
    model = SpanModel([_tree(t._java_obj.rootNode()) for t in trees.trees], list(trees.treeWeights))
    score = model.of([F.col(k) for k in named].__getitem__)
    model.thresholds = _thresholds(rows.where("_part = 0").select("kind", "label", "weight", score.alias("score")))
    return model


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                 F.lit(kind).alias("kind")))


def _only(spans: str, kind: str) -> Column:
    return F.array_sort(F.filter(spans, lambda x: x["kind"] == kind))


def with_spans(rows: DataFrame, text: Column, model: SpanModel) -> DataFrame:
    """``rows`` with ``_base_<kind>`` for each base kind and ``_spans``: all selected spans by start."""
    rows = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    rows = rows.withColumns({f"_base_{k}": _named(base_spans(F.col("_text"), k), k) for k in BASE_KINDS})
    bases = [F.col(f"_base_{k}") for k in BASE_KINDS]
    rows = rows.withColumn("_cand", candidates(F.col("_text")))
    chosen = F.filter("_cand", lambda x: ~_overlaps(x, bases) & model.selects(x))
    more = F.array_sort(F.transform(chosen, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.withColumn("_more", F.when(F.size("_cand") > 0, let(more, _first)).otherwise(F.array().cast(_KINDED)))
    return rows.withColumn("_spans", F.concat(*bases, "_more"))


def _first(spans: Column) -> Column:
    """Of spans in order, those that overlap no earlier one that is kept."""
    def step(st, x):
        free = x["start"] >= st["end"]
        return F.struct(F.when(free, x["end"]).otherwise(st["end"]).alias("end"), free.alias("free"))

    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(True).alias("free"))
    states = running(spans, begin, step, "struct<end:bigint,free:boolean>")
    kept = F.filter(F.arrays_zip(spans.alias("x"), states.alias("st")), lambda z: z["st"]["free"])
    return F.transform(kept, lambda z: z["x"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
           model: SpanModel | None = None) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans as kind:start:end."""
    prepare(docs.sparkSession)
    model = model or fit(docs, id_col, text_col)
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw")),
                      F.col("_raw"), model)
    base = F.concat(*[F.col(f"_base_{k}") for k in BASE_KINDS])
    by_kind = F.flatten(F.array(*[_only("_spans", k) for k in KINDS]))
    return rows.select("doc_id", *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                       F.sha2(_joined(base), 256).alias("base_sha256"), _joined(by_kind).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans share one."""
    def step(st, x):
        return F.struct(st["at"].alias("since"), F.greatest(st["at"], x["end"]).alias("at"),
                        (x["start"] >= st["at"]).alias("opens"))

    begin = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("since", "at")], F.lit(True).alias("opens"))

    def joined(ordered, parts):
        def cut(start, end):
            # from the parts that hold it: a place in a string is found by walking to it
            first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
            held = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.get(parts, i), F.lit(""))), "")
            return F.substring(held, (start % PART + 1).cast("int"), (end - start).cast("int"))

        def with_states(states):
            opening = F.filter(F.arrays_zip(ordered.alias("x"), states.alias("st")), lambda z: z["st"]["opens"])
            kept = F.transform(opening, lambda z: F.concat(
                cut(z["st"]["since"], z["x"]["start"]), F.lit("["), F.upper(z["x"]["kind"]), F.lit("]")))
            end = F.element_at(states, -1)["at"]
            return F.concat(F.array_join(kept, ""), cut(end, F.greatest(end, F.length(text).cast("long"))))

        return let(running(ordered, begin, step, "struct<since:bigint,at:bigint,opens:boolean>"), with_states)

    whole = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.array_sort(spans), lambda o: let(whole, lambda p: joined(o, p)))).otherwise(text)
