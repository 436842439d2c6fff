"""Personal data by candidate gradient boosting, in DataFrame functions alone.

High-recall generators propose spans, which may overlap: four strict patterns
with validators (the base spans, which always stay) and loose patterns for
spaced or obfuscated forms and for credentials. Boosted trees, fitted on all
loose candidates as counts of equal ones, score one by its format and context.
Labels are weak: for a form of a strict kind, whether its normal form passes the
strict pattern and validator; for a credential, whether it stands after a word
for one, which is no feature there, so the trees learn the format and find
credentials without such a word too. Per kind the lowest score that reaches the
wanted precision on candidates not fitted on is the threshold; candidates over it
that touch no base span (credentials: any) are added. The trees are turned into
CASE expressions, so scoring is part of the generated code.

All patterns are possessive: they neither backtrack nor recurse, so very long
runs of digits or letters cost time in proportion to their length or, where no
pattern begins, at most its square within one run.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
STRICT = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"[0-9]{1,3}+(?:\x20?\.\x20?[0-9]{1,3}+){3}+",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11,}+",
    "phone": r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"[A-Za-z0-9+/_=-]{20,}+",
}
#: What a text must hold for a kind's patterns to be tried.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\x20?\.\x20?[0-9]", "card": r"[0-9][0-9\x20.-]{10}", "phone": r"\+[0-9]|[0-9][0-9\x20().-]{5}", "secret": r"[A-Za-z0-9+/_=-]{20}"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|card|visa|account|host|server|addr|ip)\W{0,3}$"

#: What stands before a credential.
CREDENTIAL = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credentials?)[\x20\"':=]{1,6}$"

#: A phone number without a plus: an area code in parentheses or with a leading zero and groups after it, or groups of three, three and four; not a date.
NATIONAL = r"^(?:(?:\([0-9]{2,5}\)|0[0-9]{2,4}(?=[\x20.-]))(?:[\x20.-]{0,2}[0-9]{2,8}){1,4}|[2-9][0-9]{2}[\x20.-][0-9]{3}[\x20.-][0-9]{4})$"

FEATURES = ("kind", "digits", "length", "gaps", "groups", "longest", "luhn", "octets", "dots", "before", "after", "cue")
#: Bounds of the fit: trees and their depth; precision wanted and cases that show it.
TREES, DEPTH, PRECISION, SUPPORT = 8, 3, 0.98, 5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: start, end (code points, exclusive) and the match itself."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    empty = F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, hit: string>>)").alias("out")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))).alias("out"))

    zipped = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.aggregate(zipped, F.struct(*empty), step, lambda s: s["out"])


def valid(kind: str, hit: Column) -> Column:
    """The validator of a kind."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def normal(kind: str, hit: Column) -> Column:
    """A loose form as the strict pattern has it: no obfuscation or spaces; a national phone number in groups gets a plus."""
    if kind == "email":
        out = F.regexp_replace(hit, r"\x20?(?:@|\(at\)|\[at\])\x20?", "@")
        return F.regexp_replace(out, r"\x20?(?:\(dot\)|\[dot\])\x20?", ".")
    if kind == "ip":
        return F.regexp_replace(hit, r"\x20", "")
    if kind == "card":
        return F.regexp_replace(hit, r"[\x20.-]", "")
    return F.when(hit.rlike(NATIONAL), F.concat(F.lit("+"), F.regexp_replace(hit, "[^0-9]", ""))).otherwise(hit)


def valid_form(kind: str, hit: Column) -> Column:
    """Whether the normal form is, as a whole, a match of the strict pattern that the validator accepts."""
    form = normal(kind, hit)
    return F.coalesce(form.rlike(f"^(?:{STRICT[kind]})$") & valid(kind, form), F.lit(False))


def _label(kind: str, text: Column, c: Column) -> Column:
    if kind != "secret":
        return valid_form(kind, c["hit"])
    before = F.substring(text, F.greatest(F.lit(1), c["start"] - 23), F.least(F.lit(24), c["start"]))
    return before.rlike(CREDENTIAL) & c["hit"].rlike("[0-9]") & c["hit"].rlike("[A-Za-z]")


def _features(kind: str, text: Column, c: Column) -> list[Column]:
    """Format and context of a loose candidate, as doubles in the order of FEATURES after the kind."""
    hit = c["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    runs = F.split(F.regexp_replace(hit, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    before = F.substring(text, F.greatest(F.lit(1), c["start"] - 23), F.least(F.lit(24), c["start"]))
    after = F.substring(text, c["end"] + 1, F.lit(1))
    luhn_ok = F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)) if kind == "card" else F.lit(False)
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.length(digits),
        "length": F.length(hit),
        "gaps": F.length(hit) - F.length(digits),
        "groups": F.size(runs),
        "longest": F.array_max(F.transform(runs, F.length)),
        "luhn": luhn_ok.cast("int"),
        "octets": hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$").cast("int"),
        "dots": F.length(F.regexp_replace(hit, "[^.]", "")),
        "before": (F.length(before) == 0).cast("int") + F.when(before.rlike(r"[\s:;,(\[\"'=]$"), 1).otherwise(0),
        "after": (F.length(after) == 0).cast("int") + F.when(after.rlike(r"[\s:;,.)\]\"'!?]"), 1).otherwise(0),
        "cue": before.rlike(CUES).cast("int") if kind != "secret" else F.lit(0),
    }
    return [F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]


def _strict(k: int, kind: str) -> Column:
    good = F.filter(f"strict_{kind}", lambda c: valid(kind, c["hit"]))
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(k).alias("k"), c["end"].alias("end")))


def _candidates(k: int, kind: str) -> Column:
    """Loose candidates with their label and features."""

    def shaped(c: Column) -> Column:
        meets = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        label = _label(kind, F.col("text"), c).cast("double")
        touches = F.exists("base", meets) if kind != "secret" else F.lit(False)
        place = c["start"].alias("start"), F.lit(k).alias("k"), c["end"].alias("end")
        return F.struct(*place, label.alias("label"), touches.alias("touches"), *_features(kind, F.col("text"), c))

    return F.transform(f"loose_{kind}", shaped)


def proposed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, base (start, k, end by start and kind) and loose (the same with features and a label); and columns ``more`` of ``docs``."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, hit: string>>)")
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hinted = {kind: F.col("text").rlike(HINT[kind]) for kind in KINDS}
    patterns = [("strict", k, STRICT[k]) for k in BASE_KINDS] + [("loose", k, LOOSE[k]) for k in KINDS]
    out = out.withColumns({f"{how}_{kind}": F.when(hinted[kind], spans(F.col("text"), pattern)).otherwise(none) for how, kind, pattern in patterns})
    out = out.withColumn("base", F.array_sort(F.concat(*(_strict(k, kind) for k, kind in enumerate(BASE_KINDS)))))
    return out.select("doc_id", "base", F.concat(*(_candidates(k, kind) for k, kind in enumerate(KINDS))).alias("loose"), *more)


def _tree(lines: list[str], at: int, depth: int, c) -> tuple[Column, int]:
    """A tree's debug text as nested CASE expressions over a candidate's features."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    if not m:
        raise ValueError(f"unknown tree line {line}")
    yes, at = _tree(lines, at + 1, depth + 1, c)
    no, at = _tree(lines, at + 1, depth + 1, c)  # skips the Else line
    return F.when(c[FEATURES[int(m[1])]] <= float(m[2]), yes).otherwise(no), at


class Scorer:
    """Boosted trees (or one score for all) and thresholds; ``score`` is an expression over a candidate."""

    def __init__(self, trees: list[tuple[float, str]], flat: float = 0.5, thresholds: dict[int, float] | None = None) -> None:
        self.trees, self.flat, self.thresholds = trees, flat, thresholds or {}

    def score(self, c) -> Column:
        if not self.trees:
            return F.lit(self.flat)
        total = F.lit(0.0)
        for weight, text in self.trees:
            lines = [x for x in text.splitlines()[1:] if x.strip()]
            total = total + F.lit(weight) * _tree(lines, 0, 0, c)[0]
        return 1 / (1 + F.exp(-2 * total))

    def accepts(self, c) -> Column:
        if not self.thresholds:
            return F.lit(False)
        limit = F.lit(2.0)
        for k, t in sorted(self.thresholds.items()):
            limit = F.when(c["k"] == k, F.lit(t)).otherwise(limit)
        return self.score(c) >= limit


def _boosted(cells: DataFrame, n: int, labels: set[float]) -> Scorer:
    """Trees on ``n`` cells. Where all labels are alike there are none: a score of 0.5 if all are valid, else 0."""
    if len(labels) < 2:
        return Scorer([], 0.5 if labels == {1.0} else 0.0)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cells)
    # Splits are looked for among max(maxBins ** 2, 10,000) rows, so that no more than all cells are needed.
    bins = max(32, math.isqrt(n) + 1)
    model = GBTClassifier(labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=bins).fit(vectors)
    return Scorer([(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees, strict=True)])


def fit(found: DataFrame, precision: float = PRECISION) -> Scorer:
    """Fits on all loose candidates, counted by half, label and features: few rows, as features are small numbers.

    The thresholds are set on all of them too, with scores by trees of the other half.
    """
    rows = found.select("doc_id", F.explode("loose").alias("c")).withColumn("half", F.pmod(F.xxhash64("doc_id", "c.start", "c.k"), F.lit(2)))
    counted = rows.groupBy("half", "c.k", "c.label", *(F.col(f"c.{f}") for f in FEATURES)).agg(F.count("*").cast("double").alias("n"))
    cells = Scratch(found.sparkSession, "pii-fit").write("cells", counted)
    sizes = {(r["half"], r["label"]): r["cells"] for r in cells.groupBy("half", "label").agg(F.count("*").alias("cells")).collect()}

    def fitted(*halves: int) -> Scorer:
        own = {key: n for key, n in sizes.items() if key[0] in halves}
        return _boosted(cells.filter(F.col("half").isin(*halves)), sum(own.values()), {label for _, label in own})

    c = {f: F.col(f) for f in FEATURES}
    score = F.when(F.col("half") == 0, fitted(1).score(c)).otherwise(fitted(0).score(c))
    step = F.floor(score * 50) / 50
    bins = cells.groupBy("k", step.alias("s")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # 51 a kind at most
    scorer = fitted(0, 1)
    for k in range(len(KINDS)):
        good = n = 0.0
        for row in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["s"]):
            good, n = good + row["good"], n + row["n"]
            if n >= SUPPORT and good >= precision * n and row["s"] >= 0.5:
                scorer.thresholds[k] = row["s"]
    return scorer


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of start, k, end; k indexes KINDS) for every row, and its text if asked for.

    Null text is empty. Rows that repeat an identifier are separate rows; a null
    identifier stays null. Other columns are not read. Spans are the base spans and
    the accepted candidates, by start and kind; an empty table, or one without
    labelled forms among its candidates, adds nothing.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    more = ["text"] if with_text else []
    found = Scratch(docs.sparkSession, "pii").write("proposed", proposed(docs, *more))
    scorer = fit(found)
    added = F.filter("loose", lambda c: ~c["touches"] & scorer.accepts(c))
    plain = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"), *more)


def count_of(column: str, k: int) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(column, lambda s: s["k"] == k)).cast("long")


def rendered(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets, one row per row of ``docs``.

    Each row is redacted by its own spans, whatever its identifier, null ones too.
    Spans that overlap give one hole, named by the first of them. Null text is empty.
    """
    found = find(docs, id_col, text_col, with_text=True)
    names, text = F.array(*map(F.lit, KINDS)), F.col("text")

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.element_at(names, s["k"] + 1), F.lit("]"))
        wider = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] < state["at"], wider).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select("doc_id", done.alias("text"))
