"""Personal data by weak supervision: labelers vote on candidate spans, and their reliability is estimated.

1. Candidates are matches of the agreed patterns and of looser ones (local phone numbers, social security
   numbers, account numbers, obfuscated addresses, titles with names, and numbers that fail the agreed checks).
2. Labelers vote for (1), against (-1) or not at all (0): checks of form, gazetteers of domains, calling codes,
   countries and given names, words before the span that announce or deny personal data, repetition, borders.
3. Expectation-maximisation over counts of vote patterns estimates how each labeler votes on true and on false
   spans, and how often each kind is true. There are at most ``kinds * 3 ** labelers`` patterns, however large
   the corpus; an iteration is one aggregate of that table, and the driver sees sums only.
4. A logistic span classifier is trained on the expected labels. Its inputs are the votes, the kind, and shape
   features that the labelers don't use. Spans it finds likely are added to the agreed ones, which always stay.

Everything is a built-in function: no Python runs on executors. Every row is searched where it lies, so no text is
shuffled; matches are content-addressed by text, so those of copies are one in all that follows, and the join back to
documents carries no text.

Missing and empty texts have no span; matches that fail their check are dropped without a second try; repeated
rows get a row each; an empty table gives an empty result; without candidates nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.native_spans import located, matches, spans_text
from tallyframe.llm.tables import content_key
from tallyframe.session import stage

# The agreed patterns. Possessive quantifiers and the borders of a run find the same matches without
# trying a long run from each of its places: after a failure at its begin, no later place of the run can match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# public formats
MORE = {
    "local_phone": r"(?<![0-9+]\x20)(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "hidden_email": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
KINDS = (*BASE, *MORE)
LABELERS = ("form", "gazetteer", "announced", "denied", "varied", "border")

# Gazetteers, fixed values.
DOMAINS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
COUNTRIES = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
GIVEN = r"\b(?:Anna|Carlos|David|Emma|Hans|James|John|Juan|Laura|Maria|Marie|Michael|Paul|Peter|Pierre|Robert|Sarah|Thomas)\b"
ANNOUNCE = (r"(?i)(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|iban|account|ssn|social security|address|"
            r"host|server|login|name|correo|telefon|kontakt|courriel)[^A-Za-z0-9]{0,6}(?:[a-z]{1,6}[^A-Za-z0-9]{1,3})?$")
DENY = r"(?i)(?:version|release|isbn|issn|doi|figure|section|chapter|page|build|part|serial|order)[^A-Za-z0-9]{0,6}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(F.transform(F.split(digits, "(?<=.)(?=.)"), lambda c: c.cast("int")))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def agreed(kind: Column, match: Column) -> Column:
    """Whether a match of an agreed pattern passes its check."""
    n = F.length(_digits(match))
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
            .when(kind == "card", F.when(n.between(16, 19), luhn(_digits(match))).otherwise(F.lit(False)))
            .when(kind == "phone", n.between(8, 15)).otherwise(F.lit(False)))


def votes() -> dict[str, Column]:
    """One column per labeler over a candidate's kind, match and context."""
    kind, match, before, after = (F.col(c) for c in ("kind", "match", "before", "after"))
    yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    form = (F.when(kind.isin(*BASE), yes_no(agreed(kind, match), F.lit(True)))
            .when(kind == "ssn", yes_no(~match.rlike(r"^(?:000|666|9..)|-00-|-0000$"), F.lit(True)))
            .when(kind == "iban", yes_no(F.length(F.regexp_replace(match, " ", "")).between(15, 34), F.lit(True)))
            .when(kind == "local_phone", yes_no(match.rlike(r"^\(?[2-9]"), F.lit(True))).otherwise(0))
    gazetteer = (F.when(kind == "email", yes_no(match.rlike(DOMAINS), F.lit(False)))
                 .when(kind == "ip", yes_no(F.lit(False), match.rlike(r"^(?:0|127|255)\.")))
                 .when(kind == "phone", yes_no(match.rlike(CALLING), F.lit(True)))
                 .when(kind == "iban", yes_no(match.rlike(COUNTRIES), F.lit(True)))
                 .when(kind == "name", yes_no(match.rlike(GIVEN), F.lit(False))).otherwise(0))
    varied = F.size(F.array_distinct(F.split(F.regexp_replace(match, "[^A-Za-z0-9]", ""), "(?<=.)(?=.)")))
    return {
        "form": form, "gazetteer": gazetteer,
        "announced": F.when(before.rlike(ANNOUNCE), 1).otherwise(0),
        "denied": F.when(before.rlike(DENY), -1).otherwise(0),
        "varied": F.when(varied <= 2, -1).when(varied >= 5, 1).otherwise(0),
        "border": F.when(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), -1).otherwise(1),
    }


def features() -> dict[str, Column]:
    """Shape features of a span, as few whole numbers, that the labelers don't use."""
    match, size = F.col("match"), F.length("match")
    return {"long": F.least(F.floor(size / 8), F.lit(4)).cast("int"),
            "digits": F.floor(4 * F.length(_digits(match)) / size).cast("int"),
            "spaced": match.rlike("[ ().-]").cast("int"),
            "line_start": (F.col("before").rlike("\n$") | (F.col("before") == "")).cast("int")}


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def estimate(patterns: DataFrame, rounds: int = 10, smooth: float = 1.0) -> Column:
    """Expected label of a vote pattern. ``patterns`` has the kind, the votes and ``n``, and is read once a round.

    The model: votes are independent given the label. The start trusts every vote a little.
    """
    start = {j: {y: {v: 0.6 if v == (1 if y else -1) else 0.2 for v in (-1, 0, 1)} for y in (0, 1)} for j in LABELERS}
    prior = {k: 0.9 if k in BASE else 0.5 for k in KINDS}
    for _ in range(rounds):
        p = _posterior(prior, start)
        weighed = patterns.withColumn("__p", p)
        each = [F.sum(F.when(F.col(j) == v, F.col("n") * (F.col("__p") if y else 1 - F.col("__p"))).otherwise(0.0)).alias(f"{j}_{y}_{v}")
                for j in LABELERS for y in (0, 1) for v in (-1, 0, 1)]
        of_kind = [F.sum(F.when(F.col("kind") == k, F.col("n") * w).otherwise(0.0)).alias(f"{k}_{a}")
                   for k in KINDS for a, w in (("true", F.col("__p")), ("all", F.lit(1.0)))]
        sums = weighed.agg(*each, *of_kind).first()
        value = lambda name: float(sums[name] or 0.0)  # noqa: B023,E731
        start = {j: {y: _shares([value(f"{j}_{y}_{v}") for v in (-1, 0, 1)], smooth) for y in (0, 1)} for j in LABELERS}
        prior = {k: (value(f"{k}_true") + smooth * (9 if k in BASE else 1)) / (value(f"{k}_all") + smooth * (10 if k in BASE else 2))
                 for k in KINDS}
    return _posterior(prior, start)


def _shares(counts: list[float], smooth: float) -> dict[int, float]:
    total = sum(counts) + 3 * smooth
    return {v: (c + smooth) / total for v, c in zip((-1, 0, 1), counts)}


def _posterior(prior: dict[str, float], rates) -> Column:
    logit = F.lit(0.0)
    for k, p in prior.items():
        p = min(max(p, 1e-6), 1 - 1e-6)
        logit = F.when(F.col("kind") == k, F.lit(math.log(p / (1 - p)))).otherwise(logit)
    for j in LABELERS:
        odds = {v: math.log(rates[j][1][v] / rates[j][0][v]) for v in (-1, 0, 1)}
        logit = logit + F.when(F.col(j) == 1, F.lit(odds[1])).when(F.col(j) == -1, F.lit(odds[-1])).otherwise(F.lit(odds[0]))
    return 1 / (1 + F.exp(-logit))


def _inputs() -> dict[str, Column]:
    kinds = {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS[1:]}
    return {**kinds, **{j: F.col(j).cast("double") for j in LABELERS}, **{f: F.col(f).cast("double") for f in features()}}


def classify(patterns: DataFrame, expected: Column) -> Column:
    """Probability by a logistic classifier trained on expected labels, as an expression. ``patterns`` are
    counts of distinct inputs; each is a true example with its expected label as weight, and a false one."""
    table = patterns.withColumn("__p", expected).withColumns(_inputs())
    both = table.withColumn("__e", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("__p").alias("w")),
                                                     F.struct(F.lit(0.0).alias("label"), (1 - F.col("__p")).alias("w")))))
    both = both.select(*_inputs(), F.col("__e.label").alias("label"), (F.col("__e.w") * F.col("n")).alias("weight"))
    names = list(_inputs())
    rows = VectorAssembler(inputCols=names, outputCol="inputs").transform(both)
    model = LogisticRegression(featuresCol="inputs", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=50).fit(rows)
    terms = [c * float(b) for c, b in zip(_inputs().values(), model.coefficients)]
    return 1 / (1 + F.exp(-(F.lit(float(model.intercept)) + _total(terms))))


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans of distinct texts: ``key, kind, start, end, base``; the agreed ones, and of the looser kinds those
    found likely. Matches of an agreed pattern that fail its check only serve as examples."""
    texts = docs.select(content_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    candidates = located(matches(texts, "key", {**BASE, **MORE}), "key")
    marked = candidates.withColumns({"base": agreed(F.col("kind"), F.col("match")), **votes(), **features()})
    marked = stage(marked.drop("match", "before", "after"))
    patterns = stage(marked.groupBy("kind", *LABELERS, *features()).agg(F.count("*").alias("n")))
    if patterns.isEmpty():
        return marked.select("key", "kind", "start", "end", "base")
    likely = classify(patterns, estimate(patterns))
    return marked.withColumn("p", likely).filter(
        F.col("base") | (~F.col("kind").isin(*BASE) & (F.col("p") >= least))).select("key", "kind", "start", "end", "base")


def report(docs: DataFrame) -> DataFrame:
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    # staged, so that the join below has two plain sides and a text of very many documents can be split
    spans = stage(find(docs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        place[F.col("kind")].alias("place"), "start", "kind", "end", "base"))).alias("spans")))
    rows = docs.select("doc_id", content_key().alias("key")).join(spans, "key", "left").withColumn("spans", F.coalesce(
        "spans", F.array().cast("array<struct<place:int,start:bigint,kind:string,end:bigint,base:boolean>>")))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"),
                       spans_text(F.col("spans")).alias("spans"))
