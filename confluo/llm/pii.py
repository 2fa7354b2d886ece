"""Personal data by weak supervision.

Patterns propose spans.  Labelers (validating regexes, gazetteers, context
words) vote on each span: 1 personal, -1 not, 0 no opinion.  Expectation
maximisation estimates how far each labeler can be trusted from the counts of
vote patterns, and a classifier on the span's own features is trained on the
resulting probabilities.  It decides on the spans that no base rule settles.
DataFrame expressions only; the driver holds counts of vote patterns and of
feature values, whose number is fixed by the labelers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import written

#: Base kinds and patterns.  They match what the plain patterns match from the
#: left, written so that no long run of characters is scanned twice.
BASE_KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to run.
_GATES = {"email": "@", "phone": "+"}
#: Kinds that the method adds, with candidate patterns.
ADDED_KINDS = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "local_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b",
    "secret": r"\b[A-Za-z0-9_/+]{20,64}\b",
    "birth_date": r"\b(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]\b",
}
KINDS = (*BASE_KINDS, *ADDED_KINDS)
#: Gazetteers (fixed values).
MAIL_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us)$"
FIRST_NAMES = (r"(?i)\b(?:james|mary|john|anna|robert|maria|michael|linda|david|peter|paul|laura|jose|carlos|hans|"
               r"pierre|marie|thomas|sarah|julia)\b")
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
#: Context words just before a span, and words that speak against it.
CONTEXT_FOR = (r"(?i)(?:mail|phone|tel|call|mobile|fax|contact|card|visa|mastercard|ssn|social security|iban|account|"
               r"born|birth|address|host|token|secret|password|passwd|api.?key|key)\W{0,4}\w{0,6}\W{0,4}$")
CONTEXT_AGAINST = r"(?i)(?:version|release|isbn|page|fig|figure|table|section|chapter|order|invoice|build|v)\W{0,3}$"
#: Labelers: see :func:`_votes`.
LABELERS = ("format", "gazetteer", "context", "against", "variety", "boundary")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """The base rules' conditions on a match (added kinds: none)."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                     & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(256)) <= 255))
    return (F.when(kind == "ip", parts)
            .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(True))


def _span(kind: str, gaps: Column):
    """A lambda: match i of a kind, with the text before and after it."""
    return lambda match, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), match.alias("match"),
        F.right(F.get(gaps, i), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every match of every pattern with its place and surroundings, and one row
    without a kind for each row of ``df``: ``(uid, id, kind, match, before,
    after, first, last)``, code-point offsets."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text.alias("text"))
    nothing = F.expr("cast(array() as array<struct<kind: string, i: int, gap: int, match: string, "
                     "before: string, after: string>>)")
    # which of the costly patterns need to run at all
    digits = F.col("text").rlike("[0-9]{2}")
    runs = {"ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]"), "national_id": digits, "iban": digits,
            "local_phone": digits, "birth_date": digits,
            "secret": F.col("text").rlike(r"[A-Za-z0-9_/+]{20}")}
    runs |= {k: F.contains(F.col("text"), F.lit(v)) for k, v in _GATES.items()}
    for kind, pattern in (BASE_KINDS | ADDED_KINDS).items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"m_{kind}", F.when(runs.get(kind, F.lit(True)), hits).otherwise(F.expr("cast(array() as array<string>)")))
    found = []
    for kind, pattern in (BASE_KINDS | ADDED_KINDS).items():
        hits, gaps = F.col(f"m_{kind}"), F.col(f"p_{kind}")
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(hits) > 0, F.split("text", pattern, -1)))
        found.append(F.when(F.size(hits) > 0, F.transform(hits, _span(kind, gaps))).otherwise(nothing))
    rows = rows.select("uid", "id", F.explode(F.concat(F.array(F.lit(None)), *found)).alias("c"))
    rows = rows.select("uid", "id", "c.*").repartition("uid")
    upto = F.sum(F.col("gap") + F.length("match")).over(
        Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("last", upto.cast("long")).withColumn("first", F.col("last") - F.length("match")) \
        .drop("i", "gap")


def _votes(c: DataFrame) -> DataFrame:
    """Adds the labelers' votes and the span's own features."""
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    base = kind.isin(*BASE_KINDS)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    fmt = vote(
        base | ((kind == "secret") & mixed & m.rlike("^(?:[0-9a-f]{32,64}|(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_/+]+)$"))
        | ((kind == "national_id") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
        | ((kind == "iban") & F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34))
        | ((kind == "birth_date") & m.rlike("-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"))
        | ((kind == "local_phone") & m.rlike(r"^\(?[2-9]")),
        ((kind == "secret") & ~mixed) | ((kind == "national_id") & m.rlike("^(?:000|666|9)|-00-|-0000$")))
    gaz = vote(
        ((kind == "email") & m.rlike(MAIL_DOMAINS)) | ((kind == "person") & m.rlike(FIRST_NAMES))
        | ((kind == "card") & digits.rlike(CARD_PREFIXES)) | ((kind == "iban") & m.rlike("^(?:DE|FR|ES|GB|IT|NL)")),
        (kind == "ip") & m.rlike(r"^(?:0|127|255)\."))
    context = vote(F.col("before").rlike(CONTEXT_FOR), F.lit(False))
    against = vote(F.lit(False), F.col("before").rlike(CONTEXT_AGAINST))
    kinds_of = F.size(F.array_distinct(F.split(m, "")))
    variety = vote((kinds_of >= 8) & (F.length(m) >= 10), kinds_of <= 3)
    boundary = vote(F.lit(False), F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]"))
    shape = F.concat_ws("/", F.when(m.rlike("[0-9]"), "9"), F.when(m.rlike("[A-Z]"), "A"), F.when(m.rlike("[a-z]"), "a"))
    out = c
    for name, col in zip(LABELERS, (fmt, gaz, context, against, variety, boundary), strict=True):
        out = out.withColumn(f"v_{name}", col)
    return (out.withColumn("f_kind", kind).withColumn("f_shape", F.concat_ws(":", kind, shape))
            .withColumn("f_length", F.concat_ws(":", kind, F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string")))
            .withColumn("f_before", F.regexp_replace(F.regexp_replace(F.right("before", F.lit(1)), r"\w", "w"), r"\s", " "))
            .withColumn("f_cue", F.col("before").rlike(CONTEXT_FOR).cast("string")))


_FEATURES = ("f_kind", "f_shape", "f_length", "f_before", "f_cue")


def reliabilities(patterns: DataFrame, rounds: int = 12) -> tuple[float, dict]:
    """Expectation maximisation over counted vote patterns (columns ``v_*`` and
    ``n``): the share of personal spans, and for each labeler and vote its
    probabilities on personal and on other spans.  Each round is one aggregate
    with one result row."""
    share = 0.5
    # start: a labeler is right three times in four
    table = {name: {-1: (0.1, 0.3), 0: (0.3, 0.6), 1: (0.6, 0.1)} for name in LABELERS}
    for _ in range(rounds):
        p = posterior(share, table)
        sums = [F.sum(F.col("n") * p).alias("yes"), F.sum(F.col("n") * (F.lit(1.0) - p)).alias("no")]
        for name in LABELERS:
            for v in (-1, 0, 1):
                here = F.col("n") * (F.col(f"v_{name}") == F.lit(v)).cast("double")
                sums += [F.sum(here * p).alias(f"{name}{v}y"), F.sum(here * (F.lit(1.0) - p)).alias(f"{name}{v}n")]
        r = patterns.agg(*sums).first()
        if r.yes is None:
            break
        share = min(0.99, max(0.01, r.yes / (r.yes + r.no)))
        table = {name: {v: ((r[f"{name}{v}y"] + 1) / (r.yes + 3), (r[f"{name}{v}n"] + 1) / (r.no + 3))
                        for v in (-1, 0, 1)} for name in LABELERS}
    return share, table


def posterior(share: float, table: dict) -> Column:
    """P(personal | votes) under the label model."""
    odds = F.lit(math.log(share / (1 - share)))
    for name, by_vote in table.items():
        ratio = {v: math.log(y / n) for v, (y, n) in by_vote.items()}
        odds = odds + F.when(F.col(f"v_{name}") == 1, ratio[1]).when(F.col(f"v_{name}") == -1, ratio[-1]).otherwise(ratio[0])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def span_classifier(spans: DataFrame, share: float, table: dict) -> Column:
    """A naive Bayes classifier on the span features, trained on the label
    model's probabilities: log odds of a span being personal."""
    soft = spans.groupBy(*_FEATURES, *[f"v_{x}" for x in LABELERS]).agg(F.count("*").alias("n")) \
        .withColumn("p", posterior(share, table))
    cells = soft.select("n", "p", F.explode(F.array(*[
        F.concat_ws("=", F.lit(f), F.col(f)) for f in _FEATURES])).alias("cell")) \
        .groupBy("cell").agg(F.sum(F.col("n") * F.col("p")).alias("y"),
                             F.sum(F.col("n") * (F.lit(1.0) - F.col("p"))).alias("x")).collect()
    yes = sum(r.y for r in cells) / len(_FEATURES) if cells else 0.0
    no = sum(r.x for r in cells) / len(_FEATURES) if cells else 0.0
    odds = F.lit(math.log((yes + 1) / (no + 1)))
    if not cells:
        return odds
    weights = F.create_map(*[x for r in cells for x in (
        F.lit(r.cell), F.lit(math.log((r.y + 1) / (yes + 2)) - math.log((r.x + 1) / (no + 2))))])
    for f in _FEATURES:
        odds = odds + F.coalesce(F.element_at(weights, F.concat_ws("=", F.lit(f), F.col(f))), F.lit(0.0))
    return odds


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per row of ``df``: ``(id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans)``.

    Base spans are the matches that pass their rule; all of them stay.  An
    added span stays when the classifier gives it at least ``threshold`` and
    it overlaps no base span.  ``spans``: ``kind:first:last`` (code points, end
    exclusive) by place, then kind.  Null and empty texts have none.  Texts of
    any length are read whole and never shuffled, only their matches are.
    Rows repeating an id are reported each; extra columns are not read.
    """
    found = written(_votes(candidates(df, id_col, text_col)), "pii-candidates")
    spans = found.where(F.col("kind").isNotNull() & _valid(F.col("kind"), F.col("match")))
    patterns = written(spans.groupBy(*[f"v_{x}" for x in LABELERS]).agg(F.count("*").alias("n")), "pii-patterns")
    share, table = reliabilities(patterns)
    odds = span_classifier(spans, share, table)
    base = F.col("kind").isin(*BASE_KINDS)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ok = F.col("kind").isNotNull() & _valid(F.col("kind"), F.col("match"))
    judged = found.select("uid", "id", "kind", "first", "last", order.alias("rank"), (ok & base).alias("is_base"),
                          (ok & ~base & (odds >= math.log(threshold / (1 - threshold)))).alias("is_added"))
    # an added span overlaps a base span that began before it ends and ends after it began
    reach = F.max(F.when(F.col("is_base"), F.col("last")))
    left = Window.partitionBy("uid").orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    start = F.min(F.when(F.col("is_base"), F.col("first")))
    right = Window.partitionBy("uid").orderBy("first").rangeBetween(0, Window.unboundedFollowing)
    judged = judged.repartition("uid").withColumn("reach", reach.over(left)).withColumn("next", start.over(right))
    clear = (F.coalesce(F.col("reach") <= F.col("first"), F.lit(True))
             & F.coalesce(F.col("next") >= F.col("last"), F.lit(True)))
    span = F.struct("first", "rank", F.concat_ws(":", "kind", "first", "last").alias("text"))
    listed = lambda cond: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(cond, span))), lambda s: s["text"]), ",")
    added = F.coalesce(F.col("is_added") & clear, F.lit(False))
    return judged.groupBy("uid").agg(
        F.first("id").alias(id_col),
        *[F.count_if(F.col("is_base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col("is_base")), 256).alias("base_sha256"),
        listed(F.col("is_base") | added).alias("spans")).drop("uid")
