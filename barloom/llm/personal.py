"""Personal data in notes: fixed patterns, and weak supervision for the spans that patterns alone cannot settle.

Only DataFrame functions run on the notes. Labelers vote on candidate spans, expectation-maximisation estimates how far each
labeler can be trusted, and a logistic classifier trained on the resulting odds decides about spans."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.session import materialize

# Base kinds in their order, with the characters a note must hold for a match to be possible.
# Possessive runs match what the greedy ones match here (what follows a run never begins with its characters), without
# recursion. A look-behind saves starting again inside a run; \G allows the place where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = [("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"), ("card", CARD, r"[0-9][\x20-]?[0-9]"), ("phone", PHONE, r"\+[0-9]")]

# Kinds that only the method finds. Their spans become candidates; the classifier decides.
EXTRA = [("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
         ("birth", r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9./-])", r"[0-9][./-][0-9]"),
         ("number", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-]|\)"),
         ("handle", r"(?<![A-Za-z0-9])[A-Za-z0-9._]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40}", r"\(at\)|\[at\]"),
         ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}", r"[A-Za-z0-9+/_-]{16}"),
         ("keyhead", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "-----BEGIN "),
         ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}")]

# Cue words before a span, and words that speak against a person's data.
CUES = {"ssn": "ssn|social security|tax id", "birth": "born|birth|dob|geboren|nacido|né",
        "number": "phone|tel|call|mobile|fax|contact|whatsapp",
        "secret": "(?:token|secret|key|apikey|password|passwd|pwd|bearer|auth|authorization|credentials?)(?![a-z])",
        "keyhead": "key|secret|private", "iban": "iban|account|bank|konto", "handle": "mail|contact|write|reach",
        "email": "mail|contact|write|reach", "ip": "ip|host|addr|login|from", "card": "card|visa|pay|account", "phone": "phone|tel|call|mobile|fax"}
AGAINST = "order|invoice|version|isbn|serial|page|figure|total|price|revision|commit|checksum|digest|md5|sha1|sha256|https?:|www"
GAZETTEER = "mr|mrs|ms|dr|herr|frau|señor|señora|monsieur|madame|john|mary|anna|james|maria|peter|david|sarah"
BEFORE = 40            # characters before a span that context labelers see
LABELERS = ("pattern", "checked", "cue", "gazetteer", "against", "alone")
EM_ROUNDS = 50


def _spans(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Matches of a pattern as structs (kind, start, end, match, before). Starts are sums of the lengths of the pieces between
    the matches and of the matches themselves, in code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        end = at + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["m"].alias("match"),
                       F.lower(F.right(x["p"], F.lit(BEFORE))).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.when(text.rlike(needs), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def iban_holds(match: Column) -> Column:
    """Whether an account number has remainder 1 by 97, its first four characters last and letters as 10 to 35."""
    code = F.regexp_replace(match, " ", "")
    chars = F.split(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(c == "", acc).when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def random_looking(match: Column) -> Column:
    """Whether a run of letters and digits looks drawn: at least an eighth of it digits, letters too, ten characters that differ."""
    digits, letters = F.length(_digits(match)), F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
    return (digits * 8 >= F.length(match)) & (letters > 0) & (F.size(F.array_distinct(F.split(match, ""))) >= 10)


def _passes(span: Column) -> Column:
    """The further conditions of a base kind, and the check of an added one."""
    digits = _digits(span["match"])
    return (F.when(span["kind"] == "ip", ~F.exists(F.split(span["match"], r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
        "^(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$")))
            .when(span["kind"] == "card", F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False)))
            .when(span["kind"] == "phone", F.length(digits).between(8, 15))
            .when(span["kind"] == "secret", random_looking(span["match"])).when(span["kind"] == "iban", iban_holds(span["match"])).otherwise(F.lit(True)))


def _votes(span: Column) -> Column:
    """Votes of LABELERS on a span: 1 personal, 0 not, -1 no opinion."""
    kind, before = span["kind"], span["before"]
    cue = F.lit(None).cast("string")
    for name, words in CUES.items():
        cue = F.when(kind == name, F.lit(rf"(?:^|[^a-z])(?:{words})")).otherwise(cue)
    base = kind.isin([k for k, _, _ in BASE])
    return F.array(
        F.when(base, 1).otherwise(-1),                                                          # a strict pattern
        F.when(span["passed"] & kind.isin("card", "ip", "phone", "secret", "keyhead", "iban"), 1).when(~span["passed"], 0).otherwise(-1),
        F.when(F.regexp_like(before, cue), 1).when(base, -1).otherwise(0),
        F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{GAZETTEER})\b[^.\n]*$"), 1).otherwise(-1),
        F.when(before.rlike(rf"(?:{AGAINST})[^a-z]*$"), 0).otherwise(-1),
        F.when(before.rlike("[0-9][^A-Za-z0-9]?$"), 0).otherwise(-1))                           # part of longer numbers


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities (per labeler: vote 1 given personal, vote 1 given not) and the classifier's weights, bias last."""

    reliability: list[tuple[float, float]]
    weights: list[float]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> tuple[list[tuple[float, float]], dict]:
    """Expectation-maximisation over vote patterns and their counts: labelers vote independently given the truth, an
    abstention says nothing. Returns reliabilities and the odds of every pattern. Starts from the mean vote."""
    post = {p: (1 + 2 * sum(v == 1 for v in p)) / (2 + 2 * sum(v >= 0 for v in p)) for p in patterns}
    rel = [(0.5, 0.5)] * len(LABELERS)
    for _ in range(rounds if patterns else 0):
        total = sum(patterns.values())
        prior = (1 + sum(n * post[p] for p, n in patterns.items())) / (2 + total)
        rel = []
        for j in range(len(LABELERS)):
            seen = [(p[j], n, post[p]) for p, n in patterns.items() if p[j] >= 0]
            yes, no = sum(n * q for _, n, q in seen), sum(n * (1 - q) for _, n, q in seen)
            # add-one counts that lean towards a labeler better than chance
            rel.append(((sum(n * q for v, n, q in seen if v) + 2) / (yes + 3), (sum(n * (1 - q) for v, n, q in seen if v) + 1) / (no + 3)))
        for p in post:
            odds = math.log(prior) - math.log(1 - prior)
            for v, (a, b) in zip(p, rel):
                odds += 0 if v < 0 else math.log(a / b) if v else math.log((1 - a) / (1 - b))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return rel, post


def _features(votes: Column, kind: Column, extra: list[str]) -> list[Column]:
    """Two indicators per labeler and one per kind that the method adds."""
    return ([(votes[j] == v).cast("double") for j in range(len(LABELERS)) for v in (1, 0)]
            + [(kind == k).cast("double") for k in extra])


def fit_spans(candidates: DataFrame) -> SpanModel:
    """Trains on (kind, votes) of all candidate spans. Votes and kinds have few combinations, so what is gathered is a table
    of at most 3 ** labelers x kinds rows with counts; the classifier learns from it with the counts as weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    counts = candidates.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in counts:
        patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0) + r["n"]
    rel, post = estimate(patterns)
    extra = [k for k, _, _ in EXTRA]
    width = 2 * len(LABELERS) + len(extra)
    rows = [(r["kind"], list(r["votes"]), y, r["n"] * (post[tuple(r["votes"])] if y else 1 - post[tuple(r["votes"])]))
            for r in counts for y in (1.0, 0.0)]
    rows = [r for r in rows if r[3] > 0]
    if len({r[2] for r in rows}) < 2:
        return SpanModel(rel, [0.0] * width + [-1.0])
    table = candidates.sparkSession.createDataFrame(rows, "kind string, votes array<int>, label double, weight double")
    table = table.select(array_to_vector(F.array(*_features(F.col("votes"), F.col("kind"), extra))).alias("features"),
                         "label", "weight").coalesce(1)
    fit = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(table)
    return SpanModel(rel, [*map(float, fit.coefficients), float(fit.intercept)])


def find_personal(positions: DataFrame, *, note: str = "note") -> DataFrame:
    """`positions` (without the note) with `base` and `spans`, arrays of (kind, start, end) in code points, end exclusive.

    base: e-mail, IP, card and phone numbers, leftmost and without overlap per kind, further conditions met; by kind in that
    order, then start. spans: these and the candidates of EXTRA kinds (among them secrets, private key heads and account numbers
    with a right check sum) that the classifier takes, by kind (base kinds first),
    start and end. Candidates that overlap a base span are left out. The first pass stores what it found (no text) in the shared
    folder; reliabilities and classifier are fitted on all candidates there.

    A null or empty note has no spans; repeated rows are judged one by one; an empty table gives no rows; given columns
    named like a result are replaced."""
    made = ("base", "spans")
    kept = [c for c in positions.columns if c != note and c not in made]
    text = F.coalesce(F.col(note), F.lit(""))
    base = F.concat(*[_spans(F.col("text_"), *b) for b in BASE])
    extra = F.concat(*[_spans(F.col("text_"), *e) for e in EXTRA])
    has = F.col("text_").rlike("[0-9@]") | F.col("text_").rlike(r"\(at\)|\[at\]|-----BEGIN ")
    checked = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                 s["before"].alias("before"), _passes(s).alias("passed"))
    seen = (positions.select(*kept, text.alias("text_"))
            .select(*kept, F.when(has, base).alias("b_"), F.when(has, extra).alias("e_"))
            .select(*kept, F.transform("b_", checked).alias("b_"), F.transform("e_", checked).alias("e_"))
            .select(*kept, "b_", F.filter("e_", lambda e: ~F.exists("b_", lambda b: b["passed"] & (b["start"] < e["end"])
                                                                     & (e["start"] < b["end"]))).alias("e_"))
            .select(*kept, *[F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                               s["passed"].alias("passed"), _votes(s).alias("votes"))).alias(c) for c in ("b_", "e_")]))
    seen = materialize(seen, "spans")
    model = fit_spans(seen.select(F.explode(F.concat("b_", "e_")).alias("s")).select("s.kind", "s.votes"))

    def taken(s: Column) -> Column:
        total = F.lit(model.weights[-1])
        for w, x in zip(model.weights, _features(s["votes"], s["kind"], [k for k, _, _ in EXTRA])):
            total = total + F.lit(w) * x
        return (total >= 0) & (s["passed"] | (s["kind"] != "iban"))     # as in base kinds, a check sum settles
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    own = F.coalesce(F.transform(F.filter("b_", lambda s: s["passed"]), short), none)
    more = F.coalesce(F.transform(F.filter("e_", taken), short), none)
    return seen.select(*kept, own.alias("base"), F.concat(own, more).alias("spans"))
