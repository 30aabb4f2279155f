"""Personal data by weak-supervision aggregation, in DataFrame operations only.

Base patterns give spans that always stay. Labelers propose further ones:
strict shapes that stand inside a run which the base patterns reject as a
whole, obfuscated or unmarked forms, gazetteers of given names and street
words, and cue words before a name, an address or a date of birth. Over all
candidates, labelers vote: shape, check digits and ranges, gazetteers, cue
words in the context, and words that speak against. Expectation-maximisation
on the counts of equal votes estimates how reliable each labeler is; the
posteriors then train a logistic span classifier on span features. Votes and
features are few-valued, so the counts that reach the driver are bounded by
the number of their combinations, not by the data. The classifier becomes a
column expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only labelers propose come after the base kinds.
ALL_KINDS = (*KINDS, "name", "address", "birth")
#: Possessive quantifiers and run starts keep matching linear; the spans are those of the plain patterns.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GATE = {"email": "contains(t, '@')", "ip": r"rlike(t, '[0-9][.][0-9]')", "card": r"rlike(t, '[0-9](?:[ -]?[0-9]){13}')", "phone": "contains(t, '+')"}
GIVEN_NAMES = """James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy
Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Kimberly Kenneth Emily George Donna Kevin Michelle Brian Carol Edward Amanda Laura Anna Peter Hans
Klaus Jürgen Wolfgang Stefan Andreas Sabine Monika Ursula Petra Heike Pierre Jean Jacques Michel Philippe Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel
Francisco Juan Carlos María Carmen Josefa Isabel Dolores Pilar Teresa Javier Miguel""".split()
_STREETS_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Terrace"
_STREETS_DE = "straße|strasse|weg|platz|allee|gasse"
_STREETS_LATIN = "rue|avenue|boulevard|place|allée|calle|avenida|plaza|Rue|Avenue|Boulevard|Place|Allée|Calle|Avenida|Plaza"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Madame|Monsieur|Señor|Señora|Sr|Sra"
_NAME_CUES = "[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Nn]ame:|[Nn]om:|[Nn]ombre:|[Ss]igned,?"
_CAPITAL = r"\p{Lu}[\p{L}'’-]++"
_DATE = r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.? \p{L}{3,10} (?:19|20)[0-9]{2}|\p{L}{3,10} [0-9]{1,2}, (?:19|20)[0-9]{2})"
#: Proposals: (kind, pattern, cheap test of a text, strict shape).
_PROPOSALS = (
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])", _GATE["card"], True),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2}(?![0-9])", _GATE["phone"], True),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++", "contains(t, '[at]') or contains(t, '(at)')", False),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}\[\.\][0-9]{1,3}(?![0-9])", "contains(t, '[.]')", False),
    ("phone", r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", "rlike(t, '[0-9]{3}[ .-][0-9]{4}')", False),
    ("name", rf"(?<!\p{{L}})(?=\p{{Lu}}\p{{Ll}})(?:(?<=(?<!\p{{L}})(?:{_TITLES})\.? ){_CAPITAL}(?: {_CAPITAL})?|(?<=(?:{_NAME_CUES}) ){_CAPITAL}(?: {_CAPITAL}){{0,2}}|(?:{'|'.join(GIVEN_NAMES)})(?!\p{{L}})(?: \p{{Lu}}\.)? {_CAPITAL})", "true", False),
    ("address", rf"(?<![0-9])[0-9]{{1,5}}[A-Za-z]? (?:{_CAPITAL} ){{1,4}}(?:{_STREETS_EN})(?!\p{{L}})|(?<!\p{{L}})\p{{Lu}}\p{{L}}{{2,30}}?(?:{_STREETS_DE}) [0-9]{{1,4}}(?!\p{{L}}|[0-9])|(?<![0-9])[0-9]{{1,4}},? (?:{_STREETS_LATIN}) (?:(?:de|du|des|la|le|del|los|las) ){{0,3}}{_CAPITAL}", f"rlike(t, '[0-9]') and rlike(t, '(?:{_STREETS_EN}|{_STREETS_DE}|{_STREETS_LATIN})(?![a-z])')", False),
    ("birth", rf"(?<![0-9./-]){_DATE}(?![0-9])", "rlike(t, '(?:19|20)[0-9]{2}')", False),
)
_CUES = (
    "(?i)(?:e-?mail|mail|contact|write)", "(?i)(?:ip|host|server|address)", "(?i)(?:card|visa|pay|credit|mastercard)", "(?i)(?:phone|tel|call|fax|mobile)",
    f"(?:(?:{_TITLES})\\.?|{_NAME_CUES})", "(?i)(?:lives? at|address|addresse|adresse|wohnt|habite|dirección|domicilio|reside)", "(?i)(?:born|birth|dob|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)",
)
_AGAINST = r"(?i)(?<![a-z])(?:isbn|issn|order|invoice|version|section|page|serial|model|figure|published|updated)(?![a-z])"
_PLACES = (
    r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", "^(?!0|10\\.|127\\.|192\\.168\\.)", "^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^(?:\+[1-9]|[(]?[2-9][0-9]{2}[)]?[ .-])",
    f"^(?:{'|'.join(GIVEN_NAMES)})(?![a-z])", f"(?:{_STREETS_EN}|{_STREETS_DE}|{_STREETS_LATIN})", "(?:19[0-9]{2}|20[01][0-9])",
)
CONTEXT = 24
LABELERS = ("v_shape", "v_check", "v_gazetteer", "v_context", "v_against")
FEATURES = ("f_shape", "f_check", "f_cue", "f_against", "f_place", "f_start", "f_cue_word", "f_place_word", *(f"f_{k}" for k in ALL_KINDS[1:]))
THRESHOLD = 0.9
ROUNDS = 40
#: Shares of a labeler's votes -1, 0, 1 before any data: for spans that are not personal, and for spans that are; they weigh as many spans as PRIOR_COUNTS.
PRIOR = {"v_shape": ((0, 0.9, 0.1), (0, 0.5, 0.5)), "v_check": ((0.6, 0.2, 0.2), (0.05, 0.2, 0.75)), "v_gazetteer": ((0, 0.85, 0.15), (0, 0.5, 0.5)), "v_context": ((0, 0.98, 0.02), (0, 0.5, 0.5)), "v_against": ((0.4, 0.6, 0), (0.05, 0.95, 0))}
PRIOR_COUNTS = 400


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
        doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))
        return F.when(F.length(digits).between(14, 19), F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _running(df: DataFrame, given: dict[str, tuple[str, Column, object]]) -> DataFrame:
    """Adds arrays: of each value of a column, what op makes of all before it. given: new name to (column, zero, op).

    Values are taken in blocks of the square root of their number, so that a
    text of many matches takes time in the power 1.5 at most. Every step is a
    column of its own, or lambdas would work it out again and again.
    """
    prefix = lambda of, start, op: F.aggregate(of, F.array(start), lambda a, v: F.array_append(a, op(F.element_at(a, -1), v)))

    total = lambda zero, op: lambda x: F.aggregate(x, zero, op)
    inside = lambda op: lambda x, start: F.slice(prefix(x, start, op), 1, F.size(x))

    def cut(c: str) -> Column:
        n = F.size(c)
        block = F.greatest(F.lit(8), F.ceil(F.sqrt(n)).cast("int"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(F.col(c), b * block + 1, block)))

    df = df.withColumns({f"_b_{name}": cut(c) for name, (c, _, _) in given.items()})
    df = df.withColumns({f"_s_{name}": F.transform(f"_b_{name}", total(zero, op)) for name, (_, zero, op) in given.items()})
    df = df.withColumns({f"_s_{name}": prefix(F.col(f"_s_{name}"), zero, op) for name, (_, zero, op) in given.items()})
    inner = {name: F.zip_with(f"_b_{name}", F.slice(f"_s_{name}", 1, F.size(f"_b_{name}")), inside(op)) for name, (_, _, op) in given.items()}
    df = df.withColumns({name: F.when(F.col(f"_b_{name}").isNull(), F.array().cast("array<int>")).otherwise(F.flatten(c)) for name, c in inner.items()})
    return df.drop(*(f"_{k}_{name}" for name in given for k in "bs"))


def _spans(n: int, kind: str, base: bool, strict: bool) -> Column:
    """Structs of the matches m of a pattern between the pieces p of its split, from the sums a of what lies before each piece."""
    first = F.zip_with(f"p{n}", f"m{n}", lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    both = F.zip_with(first, F.slice(f"p{n}", 2, F.size(f"m{n}")), lambda x, r: F.struct(x.p.alias("p"), x.m.alias("m"), r.alias("r")))

    def one(x: Column, start: Column) -> Column:
        at = start + F.length(x.p)
        return F.struct(
            F.lit(ALL_KINDS.index(kind)).alias("k"), at.alias("s"), (at + F.length(x.m)).alias("e"), x.m.alias("m"),
            F.right(x.p, F.lit(CONTEXT)).alias("l"), F.left(x.r, F.lit(CONTEXT)).alias("r"), F.lit(base).alias("b"), F.lit(strict).alias("f"),
        )

    made = F.filter(F.zip_with(both, f"a{n}", one), lambda x: x.m.isNotNull())  # the last piece is before no match
    return F.filter(made, lambda x: _valid(kind, x.m)) if base else made


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, loose_spans): arrays of span structs with contexts, for every row. Each text is cut only by the patterns whose cheap gate it passes and that it matches."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    plan = [(k, _BASE[k], _GATE[k], True, True) for k in KINDS] + [(k, p, g, False, s) for k, p, g, s in _PROPOSALS]
    none = F.array().cast("array<string>")
    df = df.select("doc_id", "t", *(F.when(F.expr(gate), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m{n}") for n, (_, pattern, gate, _, _) in enumerate(plan)))
    df = df.withColumns({f"p{n}": F.when(F.size(f"m{n}") > 0, F.split("t", pattern, -1)).otherwise(none) for n, (_, pattern, _, _, _) in enumerate(plan)}).drop("t")
    df = df.withColumns({f"g{n}": F.zip_with(f"p{n}", f"m{n}", lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0))) for n in range(len(plan))})
    df = _running(df, {f"a{n}": (f"g{n}", F.lit(0), lambda a, v: a + v) for n in range(len(plan))})
    made = [_spans(n, k, base, strict) for n, (k, _, _, base, strict) in enumerate(plan)]
    return df.select("doc_id", F.concat(*made[: len(KINDS)]).alias("base_spans"), F.concat(*made[len(KINDS) :]).alias("loose_spans"))


def _by_kind(x: Column, tests) -> Column:
    """The test of the span's own kind."""
    out = F.when(x.k == 0, tests[0])
    for k, test in enumerate(tests[1:], 1):
        out = out.when(x.k == k, test)
    return out


def _checked(x: Column) -> Column:
    """1 if the digits of a card or the parts of an address are right, -1 if wrong, 0 where there is nothing to check."""
    dots = F.regexp_replace(x.m, r"\[\.\]", ".")
    sure = [_valid(k, dots if k == "ip" else x.m) for k in KINDS[1:]]
    return _by_kind(x, [F.lit(0), *(F.when(c, 1).otherwise(-1) for c in sure), F.lit(0), F.lit(0), F.lit(0)])


def _signs(x: Column) -> dict[str, Column]:
    around = F.concat_ws(" ", x.l, x.r)
    return {
        "shape": x.f.cast("int"),
        "check": _checked(x),
        "place": _by_kind(x, [x.m.rlike(p) for p in _PLACES]).cast("int"),
        "cue": _by_kind(x, [x.l.rlike(c) for c in _CUES]).cast("int"),
        "against": around.rlike(_AGAINST).cast("int"),
        "start": x.l.rlike(r"[:=(]\s*$").cast("int"),
    }


def _votes(c: dict[str, Column]) -> dict[str, Column]:
    return {"v_shape": c["shape"], "v_check": c["check"], "v_gazetteer": c["place"], "v_context": c["cue"], "v_against": -c["against"]}


def _features(x: Column, c: dict[str, Column]) -> dict[str, Column]:
    return {f"f_{n}": c[n] for n in ("shape", "check", "cue", "against", "place", "start")} | {f"f_{n}_word": F.when(x.k >= len(KINDS), c[n]).otherwise(0) for n in ("cue", "place")} | {f"f_{k}": (x.k == i).cast("int") for i, k in enumerate(ALL_KINDS) if i}


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote rows with counts: posterior that a span is personal data, and P(vote | class) per labeler.

    before holds counts of votes that are thought to have been seen, per
    labeler and class. A labeler is never taken for worse than chance: where
    its vote for a span would speak against it, or the other way round, the
    vote says nothing.
    """
    before = np.full((votes.shape[1], 2, 3), 0.5) if before is None else before
    post = 1 / (1 + np.exp(-2.0 * (votes.sum(1) - 0.5)))
    if before.sum() > 10 * before.size:
        post = np.full(len(votes), 0.5)
    for n in range(rounds):
        seen = np.stack([counts * (1 - post), counts * post]) * (n > 0 or before.sum() <= 10 * before.size)
        tables = before + 0.01 + np.stack([[[(w * (votes[:, j] == v)).sum() for v in (-1, 0, 1)] for w in seen] for j in range(votes.shape[1])])
        tables /= tables.sum(2, keepdims=True)
        for at, sign in ((0, -1), (2, 1)):
            wrong = sign * (tables[:, 1, at] - tables[:, 0, at]) < 0
            tables[wrong, :, at] = tables[wrong, :, at].mean(1, keepdims=True)
        prior = (seen.sum(1) + 1) / (seen.sum() + 2)
        like = np.log(prior)[:, None] + sum(np.log(tables[j][:, votes[:, j] + 1]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return post, tables


def train(rows: list[dict]) -> list[float] | None:
    """Intercept and weights of the span classifier from rows of LABELERS, FEATURES and count; None without rows."""
    if not rows:
        return None
    names = [*LABELERS, *FEATURES]
    rows = sorted(rows, key=lambda r: tuple(r[n] for n in names))
    votes = np.array([[r[n] for n in LABELERS] for r in rows])
    feats = np.array([[1.0] + [r[n] for n in FEATURES] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    kind = np.array([next((k for k in ALL_KINDS[1:] if r[f"f_{k}"]), ALL_KINDS[0]) for r in rows])
    post = np.zeros(len(rows))
    for k in sorted(set(kind)):  # a labeler may be good at one kind and bad at another
        post[kind == k] = estimate(votes[kind == k], counts[kind == k], before=PRIOR_COUNTS * np.array([PRIOR[n] for n in LABELERS], float))[0]
    w = np.zeros(feats.shape[1])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-feats @ w))
        hess = (feats * (counts * p * (1 - p))[:, None]).T @ feats + np.eye(len(w))
        w += np.linalg.solve(hess, feats.T @ (counts * (post - p)) - w)
    return [float(v) for v in w]


def fit(found: DataFrame) -> list[float] | None:
    """The span classifier, from counts of equal votes and features over all candidates."""
    spans = found.select(F.explode(F.concat("base_spans", "loose_spans")).alias("x"))
    x = F.col("x")
    c = _signs(x)
    made = spans.select(*(e.alias(n) for n, e in (_votes(c) | _features(x, c)).items()))
    return train([r.asDict() for r in made.groupBy(*LABELERS, *FEATURES).count().collect()])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_spans, base, spans): counts of base spans and of all, and both lists as kind:start:end by start.

    A null text is empty and has no span; repeated rows and rows with a null
    id are searched one by one; an empty table gives no rows; extra columns
    are ignored, whatever their names. Of the proposed spans that the
    classifier takes, one stays if it overlaps no base span and no other taken
    span before it, by start, then end.
    """
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    weights = fit(found)

    def taken(x: Column) -> Column:
        z = F.lit(weights[0])
        c = _signs(x)
        for w, v in zip(weights[1:], _features(x, c).values()):
            z = z + F.lit(w) * v
        return z >= math.log(threshold / (1 - threshold))

    bare = lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), (~x.b).alias("n"))
    own = F.transform("base_spans", bare)
    more = F.transform(F.filter("loose_spans", taken), bare) if weights else F.filter(own, lambda x: F.lit(False))
    order = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.n.alias("n"), x.k.alias("k"))))
    told = found.select("doc_id", own.alias("own"), order(F.concat(own, more)).alias("every"))
    far = F.lit(2**31 - 1)
    told = told.withColumns({"ends": F.transform("every", lambda x: x.e), "back": F.reverse(F.transform("every", lambda x: F.when(x.n, far).otherwise(x.s)))})
    told = _running(told, {"before": ("ends", F.lit(0), lambda a, v: F.greatest(a, v)), "after": ("back", far, lambda a, v: F.least(a, v))})
    edges = F.zip_with("before", F.reverse("after"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    free = F.zip_with("every", edges, lambda x, y: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), (x.n & ((y.a > x.s) | (y.b < x.e))).alias("out")))
    told = told.select("doc_id", "own", F.filter(free, lambda x: ~x.out).alias("every"))

    def listed(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))))
        kind = F.array(*map(F.lit, ALL_KINDS))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(kind, x.k), x.s.cast("string"), x.e.cast("string"))), ",")

    def count(n: int) -> Column:
        return F.size(F.filter("own", lambda x: x.k == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = map(count, range(len(KINDS)))
    return told.select("doc_id", *counts, F.size("every").cast("long").alias("n_spans"), listed(F.col("own")).alias("base"), listed(F.col("every")).alias("spans"))
