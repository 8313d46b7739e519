"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns with checks (addresses, Luhn sums, digit counts) give the base spans. Looser
patterns give candidates: spelt-out addresses, numbers without a country code, digit groups
that miss a check, credentials, names after a form of address. Labelers of three sorts vote
on every candidate: shape (regular expressions), gazetteers (known words) and context (the
words before it). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, and its posteriors train the final span classifier, a naive Bayes
model over features of the span. Candidates it accepts join the base spans.

The texts are scanned once; base spans and candidates are written to the shared folder. What
reaches the driver are sums per labeler and feature value, a number that does not depend on
the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, written

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, written without backtracking: a run of characters is entered at its
# first character only (or where the last match ended), and taken whole.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

CANDIDATES = {
    "email": r"(?i)\b[A-Z0-9._-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Z0-9-]{1,63}+){1,4}+",
    "ip": r"(?i)(?<![0-9A-F:])[0-9A-F]{1,4}+(?::[0-9A-F]{1,4}+){7}+(?![0-9A-F:])",
    "card": r"(?<![0-9.+-])[0-9]{4}+(?:[ -]?[0-9]{4}+){3}+(?![0-9.-])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[ \t]{0,3}+[=:][ \t]{0,3}+[\"']?[A-Z0-9_-]{12,128}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+){0,2}+",
}
GUARDS = {  # a cheap test that a text can match at all
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.contains("+"),
    "ip": lambda t: t.contains("."),
    "card": lambda t: F.lit(True),
}
CANDIDATE_GUARDS = {"ip": lambda t: t.contains(":"), "secret": lambda t: t.contains("=") | t.contains(":")}

# words that speak for a kind in the characters before a candidate, and words that speak against
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|kontakt|courriel|correo)",
    "ip": r"(?i)(\bip\b|address|host|server|login|logged)",
    "card": r"(?i)(card|visa|credit|payment|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|cell|ruf|appel|llam)",
    "secret": r"(?i)(token|secret|passw|key|credential)",
    "name": r"(?i)(name|contact|dear|signed|from|by|von|de)",
}
AGAINST = r"(?i)(version|isbn|issn|order|invoice|serial|sha|md5|commit|example|chapter|section|page)"
CONTEXT = 32

LABELERS = ["shape", "separator", "gazetteer", "cue", "against", "check"]


def _prefix_sums(values: Column, block: int = 128) -> Column:
    """Running totals of an array of numbers, by blocks: no step copies more than a block."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1)
    blocks = F.when(F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i * block + 1, F.lit(block)))).otherwise(
        F.array().cast("array<array<bigint>>")
    )

    def running(items: Column, first: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(first.alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"] + x).alias("out")),
            lambda acc: acc["out"],
        )

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    with_first = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, b: F.struct((acc["sum"] + total(b)).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.zip_with(blocks, with_first, running))


def located(text: Column, found: Column, pattern: str) -> Column:
    """start and end (code points) of the matches of a pattern, given the matches themselves."""
    parts = F.split(text, pattern, -1)
    steps = F.when(
        F.size(found) > 0,
        F.zip_with(
            F.transform(F.slice(parts, 1, F.size(found)), lambda p: F.length(p).cast("bigint")),
            F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.slice(found, 1, F.size(found) - 1), lambda m: F.length(m).cast("bigint"))),
            lambda gap, last: gap + last,
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.zip_with(
        _prefix_sums(steps),
        found,
        lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


# Functions of one array element; the kind is bound outside, since a second argument would be its place.


def _test_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["value"])


def _span_of(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _description_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: _described(kind, s, F.col("text"))


def _is_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def with_spans(docs: DataFrame, text_col: str, kinds: list[str] = KINDS) -> tuple[DataFrame, dict[str, str]]:
    """The documents with one array of (start, end, value) per base kind; and its name by kind."""
    names = {k: fresh(docs, f"spans_{k}") for k in kinds}
    hits = {k: fresh(docs, f"hits_{k}") for k in kinds}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.withColumns(
        {hits[k]: F.when(GUARDS[k](text), F.regexp_extract_all(text, F.lit(BASE[k]), F.lit(0))).otherwise(none) for k in kinds}
    )
    out = out.withColumns({names[k]: located(text, F.col(hits[k]), BASE[k]) for k in kinds})
    out = out.withColumns({names[k]: F.filter(F.col(names[k]), _test_of(k)) for k in kinds})
    return out.drop(*hits.values()), names


def _candidates(docs: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    hits = {k: f"__found_{k}" for k in CANDIDATES}
    none = F.array().cast("array<string>")
    guard = {k: CANDIDATE_GUARDS.get(k, lambda t: F.lit(True))(text) for k in CANDIDATES}
    out = docs.withColumns({hits[k]: F.when(guard[k], F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(none) for k, rx in CANDIDATES.items()})
    places = {k: f"__at_{k}" for k in CANDIDATES}
    out = out.withColumns({places[k]: located(text, F.col(hits[k]), CANDIDATES[k]) for k in CANDIDATES})
    return out.drop(*hits.values()), list(places.values())


def _vote(plus: Column, minus: Column | None = None) -> Column:
    """1, -1 or 0 (abstains)."""
    no = F.when(minus, -1).otherwise(0) if minus is not None else F.lit(0)
    return F.when(plus, 1).otherwise(no).cast("int")


def _described(kind: str, place: Column, text: Column) -> Column:
    """A candidate with its votes and features."""
    value = place["value"]
    before = F.substring(text, F.greatest(place["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(place["start"], F.lit(CONTEXT)).cast("int"))
    digits = F.length(_digits(value))
    cue = before.rlike(CUES[kind]) | (value.rlike(CUES[kind]) if kind == "secret" else F.lit(False))
    gazetteer = {
        "email": _vote(value.rlike(r"(?i)(com|org|net|edu|gov|de|fr|es|io)$")),
        "ip": _vote(value.rlike(r"(?i)^(2001|2[0-9a-f]{3}|fe80|fd)")),
        "card": _vote(value.rlike(r"^[3456]"), value.rlike(r"^0")),
        "phone": _vote(F.lit(False), value.rlike(r"^\(?0{3}")),
        "secret": _vote(value.rlike(r"(?i)(token|api|secret)")),
        "name": _vote(F.lit(True)),
    }[kind]
    shape = {
        "email": _vote(value.rlike(r"(?i)\[at\].*\[dot\]")),
        "ip": _vote(F.lit(True)),
        "card": _vote(value.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$")),
        "phone": _vote(value.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$"), value.rlike(r"^\(?[0-9]{3}[ .-]")),
        "secret": _vote(value.rlike(r"[0-9]") & value.rlike(r"(?i)[a-z]{1}[0-9]|[0-9][a-z]"), ~value.rlike(r"[0-9]")),
        "name": _vote(value.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}")),
    }[kind]
    check = {
        "card": _vote(F.call_function("luhn_check", _digits(value)), ~F.call_function("luhn_check", _digits(value))),
        "secret": _vote(F.length(value) >= 24, F.length(value) < 18),
        "phone": _vote(digits == 10),
        "ip": _vote(~value.rlike(r"(?i)^(0{1,4}:){3}")),
    }.get(kind, _vote(F.lit(False)))
    separator = _vote(value.rlike(r"[ .:@\[\]()=-]"), value.rlike(r"^[0-9]+$"))
    against = _vote(F.lit(False), before.rlike(AGAINST))
    length = F.length(value)
    features = F.array(
        F.when(length < 12, 0).when(length < 16, 1).when(length < 20, 2).when(length < 32, 3).when(length < 48, 4).otherwise(5),
        F.when(digits == 0, 0).when(digits * 4 < length, 1).when(digits * 4 < length * 3, 2).when(digits < length, 3).otherwise(4),
        cue.cast("int"),
        before.rlike(AGAINST).cast("int"),
        F.when(place["start"] == 0, 0).when(before.rlike(r"\s$"), 1).otherwise(2),
        (check + 1),
        (shape + 1),
    )
    return F.struct(
        F.lit(kind).alias("kind"),
        place["start"].alias("start"),
        place["end"].alias("end"),
        F.array(shape, separator, gazetteer, _vote(cue), against, check).alias("votes"),
        features.alias("features"),
    )


N_FEATURES = 7
FEATURE_VALUES = 6


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base (kind, start, end) in order, candidates; one scan of the texts."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found, names = with_spans(narrow, "text")
    found, places = _candidates(found, F.col("text"))
    base = F.concat(*[F.transform(F.col(names[k]), _span_of(i, k)) for i, k in enumerate(KINDS)])
    described = F.concat(*[F.transform(F.col(p), _description_of(k)) for k, p in zip(CANDIDATES, places)])
    out = found.select("doc_id", F.array_sort(base).alias("base"), described.alias("candidates"))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn("candidates", F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates")))


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p) - math.log(1 - p)


def _numbers(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _by_kind(values: dict[str, float], kind: str = "kind") -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in values.items()) + f")[{kind}]"


def _weighed(array: str, weights: list[float], per_place: int, first: int) -> str:
    """SQL: the sum of the weights of an array of small numbers from ``first`` on; each place has
    ``per_place`` weights."""
    looked_up = f"transform({array}, (x, i) -> element_at({_numbers(weights)}, i * {per_place} + x + {1 - first}))"
    return f"aggregate({looked_up}, 0D, (sum, x) -> sum + x)"


def reliabilities(candidates: DataFrame, rounds: int = 12) -> tuple[dict, str]:
    """Expectation-maximisation over the counts of vote patterns.

    Returns the estimates {(labeler, vote): (share among true, share among false)} with the
    prior per kind, and the log odds of a candidate as SQL. It starts from the sum of the
    votes; each count is smoothed, a vote for as a true candidate and a vote against as a
    false one, so that no candidates leave an even prior."""
    patterns = written(candidates.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")), "votes")
    odds = "aggregate(votes, 0D, (sum, x) -> sum + x)"
    model: dict = {}
    for _ in range(rounds):
        weighed = patterns.withColumn("p", F.expr(f"1 / (1 + exp(-({odds})))"))
        cells = weighed.select("kind", "n", "p", F.posexplode("votes").alias("labeler", "vote"))
        sums = cells.groupBy("kind", "labeler", "vote").agg(F.expr("sum(n * p)").alias("t"), F.expr("sum(n * (1 - p))").alias("f"))
        rows = sums.collect()  # kinds x labelers x 3 at most
        prior = {}
        for k in CANDIDATES:
            true, false = (sum(r[side] for r in rows if r["kind"] == k and r["labeler"] == 0) for side in ("t", "f"))
            prior[k] = (true + 1) / (true + false + 2)
        model = {"prior": prior}
        for i, labeler in enumerate(LABELERS):
            own = [r for r in rows if r["labeler"] == i]
            for v in (-1, 0, 1):
                extra = {"t": 2.0 if v >= 0 else 0.5, "f": 2.0 if v <= 0 else 0.5}
                model[labeler, v] = tuple(
                    (sum(r[side] for r in own if r["vote"] == v) + extra[side]) / (sum(r[side] for r in own) + 4.5) for side in ("t", "f")
                )
        weights = [math.log(model[x, v][0] / model[x, v][1]) for x in LABELERS for v in (-1, 0, 1)]
        odds = _by_kind({k: _log_odds(p) for k, p in prior.items()}) + " + " + _weighed("votes", weights, 3, -1)
    return model, odds


def span_classifier(candidates: DataFrame, odds: str) -> tuple[dict[str, float], list[float]]:
    """Naive Bayes over the features, trained on the posteriors of the candidates: log odds per
    kind, and per feature and value."""
    weighed = candidates.withColumn("p", F.expr(f"1 / (1 + exp(-({odds})))"))
    cells = weighed.select("kind", "p", F.posexplode("features").alias("feature", "value"))
    rows = cells.groupBy("kind", "feature", "value").agg(F.sum("p").alias("t"), F.expr("sum(1 - p)").alias("f")).collect()
    per_kind = {}
    for k in CANDIDATES:
        true, false = (sum(r[side] for r in rows if r["kind"] == k and r["feature"] == 0) for side in ("t", "f"))
        per_kind[k] = _log_odds((true + 1) / (true + false + 2))
    weights = []
    for j in range(N_FEATURES):
        own = [r for r in rows if r["feature"] == j]
        total = {side: sum(r[side] for r in own) + FEATURE_VALUES for side in ("t", "f")}
        for v in range(FEATURE_VALUES):
            share = {side: (sum(r[side] for r in own if r["value"] == v) + 1) / total[side] for side in ("t", "f")}
            weights.append(math.log(share["t"] / share["f"]))
    return per_kind, weights


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """doc_id, base and spans: arrays of (start, rank, end, kind) in order of start and kind;
    ends are exclusive, places count code points. Base spans always stay; candidates join them
    where the classifier gives at least ``accept``. A NULL text is empty and has no spans; equal
    rows give equal rows; an empty table gives none."""
    kept = written(scanned(docs, id_col, text_col), "spans")
    candidates = kept.select(F.explode("candidates").alias("c")).select("c.*")
    _, odds = reliabilities(candidates)
    per_kind, weights = span_classifier(candidates, odds)
    ranks = {k: float(i) for i, k in enumerate([*KINDS, *[k for k in CANDIDATES if k not in KINDS]])}
    odds = _by_kind(per_kind, "c.kind") + " + " + _weighed("c.features", weights, FEATURE_VALUES, 0)
    added = F.expr(
        f"transform(filter(candidates, c -> {odds} >= {_log_odds(accept)!r}D), c -> "
        f"named_struct('start', c.start, 'rank', int({_by_kind(ranks, 'c.kind')}), 'end', c.end, 'kind', c.kind))"
    )
    spans = F.array_sort(F.array_distinct(F.concat("base", added)))
    return kept.select("doc_id", "base", F.when(F.size("candidates") > 0, spans).otherwise(F.col("base")).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, their digest, and all spans as text."""
    found = personal_data(docs)
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", _is_of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
