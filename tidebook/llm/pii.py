"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap: mail addresses and address-like handles, dotted
quads, long digit chains, phone numbers with and without a leading plus, national identity numbers and account
numbers.  Each candidate has format features (kind, length, digits, separators, whether its leading digits are ones that
are given out) and context features (characters around it, a telling word before it, another candidate close by), all
cut into few levels.

No labels of personal data are given, so candidates are labelled by what their features do not hold.  Kinds with a check
(the base rules' checks, the Luhn and mod-97 sums) are labelled by it.  Kinds without one (``HINTED``) are labelled by a
telling word before them, which is no feature of theirs; as not every true one has such a word, a share of ``TOLD`` of
true ones is assumed to, and the wanted share of labels is that much lower.

Counting candidates by features and label over the whole corpus gives a table whose size is bounded by the number
of feature levels; boosted trees are fitted to that table, and to a few candidates that are known beforehand (``PRIOR``), on the
driver and written back as CASE expressions.  Per hinted kind, the threshold is the score down to which every score has the
wanted share among the candidates of a quarter of the texts that the fit has not seen (copies of a text are on one side), to
which ``DOUBT`` candidates with the score's own odds are added.  That is one rule at any size: without candidates the threshold is the
log odds of the share, and each candidate moves it a little.

A candidate that passes its validator is always a span, whatever the number of its kind, unless it is of a kind
without a base rule and overlaps a base span.  One that fails a check is none; of the hinted kinds, where no telling
word says little, the model adds candidates that reach their kind's threshold and overlap no base span.

Offsets are code points.  A pattern's matches and the gaps between them are two arrays of one row, and the starts
are running sums of their lengths, taken in blocks so that texts with very many matches stay cheap.

Defined cases: a null or empty text has no spans; repeated documents are treated one by one; a null id stays null;
an empty table gives no rows; other columns are left alone (``redact`` keeps them all).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import fresh, let, shared_checkpoint, table

#: Kinds with a base rule first, in the order of ties.
KINDS = ("email", "ip", "card", "phone", "handle", "local_phone", "identity", "account")
BASE = 4

# The contract's base patterns, anchored where a scan from the left would start a match, so that they
# never try the inside of a run again; lengths that a failing match would have are left out where that changes nothing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{3,64}@[A-Za-z0-9-]{3,63}(?![A-Za-z0-9.@-])",
    "local_phone": r"(?<![0-9+.)(-])(?<![0-9] )(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![\x20.-]?[0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text with a match of the kind holds; the other kinds need a digit.
GUARDS = {"email": "@", "handle": "@"}
HINT = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|account|iban|ssn|social|address|born|passport|konto|telefon|tarjeta|carte)[^A-Za-z]{0,12}$"
#: Leading digits that are given out, for kinds where not all are.
GIVEN_OUT = {"card": r"^[3-6]", "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]", "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"}
#: Kinds that the telling word labels, so that it is no feature of theirs.
HINTED = ("handle", "local_phone", "identity")
#: Share of the true ones of such a kind that are assumed to stand behind a telling word.
TOLD = 0.5
#: Characters of context before a candidate, and how close another one counts as near.
CONTEXT = 24
NEAR = 80
#: Feature levels: kind, length, digits, separators, before, after, hint, given out, near.
LEVELS = (len(KINDS), 8, 8, 4, 5, 5, 2, 2, 2)
PRECISION = 0.95
#: Candidates of each hinted kind that are taken as seen, true and other ones, by whether their leading digits are given out and
#: whether another candidate is near, and the levels of length, digits, separators, before and after that they have.
PRIOR = {(1, 1): (12, 1), (1, 0): (3, 9), (0, 1): (1, 9), (0, 0): (0, 12)}
PRIOR_LEVELS = {"handle": (2, 0, 1, 1, 1), "local_phone": (3, 3, 2, 1, 1), "identity": (2, 3, 2, 1, 1)}
#: Candidates with the odds of a threshold that are added to those it is held against.
DOUBT = 20
_BLOCK = 256


def _matches(text: Column, kind: str) -> Column:
    """All matches of a pattern: start, end, match, and the text before and after."""
    pattern = PATTERNS[kind]

    def placed(gaps: Column, hits: Column, lens: Column, blocks: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            inside = F.aggregate(F.slice(lens, block * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda s, x: s + x)
            start = F.element_at(blocks, block + 1) + inside + F.length(gaps[i])
            return F.struct(
                start.cast("long").alias("start"),
                (start + F.length(hit)).cast("long").alias("end"),
                hit.alias("hit"),
                F.right(gaps[i], F.lit(CONTEXT)).alias("before"),
                F.left(gaps[i + 1], F.lit(1)).alias("after"),
            )

        return F.transform(hits, one)

    def block_starts(lens: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int"))
        sums = F.transform(numbers, lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda s, x: s + x))
        return F.aggregate(sums, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    found = let(
        F.split(text, pattern, -1),
        lambda gaps: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda hits: let(
                F.transform(hits, lambda h, i: F.length(gaps[i]) + F.length(h)),
                lambda lens: let(block_starts(lens), lambda blocks: placed(gaps, hits, lens, blocks)),
            ),
        ),
    )
    return F.when(text.rlike(pattern), found)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = 2 * v - F.when(v > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, v).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(hit: Column) -> Column:
    """Whether an account number passes its mod-97 sum."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (total * 10 + c - 48) % 97).otherwise((total * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, hit: Column, hint: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # as strings: a part may have more digits than any number type
        return ~F.exists(F.split(hit, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) > 3) | (F.lpad(q, 3, "0") > "255")))
    if kind == "card":
        return let(_digits(hit), luhn)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "account":
        return _mod97(hit)
    return hint


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^[A-Za-z]"), 3).otherwise(4)
    )


def candidates(text: Column) -> Column:
    """All candidates of a text by start: kind number, start, end, valid, and the feature levels."""

    def of(number: int, kind: str) -> Column:
        def one(m: Column) -> Column:
            hit, hint = m["hit"], m["before"].rlike(HINT)
            n = F.length(hit)
            digits = F.length(_digits(hit))
            seps = F.length(F.regexp_replace(hit, r"[^\x20().@-]", ""))
            return F.struct(
                m["start"].alias("start"),
                F.lit(number).alias("kind"),
                m["end"].alias("end"),
                F.coalesce(_valid(kind, hit, hint), F.lit(False)).alias("valid"),
                F.array(
                    F.lit(number),
                    F.least(F.floor(n / 4), F.lit(7)).cast("int"),
                    F.least(F.floor(digits / 3), F.lit(7)).cast("int"),
                    F.least(seps, F.lit(3)),
                    _char_class(F.right(m["before"], F.lit(1))),
                    _char_class(m["after"]),
                    F.lit(0) if kind in HINTED else hint.cast("int"),
                    hit.rlike(GIVEN_OUT[kind]).cast("int") if kind in GIVEN_OUT else F.lit(1),
                ).alias("x"),
            )

        return F.coalesce(F.transform(_matches(text, kind), one), F.array())

    def with_near(found: Column) -> Column:
        def close(gap: Column) -> Column:
            return F.coalesce(gap.between(0, NEAR), F.lit(False))

        def one(c: Column, i: Column) -> Column:
            before = F.when(i > 0, c["start"] - F.element_at(found, F.greatest(i, F.lit(1)))["end"])
            after = F.when(i < F.size(found) - 1, F.element_at(found, F.least(i + 2, F.size(found)))["start"] - c["end"])
            x = F.concat(c["x"], F.array((close(before) | close(after)).cast("int")))
            return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["valid"].alias("valid"), x.alias("x"))

        return F.transform(found, one)

    def guarded(there: Column, kinds: list[str]) -> Column:
        return F.when(there, F.concat(*[of(KINDS.index(k), k) for k in kinds])).otherwise(F.array())

    mails, numbers = [k for k in KINDS if k in GUARDS], [k for k in KINDS if k not in GUARDS]
    every = F.concat(guarded(F.contains(text, F.lit("@")), mails), guarded(text.rlike("[0-9]"), numbers))
    return let(F.array_sort(every), with_near)


@dataclass
class BoostedTrees:
    """Depth-2 trees over feature levels: (feature, cut, (feature, cut, low, high) for either side)."""

    bias: float
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of feature levels."""
        z = np.full(len(x), self.bias)
        for f, cut, below, above in self.trees:
            for side, (g, c, low, high) in ((x[:, f] <= cut, below), (x[:, f] > cut, above)):
                z += np.where(side, np.where(x[:, g] <= c, low, high), 0.0)
        return z

    def column(self, x: Column) -> Column:
        """Log odds as an expression over the array of feature levels."""
        z = F.lit(self.bias)
        for f, cut, *sides in self.trees:
            low, high = (F.when(x[g] <= c, a).otherwise(b) for g, c, a, b in sides)
            z = z + F.when(x[f] <= cut, low).otherwise(high)
        return z


def _leaf_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, tuple]:
    """The best cut of these rows: gain and (feature, cut, value below, value above)."""
    best: tuple[float, tuple] = (-1.0, (0, 0, 0.0, 0.0))
    gt, ht = g.sum(), h.sum()
    for f, levels in enumerate(LEVELS):
        gl, hl = (np.cumsum(np.bincount(x[:, f], v, levels))[:-1] for v in (g, h))
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-9:
            low, high = gl[at] / (hl[at] + 1), (gt - gl[at]) / (ht - hl[at] + 1)
            best = (float(gain[at]), (f, at, float(low), float(high)))
    return best


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, n_trees: int = 40, rate: float = 0.3) -> BoostedTrees:
    """Boost on rows of feature levels with their numbers of valid and other candidates."""
    n, pos = float((positive + negative).sum()), float(positive.sum())
    model = BoostedTrees(float(np.log((pos + 1) / (n - pos + 1))))
    if n == 0 or pos in (0, n):
        return model
    z = np.full(len(x), model.bias)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = positive - (positive + negative) * p, (positive + negative) * p * (1 - p)
        best = None
        for f, levels in enumerate(LEVELS):
            for cut in range(levels - 1):
                low = x[:, f] <= cut
                if not low.any() or low.all():
                    continue
                (gain_a, a), (gain_b, b) = _leaf_cut(x[low], g[low], h[low]), _leaf_cut(x[~low], g[~low], h[~low])
                if best is None or gain_a + gain_b > best[0] + 1e-9:
                    best = (gain_a + gain_b, f, cut, a, b)
        if best is None:
            break
        _, f, cut, a, b = best
        tree = (f, cut, *[(s[0], s[1], rate * s[2], rate * s[3]) for s in (a, b)])
        z += BoostedTrees(0.0, [tree]).margin(x)
        model.trees.append(tree)
    return model


def fold_of(text: Column) -> Column:
    """Whether the candidates of a text are left out of the fit."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(4)) == 0, F.lit(False))


def train(found: DataFrame, cands: str = "cands", left_out: str = "left_out") -> BoostedTrees:
    """Fit and calibrate on all candidates of all rows.  Only counts by features are collected."""
    one = found.select(F.explode(F.col(f"`{cands}`")).alias("c"), F.col(f"`{left_out}`").alias("out"))
    rows = one.groupBy(F.col("c.x").alias("x"), F.col("c.valid").alias("valid"), "out").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["x"], r["valid"], r["out"]))
    table_: dict[tuple, np.ndarray] = {}
    for r in rows:
        table_.setdefault(tuple(r["x"]), np.zeros((2, 2)))[int(r["out"]), int(r["valid"])] += r["n"]
    x = np.array(list(table_), dtype=np.int64).reshape(len(table_), len(LEVELS))
    counts = np.array(list(table_.values())).reshape(len(table_), 2, 2)
    known = prior()
    model = fit(np.concatenate([x, known[:, :-2]]), np.append(counts[:, 0, 1], known[:, -2]), np.append(counts[:, 0, 0], known[:, -1]))
    z = model.margin(x)
    for kind in map(KINDS.index, HINTED):
        here = x[:, 0] == kind
        model.thresholds[kind] = threshold(z[here], counts[here, 1, 1], counts[here, 1, 0], PRECISION * TOLD)
    return model


def prior() -> np.ndarray:
    """Rows of feature levels, true and other candidates of what is taken as seen."""
    rows = []
    for kind, levels in PRIOR_LEVELS.items():
        for (given, near), counts in PRIOR.items():
            if given or kind in GIVEN_OUT:
                rows.append((KINDS.index(kind), *levels, 0, given, near, *counts))
    return np.array(rows, dtype=np.int64)


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, wanted: float) -> float:
    """The score down to which the wanted share is good at every score, with ``DOUBT`` more that have the score's own odds.

    Between the last score that has it and the first that has not, it is the log odds of the share.
    """
    levels = np.unique(scores)[::-1]  # from the highest down
    at = np.searchsorted(-levels, -scores)
    right, seen = (np.bincount(at, v, len(levels)) for v in (good, good + bad))
    enough = right + DOUBT / (1 + np.exp(-levels)) >= wanted * (seen + DOUBT)
    n = len(levels) if enough.all() else int(np.argmin(enough))
    below, above = levels[n] if n < len(levels) else -np.inf, levels[n - 1] if n else np.inf
    return float(min(above, max(np.nextafter(below, np.inf), np.log(wanted / (1 - wanted)))))


def _select(cands: Column, model: BoostedTrees) -> tuple[Column, Column]:
    """Base spans and all spans of a row's candidates, each sorted by start and kind."""

    def sorted_spans(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))

    base = F.filter(cands, lambda c: c["valid"] & (c["kind"] < BASE))
    learned = lambda c: F.lit(False)
    if model.thresholds:
        limits = F.create_map(*[F.lit(v) for kind, least in sorted(model.thresholds.items()) for v in (kind, float(least))])
        learned = lambda c: F.coalesce(model.column(c["x"]) >= limits[c["kind"]], F.lit(False))

    def added(c: Column, own: Column) -> Column:
        clear = ~F.exists(own, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return ~(c["valid"] & (c["kind"] < BASE)) & clear & (c["valid"] | learned(c))

    every = let(base, lambda own: F.concat(own, F.filter(cands, lambda c: added(c, own))))
    return sorted_spans(base), sorted_spans(every)


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """The documents with every selected span replaced by its kind in angle brackets; overlapping spans become one.

    Null texts stay null.  Without a model, one is fitted on all of ``docs`` first, and their candidates are kept in the
    shared folder meanwhile.
    """
    text = F.col(f"`{text_col}`")
    cands, left_out = fresh(docs.columns, "cands"), fresh(docs.columns, "left_out")
    found = docs.withColumns({cands: F.coalesce(candidates(text), F.array()), left_out: fold_of(text)})
    if model is None:
        found = shared_checkpoint(found)
        model = train(found, cands, left_out)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def rebuilt(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(s: Column, c: Column) -> Column:
            gap = F.substring(text, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))
            joined = F.when(c["start"] >= s["at"], F.concat(s["parts"], F.array(gap, names[c["kind"]]))).otherwise(s["parts"])
            return F.struct(F.greatest(s["at"], c["end"]).alias("at"), joined.alias("parts"))

        tail = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(spans, start, step, tail)

    spans = let(F.col(cands), lambda c: _select(c, model)[1])
    clean = let(spans, lambda s: F.when(F.size(s) > 0, rebuilt(text, s)).otherwise(text))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and selected spans of every document."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    found = shared_checkpoint(docs.select("doc_id", F.coalesce(candidates(text), F.array()).alias("cands"), fold_of(text).alias("left_out")))
    model = train(found)
    base, every = _select(F.col("cands"), model)
    spans = found.select("doc_id", base.alias("base"), every.alias("every"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return spans.select(
        "doc_id",
        *[number(k) for k in range(BASE)],
        F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.col("every")).alias("spans"),
    )
