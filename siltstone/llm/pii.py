"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans.  Four labelers vote on each (for, against or not at all): its format, a gazetteer,
the words before it and what follows it.  Expectation maximisation over the counted vote patterns estimates how far
each labeler can be relied on, and the posteriors train a linear span classifier over votes, kind and shape.  Spans of
the four base kinds that pass their own check always stay; other candidates stay if the classifier takes them.

The driver gets counts of vote patterns only: at most kinds x 3^4 votes x shapes, whatever the number of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import staged, table

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "name")
BASE = 4  # the first kinds are the base ones
LABELERS = ("by_format", "by_gazetteer", "by_words_before", "by_what_follows")
SHAPES = 12

# (kind, base, pattern).  Runs are possessive and start where a run starts or the last match ended, so that no text
# takes more than linear time; the matches are those of the plain patterns.
PATTERNS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("phone", False, r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", False, r"(?<![A-Za-z])(?:password|passwd|token|secret|api[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("name", False, r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"),
)
# What a text must hold for a pattern to be tried at all.
GATES = ("@", None, None, "+", "at", None, "-", None, "=|:|AKIA", "r|s|of")

_DOMAINS = "com|org|net|edu|gov|int|info|io|co|de|fr|es|it|nl|be|at|ch|fi|se|no|dk|pl|pt|uk|ie|eu|us|ca|au|jp|in|br|mx|ar|example|test"
_COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"
_GIVEN = "James|Mary|John|Linda|Robert|Anna|Maria|Peter|Paul|Thomas|Laura|Sofia|Carlos|Juan|Jean|Pierre|Marie|Hans|Klaus|Julia|Sarah|David|Daniel|Michael|Emma"
_FOR = r"(?i)(?:e-?mail|mail|contact|write to|reach|call|tel|phone|mobile|fax|dial|ip|addr|host|server|card|visa|credit|pay|account|iban|ssn|social|name|dear|password|token|key|secret|login)\W{0,12}$"
_AGAINST = r"(?i)(?:version|v|page|chapter|section|isbn|no|item|figure|table|order|part)\.?\W{0,3}$"


RUN = 256  # items of a long array that are folded together


def running(items: str, first: str, kind: str, fold) -> str:
    """SQL for an array of what ``fold`` gives over all items before each one, in blocks: an array that grows item by item is copied each time."""
    none = f"cast(array() as array<{kind}>)"
    step = f"(a, v) -> named_struct('p', {fold('a.p', 'v')}, 'o', array_append(a.o, a.p))"
    blocks = f"transform(sequence(0, (size(w) - 1) div {RUN}), j -> slice(w, cast(j * {RUN} + 1 as int), {RUN}))"
    starts = f"aggregate(blocks, named_struct('p', {first}, 'o', {none}), (a, b) -> named_struct('p', aggregate(b, a.p, (q, v) -> {fold('q', 'v')}), 'o', array_append(a.o, a.p))).o"
    inner = f"flatten(transform(blocks, (b, j) -> aggregate(b, named_struct('p', starts[j], 'o', {none}), {step}).o))"
    return f"transform(array({items}), w -> transform(array({blocks}), blocks -> transform(array({starts}), starts -> {inner})[0])[0])[0]"


def luhn(digits: str) -> str:
    """SQL for Luhn's check of a string of digits."""
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, int(substring({digits}, length({digits}) - i + 1, 1)), element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substring({digits}, length({digits}) - i + 1, 1)) + 1))) % 10 = 0"


def _votes(kind: str, base: bool) -> tuple[str, str]:
    """SQL for the votes by format and by gazetteer on ``x.s``, and nothing else; ``d`` is its digits."""
    d = "regexp_replace(x.s, '[^0-9]', '')"
    if kind == "email":
        tail = "lower(element_at(split(regexp_replace(x.s, '[\\\\)\\\\]\\\\} ]', '.'), '[.]'), -1))"
        return ("1" if base else "if(x.s rlike '(?i)[(\\\\[{]at[)\\\\]}]', 1, -1)"), f"if({tail} rlike '^(?:{_DOMAINS})$', 1, -1)"
    if kind == "ip":
        ok = "forall(split(x.s, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(p, 3))) <= 255)"
        return f"if({ok}, 1, -1)", "if(x.s rlike '^(?:0|127|255)[.]', -1, 1)"
    if kind == "card":
        return f"if(length({d}) between 13 and 19, if({luhn(d)}, 1, -1), -1)", f"if({d} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)', 1, -1)"
    if kind == "phone":
        area = f"regexp_extract({d}, '([0-9]{{3}})[0-9]{{7}}$', 1)"
        return f"if(length({d}) between {9 if base else 10} and 15, 1, -1)", f"if({area} rlike '^[2-9]', 1, -1)"
    if kind == "ssn":
        return "if(x.s rlike '^(?:000|666|9)|-00-|-0000$', -1, 1)", "if(x.s rlike '^(?:123-45-6789|078-05-1120)$', -1, 0)"
    if kind == "iban":
        return "if(length(regexp_replace(x.s, ' ', '')) between 15 and 34, 1, -1)", f"if(x.s rlike '^(?:{_COUNTRIES})', 1, -1)"
    if kind == "secret":
        return "if(x.s rlike '[0-9]', 1, -1)", "if(x.s rlike '^AKIA|(?i)password|token', 1, 0)"
    return "if(x.s rlike ' [A-Z][a-z]+ [A-Z]', 1, 0)", f"if(x.s rlike '(?: |^)(?:{_GIVEN})(?: |$)', 1, 0)"


def _candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, c)``: the candidates of each row as an array of (kind, base, lo, hi, votes, shape); places in code points."""
    text = F.col("text")

    def gate(signs: str | None) -> Column:
        held = F.lit(True)
        if signs:
            held = F.lit(False)
            for s in signs.split("|"):
                held = held | F.contains(text, F.lit(s))
        return held

    found = docs.select("doc_id", "text", *[F.when(gate(g), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"m{i}") for i, ((_, _, p), g) in enumerate(zip(PATTERNS, GATES, strict=True))])
    cut = found.select("doc_id", *[F.col(f"m{i}") for i in range(len(PATTERNS))], *[F.when(F.size(f"m{i}") > 0, F.split(text, p, -1)).alias(f"g{i}") for i, (_, _, p) in enumerate(PATTERNS)])
    item = "struct<lo:int,hi:int,s:string,l:string,r:string>"
    placed = cut.select(
        "doc_id",
        *[
            F.expr(
                f"if(size(g{i}) > 1, transform(array({running(f'transform(m{i}, (m, k) -> length(g{i}[k]) + length(m))', '0', 'int', lambda a, v: f'{a} + {v}')}), p -> transform(m{i}, (m, k) -> named_struct("
                f"'lo', p[k] + length(g{i}[k]), 'hi', p[k] + length(g{i}[k]) + length(m), 's', m, 'l', right(g{i}[k], 32), 'r', left(g{i}[k + 1], 2))))[0], cast(array() as array<{item}>))"
            ).alias(f"x{i}")
            for i in range(len(PATTERNS))
        ],
    )
    parts = []
    for i, (kind, base, _) in enumerate(PATTERNS):
        by_format, by_gazetteer = _votes(kind, base)
        parts.append(
            f"transform(x{i}, x -> named_struct('kind', {KINDS.index(kind)}, 'base', {str(base).lower()} and {by_format} = 1, 'own', {str(base).lower()}, 'lo', x.lo, 'hi', x.hi, "
            f"'v', array({by_format}, {by_gazetteer}, if(x.l rlike :for, 1, if(x.l rlike :against, -1, 0)), if(x.r rlike '^[A-Za-z0-9_]', -1, if(x.r rlike '^(?:[ ,.;:!?)\\n]|$)', 1, 0))), "
            f"'shape', int(least(2, floor(length(x.s) / 16)) * 4 + least(3, floor(4 * length(regexp_replace(x.s, '[^0-9]', '')) / length(x.s))))))"
        )
    whole = "concat(" + ", ".join(parts) + ")"
    whole = whole.replace(":for", "'" + _FOR.replace("\\", "\\\\") + "'").replace(":against", "'" + _AGAINST.replace("\\", "\\\\") + "'")
    return placed.select("doc_id", F.expr(whole).alias("c"))


class SpanModel:
    """Labeler reliabilities and the weights of the span classifier, from counts of (kind, votes, shape)."""

    def __init__(self, counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 30, prior: float = 0.5):
        self.rates = [{v: ((0.5, 0.3, 0.2)[1 - v], (0.2, 0.3, 0.5)[1 - v]) for v in (-1, 0, 1)} for _ in LABELERS]
        kinds = len(KINDS)
        share = [prior] * kinds
        posterior: list[float] = []
        for _ in range(rounds):
            posterior = []
            for kind, votes, _shape, _n in counts:
                yes, no = math.log(share[kind]), math.log(1 - share[kind])
                for rate, v in zip(self.rates, votes, strict=True):
                    yes, no = yes + math.log(rate[v][0]), no + math.log(rate[v][1])
                posterior.append(1 / (1 + math.exp(max(-30.0, min(30.0, no - yes)))))
            total = [[2.0, 2.0] for _ in range(kinds)]
            seen = [{v: [r[v][0] * 2, r[v][1] * 2] for v in r} for r in self.rates]
            for p, (kind, votes, _shape, n) in zip(posterior, counts, strict=True):
                total[kind][0] += p * n
                total[kind][1] += (1 - p) * n
                for s, v in zip(seen, votes, strict=True):
                    s[v][0] += p * n
                    s[v][1] += (1 - p) * n
            share = [min(0.99, max(0.01, a / (a + b))) for a, b in total]
            for rate, s in zip(self.rates, seen, strict=True):
                for y in (0, 1):
                    mass = sum(x[y] for x in s.values())
                    for v in rate:
                        fresh = max(1e-4, s[v][y] / mass)
                        rate[v] = (fresh, rate[v][1]) if y == 0 else (rate[v][0], fresh)
        self.kind, self.shape, self.vote, self.bias = [0.0] * kinds, [0.0] * SHAPES, [0.0] * len(LABELERS), 0.0
        whole = sum(n for *_, n in counts) or 1
        for _ in range(400):  # gradient steps on at most a few thousand patterns
            gk, gs, gv, gb = [0.0] * kinds, [0.0] * SHAPES, [0.0] * len(LABELERS), 0.0
            for p, (kind, votes, shape, n) in zip(posterior, counts, strict=True):
                away = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(kind, votes, shape)))))) * n / whole
                gk[kind], gs[shape], gb = gk[kind] + away, gs[shape] + away, gb + away
                for j, v in enumerate(votes):
                    gv[j] += away * v
            step = 2.0
            self.bias += step * gb
            self.kind = [w + step * (g - 1e-4 * w) for w, g in zip(self.kind, gk, strict=True)]
            self.shape = [w + step * (g - 1e-4 * w) for w, g in zip(self.shape, gs, strict=True)]
            self.vote = [w + step * (g - 1e-4 * w) for w, g in zip(self.vote, gv, strict=True)]

    def logit(self, kind: int, votes: tuple[int, ...], shape: int) -> float:
        return self.bias + self.kind[kind] + self.shape[shape] + sum(w * v for w, v in zip(self.vote, votes, strict=True))

    def sql(self, x: str) -> str:
        """The logit as SQL over a candidate."""

        def pick(weights: list[float], at: str) -> str:
            return f"element_at(array({', '.join(f'{w!r}D' for w in weights)}), {at} + 1)"

        return " + ".join([f"{self.bias!r}D", pick(self.kind, f"{x}.kind"), pick(self.shape, f"{x}.shape"), *(f"{w!r}D * {x}.v[{j}]" for j, w in enumerate(self.vote))])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, base, spans``, arrays of (kind, lo, hi) by kind as listed, then place.

    Places count code points, the end exclusive.  ``base`` has the spans of the four base patterns that pass their
    checks; ``spans`` has these and what the classifier adds, which never overlaps a base span.  Null and empty texts
    have none; repeated rows each get their result; other columns aren't read; an empty table gives no rows.  The time of
    a text grows with its length.  The base kinds have no bounds; the added ones take at most 8 domain parts of 63 signs,
    names of two words of 31 letters, and the 32 characters before a span as its context.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    c = staged(_candidates(d), "candidates")
    counted = c.select(F.explode("c").alias("x")).groupBy("x.kind", "x.v", "x.shape").count().collect()  # bounded: see above
    model = SpanModel([(r.kind, tuple(r.v), r["shape"], r["count"]) for r in sorted(counted, key=lambda r: (r.kind, tuple(r.v), r["shape"]))])
    base = c.select("doc_id", F.expr("filter(c, x -> x.base)").alias("b"), F.expr(f"filter(c, x -> not x.own and {model.sql('x')} > 0)").alias("e"))
    # An added span goes where a base span that begins before its end reaches beyond its begin: one pass in order of these places.
    places = "array_sort(concat(transform(b, y -> named_struct('at', y.lo, 'kind', -1, 'lo', y.lo, 'hi', y.hi)), transform(e, x -> named_struct('at', x.hi, 'kind', -2 - x.kind, 'lo', x.lo, 'hi', x.hi))))"
    reach = running("v", "-1", "int", lambda a, v: f"greatest({a}, if({v}.kind = -1, {v}.hi, -1))")
    free = f"transform(array({places}), v -> transform(array({reach}), far -> transform(filter(transform(v, (x, k) -> named_struct('x', x, 'free', x.kind < -1 and far[k] <= x.lo)), y -> y.free), y -> named_struct('kind', -2 - y.x.kind, 'lo', y.x.lo, 'hi', y.x.hi)))[0])[0]"
    none = "cast(array() as array<struct<kind:int,lo:int,hi:int>>)"
    more = base.select("doc_id", "b", F.expr(f"if(size(e) = 0, {none}, {free})").alias("e"))
    place = "x -> named_struct('kind', x.kind, 'lo', x.lo, 'hi', x.hi)"
    return more.select("doc_id", F.expr(f"array_sort(transform(b, {place}))").alias("base"), F.expr(f"array_sort(concat(transform(b, {place}), e))").alias("spans"))


def op1_pii_weak(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null and empty texts have no spans and the digest of nothing; an empty table gives no rows."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    names = ", ".join(f"'{k}'" for k in KINDS)

    def joined(column: str) -> Column:
        return F.expr(f"array_join(transform({column}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.lo, ':', x.hi)), ',')")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
