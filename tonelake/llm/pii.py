"""Personal data: candidate spans by high-recall generators, judged by boosted trees, in DataFrame functions alone.

Base spans follow fixed patterns and checks, leftmost and non-overlapping within each kind, and always stay. The generators
propose more, overlapping each other: addresses with spaces, brackets or words for their signs, dotted quads with spaces or
brackets, numbers of 12 to 19 digits under any single separators, numbers that read like a phone's without a '+'.

What a validator says of a proposal is its label: Luhn's check for cards; a plus and a country code right before it, or two
zeros at its start, for phones; parts up to 255 and no word for a version before it for IPs; a known end of the domain for
addresses. The trees don't see the validators, only format (digits, groups, separators, first digit, last group, length) and
context (characters on either side, words before), so they learn which formats and contexts hold what validates. Proposals
of all documents are counted by features and label, and trees are fit on all of these combinations, however rare:
boosting by the logistic loss on histograms, a job per level of a tree, in whole numbers so that reruns agree. Each kind's
threshold is the lowest one at which held-out proposals (a fifth of the documents) reach ``precision``; a kind with
fewer than ``LEAST_HELD`` of them has none. Proposals from the threshold on that overlap no base span are added.

Patterns read a text in time linear in its length (possessive loops, bounded repeats) and need no stack, so texts of any
length and long runs of digits or letters pass; places are running sums over blocks of matches. A null text is empty.
A text without a span has '' in ``spans`` and the hash of '' in ``base_sha256``. Rows that repeat, equal ids and null
ids each get their row; columns besides the id and the text are ignored by ``spans_of`` and kept by ``redacted``. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import table, unused, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DEPTH, RATE, PRECISION, LEAST_HELD = 8, 3, 0.6, 0.95, 20
#: Matches whose running sum is taken anew.
BLOCK = 64
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?(?:@|[\[(]\x20?(?:at|AT|@)\x20?[\])])\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT|\.)\x20?[\])])\x20?|\x20(?:dot|DOT)\x20)"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}{_LABEL}{{1,63}}+(?:{_DOT}{_LABEL}{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}+){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]?+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+./-])\(?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,4}(?![0-9])",
}
#: A text without these has no match; a cheaper look than the pattern's.
NEEDS = {"email": "@|[(\\[ ](?:at|AT)[)\\] ]", "ip": "[0-9]", "card": "[0-9]{2}|[0-9][ ./_-][0-9]", "phone": "[0-9]{2}|\\+[0-9]"}

# Ends of domains, and words before a value, in the order in which they are looked for.
DOMAINS = "com org net edu gov info io dev biz eu uk us ca au de at ch fr be es mx it nl pl br jp in"
WORDS = {
    "token": "token|secret|sha|md5|hash|api.?key|passw",
    "version": "version|release|section|chapter|kapitel|chapitre|isbn|issn|doi|order|invoice|rechnung|facture|ticket",
    "mail": "mail|courriel|correo|contact|kontakt|contacto",
    "network": "ip|host|server|serveur|servidor|address|adresse|ping|dns",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|payment|zahlung|paiement|pago",
    "phone": "phone|telefon|tel|call|mobile|handy|fax|whatsapp|sms|anruf|appel|llam",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x["s"], "[^0-9]", "")


#: What a match of a base pattern must pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["s"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda x: F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}
#: What the validators say of a proposal.
LABELS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.array_contains(F.lit(DOMAINS.split()), F.regexp_extract(F.lower(x["s"]), "([a-z0-9-]+)$", 1)),
    "ip": lambda x: ~x["before"].rlike(r"(?:version|release|section|chapter|kapitel|chapitre|\bv)\W*$") & F.forall(F.regexp_extract_all(x["s"], F.lit("[0-9]+"), 0), lambda p: p.cast("int") <= 255),
    "card": lambda x: F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: x["before"].rlike(r"\+[0-9]{1,3}[\x20().-]*$") | x["s"].rlike("^00[1-9]"),
}


def _side(char: Column) -> Column:
    return F.when(char.rlike(r"^\s?$"), 0).when(char.rlike("[0-9]"), 1).when(char.rlike(r"[\p{L}_]"), 2).otherwise(3)


def _context(x: Column) -> Column:
    cases = F.lit(0)
    for i, words in reversed(list(enumerate(WORDS.values(), 1))):
        cases = F.when(x["before"].rlike(rf"\b(?:{words})"), i).otherwise(cases)
    return cases


#: Small whole numbers that trees split on.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "digits": lambda x: F.least(F.lit(20), F.length(_digits(x))),
    "groups": lambda x: F.least(F.lit(8), F.size(F.regexp_extract_all(x["s"], F.lit("[A-Za-z0-9]+"), 0))),
    "spaces": lambda x: F.contains(x["s"], F.lit(" ")).cast("int"),
    "dots": lambda x: F.contains(x["s"], F.lit(".")).cast("int"),
    "dashes": lambda x: x["s"].rlike("[-/_]").cast("int"),
    "brackets": lambda x: x["s"].rlike(r"[\[(]").cast("int"),
    "first": lambda x: F.when(x["s"].rlike("^[(]?[0-9]"), F.regexp_extract(x["s"], "[0-9]", 0).cast("int")).otherwise(10),
    "last": lambda x: F.least(F.lit(8), F.length(F.regexp_extract(x["s"], "([A-Za-z0-9]+)$", 1))),
    "long": lambda x: F.least(F.lit(12), F.floor(F.length(x["s"]) / 4)).cast("int"),
    "left": lambda x: _side(F.right(x["before"], F.lit(1))),
    "right": lambda x: _side(F.left(x["after"], F.lit(1))),
    "words": _context,
}
NAMES = ("kind", *FEATURES)


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` for a value computed once; a column might be computed anew for each element of an array."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, start: str, op: Callable[[str, str], str]) -> str:
    """SQL for the running ``op`` over an array of numbers: blocks first, then within a block, so that long arrays stay cheap."""

    def fold(array: str) -> str:
        return f"aggregate({array}, {start}, (acc, v) -> {op('acc', 'v')})"

    blocks = f"transform(sequence(0, (size(a) - 1) div {BLOCK}), b -> {fold(f'slice(a, CAST(b * {BLOCK} + 1 AS INT), {BLOCK})')})"
    heads = f"transform(sequence(0, size(bs) - 1), b -> {fold('slice(bs, 1, b)')})"
    within = fold(f"slice(a, CAST((i div {BLOCK}) * {BLOCK} + 1 AS INT), i % {BLOCK} + 1)")
    each = f"transform(sequence(0, size(a) - 1), i -> {op(f'hs[CAST(i div {BLOCK} AS INT)]', within)})"
    return let("a", values, f"CASE WHEN size(a) > 0 THEN {let('bs', blocks, let('hs', heads, each))} ELSE array() END")


def matches(text: str, pattern: str, needs: str) -> str:
    """SQL for an array of (start, stop, s, before, after): what a pattern matches, in code points from 0, and its context.

    A text without ``needs`` has no match. The text between matches gives their places and context.
    """
    moves = "transform(ms, (m, i) -> length(gs[i]) + CASE WHEN i > 0 THEN length(ms[i - 1]) ELSE 0 END)"
    each = "transform(ms, (m, i) -> struct(ps[i] AS start, ps[i] + length(m) AS stop, m AS s, lower(right(gs[i], 40)) AS before, left(gs[i + 1], 8) AS after))"
    placed = let("gs", f"split({text}, r'{pattern}', -1)", let("ps", running(moves, "0", lambda a, v: f"{a} + {v}"), each))
    found = f"CASE WHEN {text} RLIKE r'{needs}' THEN regexp_extract_all({text}, r'{pattern}', 0) ELSE array() END"
    return let("ms", found, f"CASE WHEN size(ms) > 0 THEN {placed} ELSE array() END")


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(the columns ``keep``, _base, _loose, _held) of every row.

    _base: spans (start, kind, stop) by start, then kind, the kind as its number. _loose: proposals (start, stop, kind,
    features, label y), each with ``free``, whether it overlaps no base span; those that aren't only teach.
    """
    keep = [id_col] if keep is None else keep
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0).alias("_held"))
    rows = rows.withColumns({f"_{g}_{k}": F.expr(matches("_t", p, NEEDS[k])) for g, of in (("b", BASE), ("l", LOOSE)) for k, p in of.items()})

    def kept(i: int, k: str) -> Column:
        return F.transform(F.filter(f"_b_{k}", CHECKS[k]), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["stop"].alias("stop")))

    def judged(i: int, k: str) -> Column:
        fields = {name: of for name, of in FEATURES.items()} | {"y": lambda x: LABELS[k](x).cast("int")}
        return F.transform(f"_l_{k}", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(i).alias("kind"), *[of(x).alias(name) for name, of in fields.items()]))

    base, loose = F.concat(*[kept(i, k) for i, k in enumerate(KINDS)]), F.concat(*[judged(i, k) for i, k in enumerate(KINDS)])
    return _freed(rows.select(*keep, "_held", F.array_sort(base).alias("_base"), loose.alias("_all"))).select(*keep, "_base", "_loose", "_held")


def _freed(rows: DataFrame) -> DataFrame:
    """Adds ``_loose``: how far base spans before a proposal reach, and where the next begins, say whether it is free of them."""
    marks = "array_sort(concat(transform(_base, b -> struct(b.start AS start, -1 AS at, b.stop AS stop)), transform(_all, (l, i) -> struct(l.start AS start, i AS at, l.stop AS stop))))"
    reach = running("transform(ms, m -> CASE WHEN m.at < 0 THEN m.stop ELSE 0 END)", "0", lambda a, v: f"greatest({a}, {v})")
    ahead = running("transform(reverse(ms), m -> CASE WHEN m.at < 0 THEN m.start ELSE 2147483647 END)", "2147483647", lambda a, v: f"least({a}, {v})")
    placed = "transform(ms, (m, i) -> struct(m.at AS at, before[i] <= m.start AND after[size(ms) - 1 - i] >= m.stop AS free))"
    placed = let("ms", marks, let("before", reach, let("after", ahead, placed)))
    loose = let("every", "_all", f"transform(filter({placed}, z -> z.at >= 0), z -> struct(every[z.at] AS c, z.free AS free))")
    return rows.withColumn("_loose", F.expr(f"CASE WHEN size(_all) > 0 THEN {loose} ELSE array() END"))


class Model(NamedTuple):
    """Trees as (splits, leaf values) by heap number: a node n has children 2n and 2n + 1. ``least``: kind number to thousandths."""

    trees: list[tuple[dict[int, tuple[str, int]], dict[int, float]]]
    least: dict[int, int]

    def probability(self, x: Callable[[str], Column]) -> Column:
        total = reduce(lambda a, b: a + b, [_walk(splits, lambda n, v=values: F.lit(v[n]), x) for splits, values in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def takes(self, x: Callable[[str], Column]) -> Column:
        """Whether a proposal's probability reaches its kind's threshold."""
        if not self.least:
            return F.lit(False)
        least = F.lit(1001)
        for kind, t in self.least.items():
            least = F.when(x("kind") == kind, t).otherwise(least)
        return F.floor(self.probability(x) * 1000) >= least


def _walk(splits: dict[int, tuple[str, int]], leaf: Callable[[int], Column], x: Callable[[str], Column], n: int = 1) -> Column:
    if n not in splits:
        return leaf(n)
    name, cut = splits[n]
    return F.when(x(name) <= cut, _walk(splits, leaf, x, 2 * n)).otherwise(_walk(splits, leaf, x, 2 * n + 1))


#: Gradients are summed as whole numbers of this many parts, so that their order doesn't matter.
_PARTS = 1 << 12


def _tree(rows: DataFrame, model: Model) -> tuple[dict, dict]:
    """The next tree: on each level every leaf takes the split that gains most, found on sums by leaf, feature and value."""
    p = model.probability(F.col)
    parts = {"g": (F.col("y") - p) * F.col("w"), "h": p * (1 - p) * F.col("w")}
    rows = rows.select(*NAMES, *[F.round(v * _PARTS).cast("decimal(38,0)").alias(k) for k, v in parts.items()])
    splits, values = {}, {1: 0.0}
    for level in range(DEPTH):
        at = _walk(splits, F.lit, F.col)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(name).alias("v")) for i, name in enumerate(NAMES)]))
        sums = rows.select(at.alias("at"), each.alias("x"), "g", "h").groupBy("at", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        by = defaultdict(list)
        for r in sums.where(F.col("at") >= 1 << level).collect():  # a row per leaf, feature and value: under 2,000
            by[r["at"], r["f"]].append((r["v"], int(r["g"]) / _PARTS, int(r["h"]) / _PARTS))
        best = {}
        for (n, f), of in sorted(by.items()):
            g, h = sum(x[1] for x in of), sum(x[2] for x in of)
            values[n], left_g, left_h = RATE * g / (h + 1), 0.0, 0.0
            for v, dg, dh in sorted(of)[:-1]:
                left_g, left_h = left_g + dg, left_h + dh
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain > best.get(n, (1e-6,))[0]:
                    best[n] = (gain, NAMES[f], v, RATE * left_g / (left_h + 1), RATE * (g - left_g) / (h - left_h + 1))
        for n, (_, name, cut, left, right) in best.items():
            splits[n], values[2 * n], values[2 * n + 1] = (name, cut), left, right
        if not best:
            break
    return splits, values


def fit(cands: DataFrame, precision: float = PRECISION) -> Model:
    """Trees and thresholds from a written table of candidates."""
    one = cands.select("_held", F.explode("_loose").alias("l")).select("_held", *[F.col(f"l.c.{n}").alias(n) for n in (*NAMES, "y")])
    combined = one.groupBy("_held", *NAMES, "y").agg(F.count("*").alias("w"))
    rows, _ = written(combined, "proposals")
    model = Model([], {})
    for _ in range(ROUNDS):
        model.trees.append(_tree(rows.where("NOT _held"), model))
    bins = rows.where("_held").groupBy("kind", F.floor(model.probability(F.col) * 1000).alias("bin")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("right"))
    seen = defaultdict(lambda: (0, 0))
    for r in bins.orderBy(F.desc("bin")).collect():  # 1,001 rows a kind at most
        n, right = seen[r["kind"]]
        n, right = seen[r["kind"]] = n + r["n"], right + r["right"]
        if n >= LEAST_HELD and right >= precision * n:
            model.least[r["kind"]] = r["bin"]
    return model


def selected(cands: DataFrame, model: Model) -> DataFrame:
    """Adds ``_added`` and ``_spans``: what the model adds, and all spans, as (start, kind, stop) by start, then kind."""
    added = F.filter("_loose", lambda l: l["free"] & model.takes(lambda n: l["c"][n]))
    cands = cands.withColumn("_added", F.transform(added, lambda l: F.struct(l["c"]["start"].alias("start"), l["c"]["kind"].alias("kind"), l["c"]["stop"].alias("stop"))))
    return cands.withColumn("_spans", F.array_sort(F.concat("_base", "_added")))


def as_text(spans: str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"], s["stop"])), ",")


def spans_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_<kind> of base spans, n_added, base_sha256, spans) of every document."""
    cands, _ = written(candidates(docs, id_col, text), "candidates")
    out = selected(cands, fit(cands))
    counts = [F.expr(f"CAST(size(filter(_base, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(id_col, *counts, F.size("_added").cast("long").alias("n_added"), F.sha2(as_text("_base"), 256).alias("base_sha256"), as_text("_spans").alias("spans"))


def redacted(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets, [EMAIL]; of overlapping ones by the first's."""
    rows = docs
    names = unused(docs.columns, "_own_id", "_own_text")
    rows = docs.withColumns({names[0]: F.col(id_col), names[1]: F.col(text)})
    hidden = {c: n for c, n in zip(docs.columns, unused([*docs.columns, *names, "_base", "_loose", "_held", "_all", "_t"], *[f"_k{i}" for i in range(len(docs.columns))]))}
    rows = rows.select(*[F.col(c).alias(n) for c, n in hidden.items()], *names)
    found = selected(candidates(rows, names[0], names[1], [*hidden.values(), names[1]]), model)
    kinds, own = ", ".join(repr(k.upper()) for k in KINDS), names[1]
    pieces = f"transform(ss, (s, i) -> CASE WHEN i = 0 THEN concat(substring({own}, 1, s.start), '[', ks[s.kind], ']') WHEN es[i - 1] <= s.start THEN concat(substring({own}, es[i - 1] + 1, s.start - es[i - 1]), '[', ks[s.kind], ']') ELSE '' END)"
    whole = f"concat(array_join({pieces}, ''), substring({own}, es[size(ss) - 1] + 1))"
    whole = let("ks", f"array({kinds})", let("ss", "_spans", let("es", running("transform(ss, s -> s.stop)", "0", lambda a, v: f"greatest({a}, {v})"), whole)))
    out = F.when(F.size("_spans") > 0, F.expr(whole)).otherwise(F.col(own))
    return found.select(*[(out if c == text else F.col(n)).alias(c) for c, n in hidden.items()])


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))
