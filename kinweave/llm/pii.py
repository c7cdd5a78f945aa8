"""Personal data by candidate generation and boosted trees, in DataFrame functions only.

Generators propose spans: four strict formats (the base, always kept) and four loose ones of high
recall, which may overlap. A pattern's matches and the gaps between them give every place in code
points. Each candidate gets discrete features of its format (separators, length) and context (neighbours,
words before it), so that all candidates of a corpus aggregate to a bounded number of cells (one partially
aggregated count).

What a candidate says is checked by rules that are no features: check digits and issuers, address
ranges, country codes, top-level domains. Boosted trees learn from the candidates of one half of the
documents which formats and contexts hold sound contents; on the other half a threshold is calibrated
for each kind, so that what scores as high is sound at ``PRECISION``, less what is sound by chance.
The trees become a SQL expression. A loose candidate is added if it is sound, scores above its kind's
threshold, and does not rest on plain separators with white space unless a word before it announces it.
Texts are never shuffled and nothing leaves the JVM but the cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: The strict formats. Where a run of the same class would be tried again from each of
#: its places, matches may begin only at the run's start or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[(\[{] ?at ?[)\]}] ?| ?@ ?)", r"(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| ?\. ?)"
#: High-recall generators.
LOOSE = {
    "email": rf"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}+",
    "ip": rf"(?i)(?:\G|(?<![0-9]))[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20./_-]{0,2}+[0-9]){13,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+ ?|00)[0-9][\x20().0-9/-]{7,24}[0-9]",
}
#: Cheap tests without which a format cannot match: characters of which a text must hold one.
GUARD = {"base_email": ("@",), "base_phone": ("+",), "loose_email": ("@", "at)", "at]", "at}", "AT)", "AT]", "AT}", "At)", "At]", "At}", "at )", "at ]", "at }")}
#: Top-level domains in common use, and those reserved for examples.
DOMAINS = (
    "com net org edu gov mil int info biz name pro mobi io ai app dev co me tv us uk de fr es it nl eu in cn jp ru br ca au ch at be se no fi pl dk pt cz ie"
    " nz mx ar cl pe za kr tr il gr hu ro bg hr sk si lt lv ee ua kz id my sg th vn ph hk tw ae sa eg ng ke example test"
).split()
#: A kind's added spans must be sound at this rate among the candidates that score as high, besides
#: those that are so by chance: one random number of ten has a right check digit, and so on.
PRECISION = 0.95
CHANCE = (0.05, 0.05, 0.1, 0.1)
ROUNDS, DEPTH, STEP = 24, 3, 0.4
FEATURES = {"kind": 4, "form": 4, "before": 5, "after": 5, "length": 6, "cue": 2}
SPAN = "array<struct<pos:int,end:int,text:string,left:string,right:string>>"
PLACE = "array<struct<pos:int,kind:int,end:int,base:boolean>>"
#: Items that a fold gathers before it joins them to what it has.
FOLD = 256


def _folded(items: str, start: Column, kind: str, step) -> Column:
    """The array (of type ``kind``) that a left fold over the column ``items`` gathers: ``step(state, item)``
    is the next state and an array to add. Adding to an array copies it, so items are gathered in
    blocks; a text of very many spans costs its length times FOLD, not its square."""
    nothing = F.array().cast(kind)

    def one(acc, x):
        state, more = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["found"], more).alias("found"))

    def block(acc, b):
        joined = lambda a: F.struct(a["at"].alias("at"), F.concat(acc["found"], a["found"]).alias("found"))
        return F.aggregate(F.slice(items, b * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), nothing.alias("found")), one, joined)

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / FOLD).cast("int"))
    return F.aggregate(blocks, F.struct(start.alias("at"), nothing.alias("found")), block)["found"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """The base's own rules."""
    d = F.length(_digits(x))
    if kind == "ip":
        parts = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
        return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return d.between(14, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return d.between(10, 15)
    return F.lit(True)


def _sound(kind: str, x: Column) -> Column:
    """Whether what a candidate says may be an address, a number in use and so on: the labels."""
    digits = _digits(x)
    if kind == "ip":  # octets as they are written, a first one of a host, and not a version number
        return _valid(kind, x) & ~x.rlike(r"(?<![0-9])0[0-9]") & ~x.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])(?![0-9])") & x.rlike("[0-9]{2}")
    if kind == "card":
        return _valid(kind, x) & digits.rlike("^[3-6]") & ~digits.rlike(r"^(.)\1+$")
    if kind == "phone":  # a country code, and an area code where the plan asks for one
        return _valid(kind, x) & digits.rlike("^(?:00)?(?:[2-9]|1(?:[2-9][0-9]{2}){2}[0-9]{4}$)")
    return F.lower(F.regexp_extract(x, "([A-Za-z]+)$", 1)).isin(*DOMAINS)


def _form(kind: str, x: Column) -> Column:
    """0 plain, 1 separators in brackets, 2 some of them, 3 white space beside plain separators."""
    if kind in ("card", "phone"):
        kinds = F.length(F.regexp_replace(F.regexp_replace(x, "[0-9+()]", ""), r"(.)\1*(?=.*\1)", ""))
        return F.least(kinds, F.lit(2)) + F.when(x.rlike("[^0-9]{3}"), 1).otherwise(0)
    marked, plain = x.rlike(r"[(\[{]"), x.rlike(r"(?<![(\[{] ?)[@.](?! ?[)\]}])")
    spaced = x.rlike(r"\x20[@.](?! ?[)\]}])|(?<![(\[{] ?)[@.]\x20")
    return F.when(spaced, 3).when(marked & plain, 2).when(marked, 1).otherwise(0)


def _sort(c: Column) -> Column:
    """Class of a context character: 0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)


def _matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds column ``name``: the pattern's leftmost non-overlapping matches with places and context."""
    text = F.col("_text")
    may = reduce(lambda x, y: x | y, [F.contains(text, F.lit(g)) for g in GUARD[name]]) if name in GUARD else F.col("_digit")
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_i", F.when(F.col("_g").isNotNull(), F.sequence(F.lit(1), F.size("_m"))))

    def step(at, i):
        gap, hit = F.element_at("_g", i), F.element_at("_m", i)
        pos = at + F.length(gap)
        end = pos + F.length(hit)
        one = F.struct(pos.alias("pos"), end.alias("end"), hit.alias("text"), F.right(gap, F.lit(16)).alias("left"), F.substring(F.element_at("_g", i + 1), 1, 1).alias("right"))
        return end, F.array(one)

    found = F.when(F.col("_i").isNotNull(), _folded("_i", F.lit(0), SPAN, step))
    return df.withColumn(name, F.coalesce(found, F.array().cast(SPAN))).drop("_m", "_g", "_i")


def _described(kind: str, base: bool, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["pos"].alias("pos"), s["end"].alias("end"), F.lit(base).alias("base"),
            _valid(kind, s["text"]).alias("valid"), F.coalesce(_sound(kind, s["text"]), F.lit(False)).alias("sound"),
            _form(kind, s["text"]).cast("int").alias("form"),
            _sort(F.right(s["left"], F.lit(1))).alias("before"), _sort(s["right"]).alias("after"),
            F.least(F.floor((s["end"] - s["pos"]) / 6), F.lit(5)).cast("int").alias("length"),
            s["left"].rlike(r"(?i)(mail|contact|write|reach|phone|tel|call|card|visa|pay|host|addr|server|\bip\b|from|number|no\.)").cast("int").alias("cue"),
        ),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (columns text and row) with _spans: every base match that its rule accepts, and every
    loose candidate, each with its features; and half, a bit of the text's hash."""
    df = rows.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    parts = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind in KINDS:
            name = f"{'base' if base else 'loose'}_{kind}"
            df = _matches(df, name, patterns[kind])
            own = _described(kind, base, F.col(name))
            parts.append(F.filter(own, lambda s: s["valid"]) if base else own)
    return df.select("row", "text", F.pmod(F.xxhash64("_text"), F.lit(2)).alias("half"), F.concat(*parts).alias("_spans"))


# ---------------------------------------------------------------- boosted trees over cells


def _grow(cells, grad, hess, depth):
    """A tree as nested tuples (feature, value, left, right) or a leaf's number; splits are <= value."""
    g, h = sum(grad), sum(hess)
    leaf = STEP * g / (h + 1.0)
    if depth == 0:
        return leaf
    best = (1e-6, None)
    for f, size in FEATURES.items():
        for v in range(size - 1):
            left = [i for i, c in enumerate(cells) if c[f] <= v]
            if not left or len(left) == len(cells):
                continue
            gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    sides = []
    for ok in (True, False):
        at = [i for i, c in enumerate(cells) if (c[f] <= v) == ok]
        sides.append(_grow([cells[i] for i in at], [grad[i] for i in at], [hess[i] for i in at], depth - 1))
    return f, v, *sides


def _leaf(tree, c):
    while isinstance(tree, tuple):
        tree = tree[2] if c[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree, s: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, yes, no = tree
    return F.when(s[f] <= v, _sql(yes, s)).otherwise(_sql(no, s))


def fit(found: DataFrame) -> tuple[list, list[float]]:
    """Trees and each kind's threshold from the candidates of a corpus (columns _spans, half).

    All candidates count; they come as at most 2*4*4*5*5*6*2 = 9,600 cells. Texts that hash to an
    even number are learned from, the others calibrate the thresholds."""
    # an outer generator: below an inner one the optimizer puts a test of the array's size, for which it
    # computes the spans again, every step as often as the next ones name it
    span = found.select("half", F.inline_outer("_spans")).where("kind is not null")
    rows = span.groupBy("half", *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("sound").cast("long")).alias("yes")).orderBy("half", *FEATURES).collect()
    cells = [r.asDict() for r in rows if r["half"] == 0]
    trees, score = [], [0.0] * len(cells)
    for _ in range(ROUNDS if cells else 0):
        p = [1 / (1 + math.exp(-z)) for z in score]
        # counts are damped, so that one frequent cell does not decide every split
        w = [math.sqrt(c["n"]) / c["n"] for c in cells]
        tree = _grow(cells, [u * (c["yes"] - c["n"] * x) for u, c, x in zip(w, cells, p)], [u * c["n"] * x * (1 - x) for u, c, x in zip(w, cells, p)], DEPTH)
        trees.append(tree)
        score = [z + _leaf(tree, c) for z, c in zip(score, cells)]
    held = [(sum((_leaf(t, c) for t in trees), 0.0), c) for c in (r.asDict() for r in rows if r["half"] == 1)]
    thresholds = []
    for k, chance in enumerate(CHANCE):
        best, n, yes = math.inf, 0, 0
        for z, c in sorted(((z, c) for z, c in held if c["kind"] == k), key=lambda x: -x[0]):
            n, yes = n + c["n"], yes + c["yes"]
            # one more that is wrong is added to what was seen
            if yes / (n + 1) - chance >= PRECISION * (1 - chance):
                best = z
        thresholds.append(best if best < math.inf else 1e9)
    return trees, [t - 1e-9 for t in thresholds]


def selected(found: DataFrame, model: tuple[list, list[float]]) -> DataFrame:
    """Replaces _spans by the base spans and the added ones (sound, scored above the kind's threshold,
    announced if spaced, not overlapping a base span or a longer added one), ordered by place and kind."""
    trees, thresholds = model
    limit = F.array(*[F.lit(float(t)) for t in thresholds])

    def chosen(s):
        score = reduce(lambda a, b: a + b, [_sql(t, s) for t in trees], F.lit(0.0))
        return ~s["base"] & s["sound"] & ((s["form"] < 3) | (s["cue"] == 1)) & (score >= F.element_at(limit, s["kind"] + 1))

    out = found.withColumn("_base", F.filter("_spans", lambda s: s["base"]))
    out = out.withColumn("_more", F.filter("_spans", chosen))
    # base and added spans by place, the base first and longer added ones before shorter
    place = lambda added: lambda s: F.struct(s["pos"].alias("pos"), F.lit(added).alias("added"), (-s["end"]).alias("end"), s["kind"].alias("kind"))
    both = F.concat(F.transform("_base", place(0)), F.transform("_more", place(1)))
    out = out.withColumn("_back", F.when(F.size("_more") > 0, F.reverse(F.array_sort(both))))
    row = "array<struct<pos:int,added:int,end:int,kind:int>>"

    def before_base(at, s):
        """Backwards: drops added spans that reach into a base span that begins later."""
        base = s["added"] == 0
        return F.when(base, F.least(at, s["pos"])).otherwise(at), F.when(base | (-s["end"] <= at), F.array(s)).otherwise(F.array().cast(row))

    def after_any(at, s):
        """Forwards: drops added spans that begin inside a base span or an added one that is kept."""
        base, free = s["added"] == 0, s["pos"] >= at
        own = F.array(F.struct(s["pos"].alias("pos"), s["kind"].alias("kind"), (-s["end"]).alias("end"), F.lit(False).alias("base")))
        return F.when(base | free, F.greatest(at, -s["end"])).otherwise(at), F.when(~base & free, own).otherwise(F.array().cast(PLACE))

    out = out.withColumn("_forth", F.when(F.col("_back").isNotNull(), F.reverse(_folded("_back", F.lit(2**31 - 1), row, before_base))))
    kept = F.coalesce(F.when(F.col("_forth").isNotNull(), _folded("_forth", F.lit(0), PLACE, after_any)), F.array().cast(PLACE))
    base = F.transform("_base", lambda s: F.struct(s["pos"], s["kind"], s["end"], s["base"]))
    return out.withColumn("_spans", F.array_sort(F.concat(base, kept))).drop("_base", "_more", "_back", "_forth")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["pos"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256 (of the listed base spans), spans (all of them, kind:start:end, ordered by
    start and kind) and n_spans. Null and empty texts have none; an empty table gives an empty result; equal
    rows give equal results. Added spans depend on the whole table, base spans on their text alone.
    """
    found = cut(candidates(docs.select(F.col("doc_id").alias("row"), "text")).drop("text"))
    s = selected(found, fit(found))
    own = F.filter("_spans", lambda x: x["base"])
    of = lambda i: lambda x: x["base"] & (x["kind"] == i)
    counts = [F.size(F.filter("_spans", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return s.select(F.col("row").alias("doc_id"), *counts, F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (column text and any others) with each found span of its text replaced by its kind in angle
    brackets; spans that overlap are replaced together, named after the first. A null text stays null,
    an empty one empty; equal texts change alike; an empty table gives an empty result."""
    found = candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    s = selected(found, fit(found))
    name = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col("text")

    def step(at, x):
        piece = F.when(x["pos"] < at, F.lit("")).otherwise(F.concat(F.substring(text, at + 1, x["pos"] - at), F.element_at(name, x["kind"] + 1)))
        return F.greatest(at, x["end"]), F.array(piece)

    last = F.array_max(F.transform("_spans", lambda x: x["end"]))
    done = F.concat(F.array_join(_folded("_spans", F.lit(0), "array<string>", step), ""), F.substring(text, last + 1, F.length(text)))
    changed = F.when(F.size("_spans") > 0, done).otherwise(text)
    return s.select(*[(changed if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
