"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from strict patterns (the base) and from looser ones.  Four labelers vote on each
candidate: its pattern and checksum, its shape, a gazetteer (mail endings, card issuers, reserved
addresses), and the words before it (up to ``CONTEXT_CHARS`` characters, not beyond the match before).  A vote is 1, 0 (abstains) or -1.  Counts of each vote
pattern are gathered from all documents; on the driver expectation-maximisation over that table
(at most 4 kinds x 3**4 votes x 12 shapes) estimates how reliable each labeler is and how likely each
pattern is a true span.  A logistic classifier of the span (kind, shape, votes) is trained on those
probabilities and decides about the looser candidates; base spans always stay.  An added span
never overlaps a base span or an added one of an earlier kind.

Offsets are in code points, ends exclusive.  Patterns are possessive, and starts inside a run that
has failed are skipped, so that no pattern recurses; places, overlaps and redaction are worked out by running sums
and maxima over a text's spans.  Time grows with the text's length, and with the spans times their logarithm.

Defined results: a null text counts as empty and has no spans; a repeated row or a null id keeps
its row; very long texts are searched whole; no rows give no rows; only the id and the text are
looked at, so other columns can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import before, ends, let, running
from ._common import documents, stage

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: The base, written so that Java's engine neither recurses nor retries inside a failed run.
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further forms, each found only where its gate is in the text.
LOOSE = {
    "email": (rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(](?:at|AT)[\])] ?{LABEL}{{1,63}}+(?: ?[\[(](?:dot|DOT)[\])] ?{LABEL}{{1,63}}+|\.{LABEL}{{1,63}}+){{1,8}}+", r"[\[(](?:at|AT)[\])]"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+|\(\.\)[0-9]{1,3}+){3}(?![0-9])", r"[\[(]\.[\])]"),
    "card": (r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])", r"3[47][0-9]{2}"),
    "phone": (r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9][ .-][0-9]{4}"),
}
#: Gazetteers.  A mail's last label; issuers' first digits; private or reserved first parts; area codes that are not assigned.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|mx|br|ar)$",
    "ip": r"^(?!0|127|22[4-9]|2[34][0-9]|25[0-5])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4))",
    "phone": r"^[^0-9]*(?:1[^0-9]*[2-9]|[2-9])",
}
#: Words that speak for a kind within the characters before a span, and words that speak against it.
CONTEXT_FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|from)",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta|master)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|dial)",
}
CONTEXT_AGAINST = {
    "email": r"(?i)(?:example of|git@|ssh)",
    "ip": r"(?i)(?:version|release|section|chapter|\bv)\W*$",
    "card": r"(?i)(?:isbn|serial|order|invoice|hash|id)\W*$",
    "phone": r"(?i)(?:isbn|version|lines?|pages?|order)\W*$",
}
CONTEXT_CHARS = 40
LABELERS = 4
BLOCK_CHARS = 4096
SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def _placed(matches: Column, pieces: Column) -> Column:
    """Spans of matches that alternate with the pieces between them: start, end, text, what stands before and right after."""
    n = F.size(matches)
    parts = F.arrays_zip(ends(matches, pieces).alias("e"), matches.alias("m"), F.slice(pieces, F.lit(1), n).alias("p"), F.slice(pieces, F.lit(2), n).alias("q"), F.slice(matches, F.lit(2), n).alias("r"))

    def span(x: Column) -> Column:
        after = F.when(F.length(x["q"]) > 0, F.left(x["q"], F.lit(1))).otherwise(F.coalesce(F.left(x["r"], F.lit(1)), F.lit("")))
        return F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(CONTEXT_CHARS)).alias("b"), after.alias("a"))

    return F.transform(parts, span)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _valid(kind, x["m"])


def _clear(loose: Column, taken: list[Column]) -> Column:
    """The spans of ``loose`` that overlap none of the spans in ``taken``, by running ends and starts over all of them in order."""

    def own(flag: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(flag).alias("o"), x["e"].alias("e"), x.alias("x"))

    every = F.array_sort(F.concat(*[F.transform(o, own(0)) for o in taken], F.transform(loose, own(1))))

    def free(a: Column) -> Column:
        reach = running(F.transform(a, lambda x: F.when(x["o"] == 0, x["e"]).otherwise(-1)), lambda x, y: F.greatest(x, y), F.lit(-1))
        far = F.lit(2**31 - 1)
        following = F.reverse(running(F.transform(F.reverse(a), lambda x: F.when(x["o"] == 0, x["s"]).otherwise(far)), lambda x, y: F.least(x, y), far))
        met = F.arrays_zip(a.alias("k"), reach.alias("w"), following.alias("f"))
        return F.transform(F.filter(met, lambda z: (z["k"]["o"] == 1) & (z["w"] <= z["k"]["s"]) & (z["f"] >= z["k"]["e"])), lambda z: z["k"]["x"])

    return let(every, free)


def _voted(kind: int, strict: bool, spans: Column) -> Column:
    """The candidates with their votes v1..v4 and their shape."""
    name = KINDS[kind]

    def one(x: Column) -> Column:
        m, before = x["m"], x["b"]
        d = F.length(_digits(m))
        plain = {"email": m, "ip": m, "card": _digits(m), "phone": m}[name]
        shape_ok = {"email": F.length(m) <= 80, "ip": F.length(m).between(7, 24), "card": d >= 15, "phone": d.between(10, 13)}[name]
        loose_ok = {"email": F.lit(0), "ip": F.lit(0), "card": F.when(_luhn(_digits(m)), 1).otherwise(-1), "phone": F.lit(0)}[name]
        return F.struct(
            F.lit(kind).alias("k"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            (F.lit(1) if strict else loose_ok).cast("int").alias("v1"),
            F.when(shape_ok, 1).otherwise(-1).alias("v2"),
            F.when(plain.rlike(GAZETTEER[name]), 1).otherwise(-1).alias("v3"),
            F.when(before.rlike(CONTEXT_AGAINST[name]), -1).when(before.rlike(CONTEXT_FOR[name]), 1).otherwise(0).alias("v4"),
            (F.least(F.floor(F.length(m) / 8), F.lit(5)) * 2 + F.when(x["a"].rlike(r"[\p{L}0-9]"), 1).otherwise(0)).cast("int").alias("shape"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, loose): arrays of voted candidates, in order of kind and start; ``keep`` columns come back with the prefix ``in_``."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[F.col(k).alias(f"in_{k}") for k in keep])
    t = F.col("t")
    out = out.withColumn("digit", t.rlike("[0-9]"))
    gates = {"email": t.contains("@"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit") & t.contains("+")}
    none = F.array().cast("array<string>")
    for k, (rx, gate) in LOOSE.items():
        gates[f"l_{k}"] = (t.rlike(gate)) if k == "email" else F.col("digit") & t.rlike(gate)
    every = {**STRICT, **{f"l_{k}": rx for k, (rx, _) in LOOSE.items()}}
    out = out.withColumns({f"g_{k}": gates[k] for k in every})
    out = out.withColumns({f"m_{k}": F.when(F.col(f"g_{k}"), F.regexp_extract_all(t, F.lit(rx), F.lit(0))).otherwise(none) for k, rx in every.items()})
    out = out.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(t, rx, -1)).otherwise(none) for k, rx in every.items()})
    spans = {}
    for k in every:
        found = F.when(F.size(f"m_{k}") > 0, _placed(F.col(f"m_{k}"), F.col(f"p_{k}"))).otherwise(F.array().cast(f"array<{SPAN}>"))
        spans[k] = found if k.startswith("l_") else F.filter(found, _checker(k))
    out = out.withColumns({f"s_{k}": v for k, v in spans.items()})
    for i, k in enumerate(KINDS):
        free = _clear(F.col(f"s_l_{k}"), [F.col(f"s_{j}") for j in KINDS] + [F.col(f"s_l_{j}") for j in KINDS[:i]])
        out = out.withColumn(f"s_l_{k}", F.when(F.size(f"s_l_{k}") > 0, free).otherwise(F.col(f"s_l_{k}")))
    base = F.concat(*[_voted(i, True, F.col(f"s_{k}")) for i, k in enumerate(KINDS)])
    loose = F.concat(*[_voted(i, False, F.col(f"s_l_{k}")) for i, k in enumerate(KINDS)])
    return out.select("id", *(["t"] if keep else []), base.alias("base"), loose.alias("loose"), *[f"in_{k}" for k in keep])


def vote_table(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """((kind, shape, v1..v4), count) over all documents: a table whose size has a fixed bound."""
    rows = found.select(F.explode(F.concat("base", "loose")).alias("c")).groupBy("c.k", "c.shape", "c.v1", "c.v2", "c.v3", "c.v4").count().collect()
    return sorted(((r["k"], r["shape"], r["v1"], r["v2"], r["v3"], r["v4"]), r["count"]) for r in rows)


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation over the vote table.

    Returns the probability that a row of the table is a true span, and each labeler's
    P(vote | true), P(vote | false).  Dirichlet priors that hold labelers to be right more
    often than not keep the two classes in place and empty tables defined.
    """
    prior = {True: {1: 6.0, 0: 3.0, -1: 1.0}, False: {1: 1.0, 0: 3.0, -1: 6.0}}
    kinds = sorted({key[0] for key, _ in table})
    share = {k: 0.5 for k in kinds}
    says = {(k, j, y): {v: c / 10 for v, c in prior[y].items()} for k in kinds for j in range(LABELERS) for y in (True, False)}
    belief: dict = {}
    for _ in range(rounds):
        for key, _n in table:
            k, votes = key[0], key[2:]
            log = {y: math.log(share[k] if y else 1 - share[k]) + sum(math.log(says[k, j, y][v]) for j, v in enumerate(votes)) for y in (True, False)}
            belief[key] = 1 / (1 + math.exp(min(700.0, log[False] - log[True])))
        for k in kinds:
            mine = [(key, n) for key, n in table if key[0] == k]
            total = sum(n for _, n in mine)
            share[k] = (1 + sum(n * belief[key] for key, n in mine)) / (2 + total)
            for j in range(LABELERS):
                for y in (True, False):
                    seen = dict(prior[y])
                    for key, n in mine:
                        seen[key[2 + j]] += n * (belief[key] if y else 1 - belief[key])
                    whole = sum(seen.values())
                    says[k, j, y] = {v: c / whole for v, c in seen.items()}
    return belief, says


def train(table: list[tuple[tuple[int, ...], int]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[tuple, float]:
    """A logistic classifier of spans, fitted to the beliefs by gradient steps; weights by feature."""
    belief, _ = reliabilities(table)
    total = sum(n for _, n in table) or 1
    weights: dict[tuple, float] = {}
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        for key, n in table:
            names = features(key)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in names)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + n / total * (belief[key] - p)
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * (1 - rate * ridge) + rate * g
    return weights


def features(key: tuple[int, ...]) -> list[tuple]:
    return [("kind", key[0]), ("shape", key[0], key[1]), *[("vote", j, v) for j, v in enumerate(key[2:])]]


def _accepted(weights: dict[tuple, float], loose: Column, at_least: float) -> Column:
    """The looser candidates that the classifier accepts."""
    limit = math.log(at_least / (1 - at_least))
    flat = {"|".join(map(str, f)): round(w, 12) for f, w in weights.items()}
    if not flat:
        return F.filter(loose, lambda x: F.lit(False))
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in flat]), F.array(*[F.lit(v) for v in flat.values()]))

    def weight(*parts: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(0.0))

    def score(x: Column) -> Column:
        votes = sum((weight(F.lit("vote"), F.lit(j), x[f"v{j + 1}"]) for j in range(LABELERS)), F.lit(0.0))
        return weight(F.lit("kind"), x["k"]) + weight(F.lit("shape"), x["k"], x["shape"]) + votes

    return F.when(F.size(loose) > 0, F.filter(loose, lambda x: score(x) >= limit)).otherwise(loose)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, ``base`` and ``added`` spans as arrays of (k, s, e), in order of kind and start."""
    found = stage(candidates(docs, id_col, text_col, keep), "pii")
    weights = train(vote_table(found))
    short = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    return found.select("id", *(["t"] if keep else []), F.transform("base", short).alias("base"), F.transform(_accepted(weights, F.col("loose"), at_least), short).alias("added"), *[f"in_{k}" for k in keep])


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span that begins behind all earlier ones replaced by its tag.

    Texts are cut from blocks, as Spark counts characters from a string's beginning.
    """
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK_CHARS).cast("int")), lambda i: F.substring(text, i * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))

    def between(cut: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK_CHARS).cast("int")
        joined = F.array_join(F.slice(cut, first + 1, F.floor(b / BLOCK_CHARS).cast("int") - first + 1), "")
        return F.substring(joined, a - first * BLOCK_CHARS + 1, F.greatest(F.lit(0), b - a))

    def whole(cut: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
        reached = let(ordered, lambda o: F.zip_with(o, before(running(F.transform(o, lambda x: x["e"]), lambda x, y: F.greatest(x, y), F.lit(0)), F.lit(0)), lambda x, at: x.withField("at", at)))
        parts = F.transform(F.filter(reached, lambda x: x["s"] >= x["at"]), lambda x: F.concat(between(cut, x["at"], x["s"]), F.element_at(tags, x["k"] + 1)))
        return F.concat(F.array_join(parts, ""), between(cut, F.array_max(F.transform(spans, lambda x: x["e"])), F.length(text)))

    return let(blocks, whole)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    spans = find_spans(docs, keep=("text", "lang", "source"))
    every = F.concat("base", "added")
    text = F.when(F.size(every) > 0, _redacted(F.col("t"), every)).otherwise(F.col("in_text"))
    return spans.select(F.col("id").alias("doc_id"), text.alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source")).withColumn("n_chars", F.length("text").cast("long"))


def _of_kind(kind: int):
    return lambda x: x["k"] == kind


def op6_query(spark, sf_dir: str) -> DataFrame:
    spans = find_spans(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"))
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(both).alias("spans"))
