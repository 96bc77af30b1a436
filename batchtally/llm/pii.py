r"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Fixed patterns give the base spans. Beside them, generators of high recall
propose further spans, which may overlap: masked mail addresses, runs of digits
with any separators, masked or hexadecimal host addresses. A boosted ensemble of
small trees scores each proposal from its format and from the words before it.
Per kind a threshold is calibrated on held-out rows, and proposals beyond it join
the base spans where they touch none of them; they may overlap each other.

The trees are grown with grouped sums over labelled examples, which are made by
rule from the patterns in ``EXAMPLES`` (bound: ``EXAMPLE_ROWS`` rows); fitted trees are a column
expression, so a document is scored inside its own row without a shuffle.

Positions come from lengths of the pieces between matches. All repeated parts of
the patterns are possessive, so a text of any length is matched without recursion.

Defined results
* null text counts as empty: no spans;
* rows are judged by themselves, so repeated rows get equal results;
* spans are code points, end exclusive, by start, then kind as listed, then end;
* an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchtally.llm.common import documents, let, n_below, prefix_max, prefix_sums, required, text_of
from batchtally.plans.storage import write_and_read

KINDS = ["email", "ip", "card", "phone"]

# A match may start where no character of its first class stands before it, or right after the last match.
_RUN = lambda chars: rf"(?:\G|(?<![{chars}]))"
BASE = {
    "email": _RUN("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
GENERATORS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++",
    "digits": r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
    "host": r"(?<![A-Za-z0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+|(?<![A-Za-z0-9:])[0-9a-f]{1,4}+(?::[0-9a-f]{0,4}+){4,7}+",
}
#: Kinds that a generator's spans are proposed for.
PROPOSED = {"mail": ["email"], "digits": ["card", "phone"], "host": ["ip"]}

CUES = {
    "cue_phone": r"(?i)\b(?:tel|phone|call|mobile|fax|tél|telefon|llame|anruf)",
    "cue_card": r"(?i)\b(?:card|visa|mastercard|amex|carte|karte|tarjeta)",
    "cue_mail": r"(?i)\b(?:mail|write|contact|correo|écrire|reach)",
    "cue_host": r"(?i)\b(?:ip|host|server|address|from|addr)\b",
    "cue_other": r"(?i)(?:isbn|order|invoice|version|date|serial|total|id\b|no\.|[#$€£])\W{0,2}$",
}

#: Labelled examples: kind or nothing, pattern. A 9 stands for any digit. Fixed values.
EXAMPLES = [
    ("phone", "please call 999-999-9999"),
    ("phone", "phone (999) 999-9999"),
    ("phone", "tel 0999 999 9999"),
    ("phone", "mobile 999.999.9999"),
    ("phone", "fax (999)999-9999"),
    ("phone", "reach us, phone 99 99 99 99 99"),
    ("card", "card 9999.9999.9999.9999"),
    ("card", "visa 9999/9999/9999/9999"),
    ("card", "card number 9999  9999  9999  9999"),
    ("email", "write to anne9 (at) mail9.example.com"),
    ("email", "mail bob99 [at] host9 [dot] org"),
    ("email", "contact c.smith[at]site9.example"),
    ("ip", "server 99[.]99[.]9[.]99"),
    ("ip", "from host 9999:99a9:9:b9:99:9999"),
    ("", "isbn 999-9-99-999999-9"),
    ("", "order 9999999999"),
    ("", "date 2099-99-99 99.99"),
    ("", "on 99/99/2099 99"),
    ("", "serial 9999-9999-9999"),
    ("", "total $9999999.99"),
    ("", "id 99999999999999999999"),
    ("", "version 9.99.999.9999"),
    ("", "pages 999-9999999"),
    ("", "the sum of 9999999 things"),
    ("", "between 9999 9999 9999 9999 9999 9999 units"),
    ("", "meet (at) 9.99"),
    ("", "meet [at] noon.then"),
    ("", "ratio 99:9:9:99:9"),
    ("phone", "Telefon 0999 9999999"),
    ("phone", "Anruf unter 099/99999999"),
    ("phone", "Rufnummer, Telefon (0999) 999 999"),
    ("phone", "tél. 09 99 99 99 99"),
    ("phone", "téléphone 09.99.99.99.99"),
    ("phone", "llame al 999 999 999"),
    ("phone", "teléfono móvil 999-99-99-99"),
    ("card", "Karte 9999  9999  9999  9999"),
    ("card", "Kreditkarte 9999/9999/9999/9999"),
    ("card", "carte bancaire 9999.9999.9999.9999"),
    ("card", "tarjeta 9999/9999/9999/9999"),
    ("email", "schreiben an anna9 (at) post9.example.de"),
    ("email", "écrire à jean99 [at] site9 [dot] fr"),
    ("email", "correo luis.9 (at) casa9.example"),
    ("ip", "adresse 99[.]9[.]99[.]999"),
    ("ip", "servidor 9999:9:99a9:b9:9:99"),
    ("ip", "Rechner 999[.]99[.]9[.]9"),
    ("", "am 99.99.2099 99"),
    ("", "Rechnung 99999999999"),
    ("", "Seriennummer 9999-9999-9999"),
    ("", "le 99/99/2099 99"),
    ("", "facture 9999 999 999"),
    ("", "el 99-99-2099 99"),
    ("", "pedido 999999999999"),
    ("", "verset 99:9:99:9:9"),
    ("", "entre 9999 9999 9999 9999 9999 9999 unidades"),
]
EXAMPLE_ROWS = 4200
ROUNDS, RATE, LEAVES = 8, 0.5, 1.0
PRECISION = 0.95

CUTS = {
    "kind": [0.5, 1.5, 2.5],
    "digits": [7.5, 9.5, 10.5, 11.5, 13.5, 15.5, 17.5],
    "others": [0.5, 1.5, 2.5, 3.5, 4.5],
    "plus": [0.5],
    "bracket": [0.5],
    "dots": [0.5, 1.5, 2.5],
    "longest": [3.5, 4.5, 6.5, 9.5],
    "dated": [0.5],
    "joined": [0.5],
    **{cue: [0.5] for cue in CUES},
}


def found(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (s, e, piece, before, after)."""

    def spans(parts: Column, hits: Column) -> Column:
        steps = F.transform(hits, lambda h, i: (F.char_length(F.get(parts, i)) + F.char_length(h)).cast("bigint"))
        return let(
            prefix_sums(steps),
            lambda ends: F.transform(
                hits,
                lambda h, i: F.struct(
                    (F.get(ends, i) - F.char_length(h)).alias("s"),
                    F.get(ends, i).alias("e"),
                    h.alias("piece"),
                    F.right(F.get(parts, i), F.lit(24)).alias("before"),
                    F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    matched = let(
        F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: spans(parts, hits))
    )
    none = F.array().cast("array<struct<s:bigint,e:bigint,piece:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), matched).otherwise(none)


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _valid(kind: str, piece: Column) -> Column:
    n = F.char_length(_digits(piece))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return piece.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return n.between(12, 19) & F.coalesce(F.call_function("luhn_check", _digits(piece)), F.lit(False))
    return n.between(9, 15)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e): the base spans, by start, then kind."""

    def of(k: int) -> Column:
        good = F.filter(found(text, BASE[KINDS[k]]), lambda x: _valid(KINDS[k], x["piece"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.sort_array(F.concat(*[of(k) for k in range(len(KINDS))]))


def _features(x: Column, kind: int) -> dict[str, Column]:
    piece, before = x["piece"], x["before"]
    number = lambda c: c.cast("double")
    return {
        "kind": F.lit(float(kind)),
        "digits": number(F.char_length(_digits(piece))),
        "others": number(F.char_length(F.regexp_replace(piece, "[0-9]", ""))),
        "plus": number(piece.startswith("+")),
        "bracket": number(piece.rlike(r"[(\[]")),
        "dots": number(F.char_length(F.regexp_replace(piece, r"[^.]", ""))),
        "longest": number(F.array_max(F.transform(F.split(piece, "[^0-9]+"), F.char_length))),
        "dated": number(piece.rlike(r"^(?:(?:19|20)[0-9]{2}[-/. ]|[0-9]{1,2}/[0-9]{1,2}/)")),
        "joined": number(x["after"].rlike(r"[A-Za-z0-9:/-]")),
        **{cue: number(before.rlike(pattern)) for cue, pattern in CUES.items()},
    }


def proposals(text: Column) -> Column:
    """Array of (s, k, e, features...): what the generators propose, each for every kind it may be."""

    def of(generator: str, k: int) -> Column:
        def row(x: Column) -> Column:
            named = [v.alias(f) for f, v in _features(x, k).items()]
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), *named)

        return F.transform(found(text, GENERATORS[generator]), row)

    return F.concat(*[of(g, KINDS.index(kind)) for g, kinds in PROPOSED.items() for kind in kinds])


def held_patterns() -> list[bool]:
    """For every pattern of ``EXAMPLES`` whether it is held out: every third of its kind."""
    seen: dict[str, int] = {}
    out = []
    for kind, _ in EXAMPLES:
        seen[kind] = seen.get(kind, 0) + 1
        out.append(seen[kind] % 3 == 0)
    return out


def examples(spark: SparkSession, rows: int = EXAMPLE_ROWS) -> DataFrame:
    """Labelled proposals: kind index, features, label, held-out flag.

    Whole patterns are held out, every third of a kind, so thresholds are
    calibrated on formats that the trees have not seen.
    """
    patterns = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("p"), F.lit(h).alias("held")) for (kind, p), h in zip(EXAMPLES, held_patterns())])
    drawn = spark.range(rows).select("id", F.get(patterns, (F.col("id") % len(EXAMPLES)).cast("int")).alias("x"))
    digit = lambda c, i: F.when(c == "9", F.pmod(F.xxhash64("id", i), F.lit(10)).cast("string")).otherwise(c)
    text = F.array_join(F.transform(F.split("x.p", ""), digit), "")
    spans = drawn.select("x.held", "x.kind", F.explode(proposals(text)).alias("c"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return spans.select(
        "c.*",
        (F.get(kinds, F.col("c.k")) == F.col("kind")).cast("double").alias("label"),
        "held",
    )


def _tree(spec: dict, at: Column | None = None) -> Column:
    value = lambda name: F.col(name) if at is None else at[name]
    if "leaf" in spec:
        return F.lit(float(spec["leaf"]))
    return F.when(value(spec["f"]) <= spec["c"], _tree(spec["lo"], at)).otherwise(_tree(spec["hi"], at))


def _logit(trees: list[dict], at: Column | None = None) -> Column:
    out = F.lit(0.0)
    for t in trees:
        out = out + _tree(t, at)
    return out


def fit(rows: DataFrame) -> list[dict]:
    """Trees of two levels, grown one after the other on gradients of the log loss.

    Each level is one grouped sum over (node, feature, cut); only those sums
    reach the driver.
    """
    options = F.array(
        *[
            F.struct(F.lit(f).alias("f"), F.lit(float(c)).alias("c"), (F.col(f) <= c).alias("lo"))
            for f, cuts in CUTS.items()
            for c in cuts
        ]
    )
    trees: list[dict] = []

    def best(node: Column, g: Column, h: Column) -> dict:
        long = rows.select(node.alias("node"), g.alias("g"), h.alias("h"), F.explode(options).alias("o"))
        low = lambda x: F.sum(F.when(F.col("o.lo"), F.col(x)).otherwise(0.0))
        sums = long.groupBy("node", "o.f", "o.c").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), low("g").alias("gl"), low("h").alias("hl"))
        chosen: dict = {}
        for r in sorted(sums.collect(), key=lambda r: (r["node"], r["f"], r["c"])):
            gr, hr = r["g"] - r["gl"], r["h"] - r["hl"]
            score = lambda a, b: a * a / (b + LEAVES)
            gain = score(r["gl"], r["hl"]) + score(gr, hr) - score(r["g"], r["h"])
            if gain > chosen.get(r["node"], {"gain": -1.0})["gain"] + 1e-9:
                leaf = lambda a, b: {"leaf": RATE * a / (b + LEAVES)}
                chosen[r["node"]] = {"gain": gain, "f": r["f"], "c": r["c"], "lo": leaf(r["gl"], r["hl"]), "hi": leaf(gr, hr)}
        return chosen

    for _ in range(ROUNDS):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit(trees)))
        g, h = F.col("label") - p, p * (F.lit(1.0) - p)
        root = best(F.lit(0), g, h).get(0)
        if root is None:
            break
        side = F.when(F.col(root["f"]) <= root["c"], F.lit(0)).otherwise(F.lit(1))
        below = best(side, g, h)
        trees.append({"f": root["f"], "c": root["c"], "lo": below.get(0, root["lo"]), "hi": below.get(1, root["hi"])})
    return trees


def calibrate(held: DataFrame, trees: list[dict], precision: float = PRECISION) -> dict[int, float]:
    """Per kind the threshold beyond which held-out proposals reach ``precision``.

    It lies half way between the lowest score that still does and the next lower one
    seen, as no held-out row says where between them the precision is lost.
    """
    binned = held.select("k", "label", (F.floor(_logit(trees) * 10) / 10).alias("bin"))
    sums = binned.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    limits: dict[int, float] = {}
    rows = sums.collect()  # bounded by the bins of the scores
    for k in range(len(KINDS)):
        n = good = 0.0
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good / n < precision:
                if k in limits:
                    limits[k] = (limits[k] + r["bin"] + 0.1) / 2
                break
            limits[k] = r["bin"]
    return limits


def train(spark: SparkSession) -> tuple[list[dict], dict[int, float]]:
    rows = write_and_read(examples(spark), "examples")
    trees = fit(rows.filter("NOT held"))
    return trees, calibrate(rows.filter("held"), trees)


def personal_spans(docs: DataFrame, model: tuple[list[dict], dict[int, float]] | None = None) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (s, k, e)."""
    required(docs, ["doc_id", "text"])
    trees, limits = model or train(docs.sparkSession)
    limit = F.array(*[F.lit(float(limits.get(k, math.inf))) for k in range(len(KINDS))])
    chosen = F.filter(proposals(F.col("t")), lambda x: _logit(trees, x) >= F.get(limit, x["k"]))
    added = F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = docs.select("doc_id", text_of().alias("t"))
    spans = rows.select("doc_id", F.struct(base_spans(F.col("t")).alias("base"), added.alias("added")).alias("x"))
    return spans.select("doc_id", "x.base", _apart(F.col("x.added"), F.col("x.base")).alias("added"))


def _apart(added: Column, base: Column) -> Column:
    """The spans of ``added``, sorted and each once, that touch none of ``base`` (sorted): a binary search for each."""

    def free(a: Column, starts: Column, ends: Column) -> Column:
        # of the base spans that start before x ends, the furthest end
        clear = lambda x: F.coalesce(F.get(ends, n_below(starts, x["e"]) - 1) <= x["s"], F.lit(True))
        return F.filter(a, lambda x, i: ((i == 0) | (x != F.get(a, i - 1))) & clear(x))

    starts, ends = F.transform(base, lambda b: b["s"]), prefix_max(F.transform(base, lambda b: b["e"]))
    return let(F.sort_array(added), lambda a: let(starts, lambda s: let(ends, lambda e: free(a, s, e))))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every stretch covered by spans (sorted by start) replaced by its first span's kind in brackets."""
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def joined(x: Column, ends: Column) -> Column:
        done = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))
        gap = lambda x, i: F.substring(text, (done(i) + 1).cast("int"), (x["s"] - done(i)).cast("int"))
        pieces = F.transform(x, lambda x, i: F.when(x["s"] >= done(i), F.concat(gap(x, i), F.get(kinds, x["k"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.char_length(text)))

    ends = prefix_max(F.transform(spans, lambda x: x["e"]))
    return F.when(F.size(spans) > 0, let(spans, lambda x: let(ends, lambda e: joined(x, e)))).otherwise(text)


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    s = personal_spans(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    every = F.sort_array(F.concat("base", "added"))
    return s.select(
        "doc_id", *[of(k) for k in range(len(KINDS))], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans")
    )
