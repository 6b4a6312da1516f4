"""Personal data by weak supervision, in DataFrame functions only.

Candidates are matches of the base patterns (email, ip, card, phone; leftmost, not overlapping within a kind), of
looser ones (local phone numbers, spelt-out emails, secrets) and, inside base matches that fail their check, parts that
pass it (a phone number with an address behind it, two card numbers in a row).  Base spans, those whose match passes its
check, always stay.  For the rest labelers vote for (1), against (-1) or not at all (0): the base rule, a gazetteer of
the kind, the words before the match, the characters at its edges and the make-up of its characters.  Expectation-maximisation
(Dawid and Skene) estimates how reliable each labeler is from the counts of vote patterns alone, starting from a vote in
which the base rule, a checksum or a range, counts WEIGHTS["rule"] times and knowing that rule to be sound; its posteriors
train the final classifier, a logistic regression over the span's own features
(kind, size, share of digits, edges, check).  Candidates that it puts at DECIDE or more become spans too, base matches
that failed their check among them, unless they overlap a base span of their kind or a longer accepted candidate of it.
``redact`` also replaces other occurrences of a found value of KNOWN code points or more in the same text: what is
personal in one place is so where it touches other characters.

Documents are read once; votes and features are cut to a table.  Only counts of vote and feature patterns, whose number
is bounded by their definition (1,215 and 4,800), reach the driver; models come back as literals.

Defined cases: a null or empty text has no spans; rows repeated are judged each; an empty table gives an empty result;
without candidates the classifier adds nothing; a text of any length is searched whole; of candidates that start alike the
longer one stays; positions are code points, ends exclusive; columns other than id and text are not read by ``find`` and
are kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, table, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
DECIDE = 0.5
#: Ridge of the classifier.
RIDGE = 0.05
#: Code points of a value that redaction replaces wherever it occurs in its text.
KNOWN = 8

# The base patterns, with possessive loops and, for emails, a start only where a run of name characters starts, so
# that long runs are passed once.  They match what the plain patterns match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser ones.
SPELT_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64} ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{2,63} ?[\[(] ?dot ?[\])] ?[a-z]{2,10}"
LOCAL_PHONE = r"(?<![0-9+.-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
SECRET = r"""(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[=:] ?["']?[A-Za-z0-9+/_-]{16,}+["']?"""
# Parts of base matches that fail their check, between characters that aren't digits (an address has none of those).
PARTS = {
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?:[\x20-]?[0-9]{1,3})?(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9.])",
}

OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
#: Gazetteers.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|int|info|biz|io|ai|eu|de|at|ch|fr|be|es|mx|ar|it|nl|pl|pt|uk|ie|us|ca|au|nz|jp|cn|in|br|ru)$"
RESERVED_IP = r"^0*(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."
COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse|direcci)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|konto|carte|tarjeta|account)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|whatsapp|handy|tél)[^\n]{0,24}$",
    "secret": r"(?i)(?:auth|bearer|login|export|header|config)[^\n]{0,24}$",
}
AGAINST = r"(?i)(?:version|v\.|isbn|section|chapter|release|§)[^\n]{0,8}$"
LABELERS = ("rule", "gazetteer", "context", "edges", "makeup")
#: What the votes count in the first round.
WEIGHTS = {"rule": 4.0, "gazetteer": 1.0, "context": 1.0, "edges": 1.0, "makeup": 1.0}
#: The base rule is known to be good: it gets as many votes as there are candidates, of which so many are right.
SOUND = 0.98
FAILED, LOOSE, BASE, PART = range(4)


def found(text: Column, pattern: str) -> Column:
    """Array of (start, s) of the leftmost matches that don't overlap; start in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))),
        empty,
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["h"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    return F.zip_with(starts, hits, lambda a, s: F.struct(a.alias("start"), s.alias("s")))


def luhn(s: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of 10."""
    d = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def n_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.otherwise(0) if no is None else out.when(no, -1).otherwise(0)).cast("int")


def _passes(kind: str, s: Column) -> Column:
    return {"email": lambda: F.lit(True), "ip": lambda: s.rlike(OCTETS), "card": lambda: luhn(s), "phone": lambda: n_digits(s).between(8, 15), "secret": lambda: F.lit(False)}[kind]()


def _candidates(text: Column, kind: str, pattern: str, gate: Column, loose: bool = False) -> Column:
    """Array of candidates with votes and features where gate holds.  loose: the pattern isn't the base one."""
    k = KINDS.index(kind)

    def look(x, part=False):
        s, start = x["s"], x["start"]
        end = start + F.length(s)
        left = F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
        before, after = F.substring(left, -1, 1), F.substring(text, end + 1, F.lit(1))
        digits, size = n_digits(s), F.length(s)
        kinds = F.size(F.array_distinct(F.split(s, "")))
        judged = loose or part
        base = F.lit(False) if judged else _passes(kind, s)
        gazetteer = {
            "email": _vote(s.rlike(DOMAINS) | F.lower(s).rlike(r"dot ?[\])]? ?(?:com|org|net|de|fr|es)$"), ~s.rlike(DOMAINS)),
            "ip": _vote(s.rlike(OCTETS) & ~s.rlike(RESERVED_IP), s.rlike(RESERVED_IP) | ~s.rlike(OCTETS)),
            "card": _vote(digits.between(16, 19) & s.rlike("^[3-6]"), ~digits.between(13, 19)),
            "phone": _vote(s.rlike(COUNTRY) | s.rlike(r"^\("), ~digits.between(7, 15)),
            "secret": _vote(s.rlike(r"[0-9]") & s.rlike("[A-Za-z]")),
        }[kind]
        makeup = {
            "email": _vote(size.between(6, 254), size > 254),
            "ip": _vote(size >= 9, size < 8),
            "card": _vote((kinds >= 5) & digits.between(16, 19), (kinds < 4) | ~digits.between(13, 19)),
            "phone": _vote((kinds >= 5) & digits.between(9, 15), kinds < 4),
            "secret": _vote(kinds >= 12, kinds < 8),
        }[kind]
        word = r"[\p{L}0-9]"
        return F.struct(
            F.lit(k).alias("kind"), start.alias("start"), end.alias("end"), base.alias("base"),
            F.struct(
                (F.lit(0) if judged else F.when(base, 1).otherwise(-1)).cast("int").alias("rule"),
                gazetteer.alias("gazetteer"),
                _vote(left.rlike(CONTEXT[kind]), left.rlike(AGAINST)).alias("context"),
                _vote(~before.rlike(word) & ~after.rlike(word), before.rlike(word) & after.rlike(word)).alias("edges"),
                makeup.alias("makeup"),
            ).alias("votes"),
            F.struct(
                F.lit(k).alias("kind"), F.least((size / 6).cast("int"), F.lit(9)).alias("size"),
                (digits * 5 / F.greatest(size, F.lit(1))).cast("int").alias("digits"),
                F.when(F.coalesce(before.rlike(word), F.lit(False)), 1).otherwise(0).cast("int").alias("before"),
                F.when(F.coalesce(after.rlike(word), F.lit(False)), 1).otherwise(0).cast("int").alias("after"),
                (F.lit(PART if part else LOOSE) if judged else F.when(base, BASE).otherwise(FAILED)).cast("int").alias("check"),
            ).alias("features"),
        )

    none = F.array().cast(
        "array<struct<kind: int, start: int, end: int, base: boolean, votes: struct<rule: int, gazetteer: int, context: int, edges: int, makeup: int>,"
        " features: struct<kind: int, size: int, digits: int, before: int, after: int, check: int>>>"
    )
    hits = found(text, pattern)
    out = F.transform(hits, lambda x: look(x))
    if not loose and kind in PARTS:
        failed = F.filter(hits, lambda x: (F.length(x["s"]) > 8) & ~_passes(kind, x["s"]))
        parts = F.flatten(F.transform(failed, lambda x: F.transform(found(x["s"], PARTS[kind]), lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["s"].alias("s")))))
        out = F.concat(out, F.transform(F.filter(parts, lambda x: _passes(kind, x["s"])), lambda x: look(x, True)))
    return F.when(gate, out).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and cands: the candidates of every row, base spans among them."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_pii_text"))
    return d.select("doc_id", _all_candidates(F.col("_pii_text")).alias("cands"))


def _all_candidates(t: Column) -> Column:
    """Candidates of all kinds; digit runs far too short for a card are left out."""
    return F.concat(
        _candidates(t, "email", EMAIL, F.contains(t, F.lit("@"))),
        _candidates(t, "ip", IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        F.filter(_candidates(t, "card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda c: c["features"]["size"] >= 2),
        _candidates(t, "phone", PHONE, F.contains(t, F.lit("+"))),
        _candidates(t, "email", SPELT_EMAIL, t.rlike(r"(?i)[\[(] ?dot"), True),
        _candidates(t, "phone", LOCAL_PHONE, t.rlike("[0-9]{3}[.-][0-9]{4}"), True),
        _candidates(t, "secret", SECRET, t.rlike("(?i)token|secret|passw|key"), True),
    )


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """P(personal) of each (kind, votes), from (kind, votes, count), by Dawid and Skene's model with two classes.

    Labelers are taken as independent given the class; the prior is that of the kind.  The first posteriors are those
    of a weighted vote, which also fixes which class is which.
    """
    votes = float(sum(n for _, _, n in patterns))
    post = {(k, v): 1 / (1 + math.exp(-sum(WEIGHTS[name] * x for name, x in zip(LABELERS, v)))) for k, v, _ in patterns}
    for _ in range(rounds):
        like = [[{x: 0.0 for x in (-1, 0, 1)} for _ in LABELERS] for _ in (0, 1)]
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        for k, v, n in patterns:
            for c, p in ((1, post[k, v]), (0, 1 - post[k, v])):
                prior[k][c] += n * p
                for j, x in enumerate(v):
                    like[c][j][x] += n * p
        for c in (0, 1):
            for j in range(len(LABELERS)):
                # one pseudo-vote in the sense of the class, so that a labeler without evidence stays a weak one
                table = {x: like[c][j][x] + (1.0 if x * (2 * c - 1) > 0 else 0.5) for x in (-1, 0, 1)}
                if LABELERS[j] == "rule":
                    table[2 * c - 1] += SOUND * votes
                    table[1 - 2 * c] += (1 - SOUND) * votes
                total = sum(table.values())
                like[c][j] = {x: y / total for x, y in table.items()}
        for k, v, _ in patterns:
            z = math.log(prior[k][1] / prior[k][0]) + sum(math.log(like[1][j][x] / like[0][j][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return post


#: Features of the classifier: name and number of values.
FEATURES = (("kind", len(KINDS)), ("size", 10), ("digits", 6), ("before", 2), ("after", 2), ("check", 4))


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 30) -> tuple[float, list[list[float]]]:
    """Bias and weights of a logistic regression over one-hot features, from (features, count, sum of posteriors), by
    Newton's method with a small ridge."""
    sizes = [n for _, n in FEATURES]
    first = np.cumsum([1, *sizes[:-1]])
    x = np.zeros((len(rows), 1 + sum(sizes)))
    x[:, 0] = 1
    for i, (values, _, _) in enumerate(rows):
        x[i, first + np.array(values)] = 1
    n, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * p - y) + RIDGE * w)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return float(w[0]), [w[a : a + k].tolist() for a, k in zip(first, sizes)]


def train(cands: DataFrame) -> tuple[float, list[list[float]]] | None:
    each = cut(
        cands.select(F.explode("cands").alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").alias("n"))
    )  # at most 1,215 x 4,800 rows, in practice some hundreds
    votes = each.groupBy("features.kind", *(F.col(f"votes.{name}") for name in LABELERS)).agg(F.sum("n").alias("n")).collect()
    patterns = sorted((r[0], tuple(r[1 : 1 + len(LABELERS)]), r["n"]) for r in votes)
    if not patterns:
        return None
    post = expectation_maximisation(patterns)
    known = each.sparkSession.createDataFrame(
        [(k, *v, p) for (k, v), p in post.items()], "kind int, " + ", ".join(f"{n} int" for n in LABELERS) + ", p double"
    )
    flat = each.select("features.*", *(F.col(f"votes.{n}") for n in LABELERS), "n")
    sums = flat.join(F.broadcast(known), ["kind", *LABELERS]).groupBy(*(f for f, _ in FEATURES)).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p"))
    return fit_classifier(sorted((tuple(r[f] for f, _ in FEATURES), float(r["n"]), r["p"]) for r in sums.collect()))


SPAN = "array<struct<kind: int, start: int, end: int>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, sorted; kind indexes KINDS) of every row of docs."""
    cands = cut(candidates(docs, id_col, text_col))
    return _spans(cands, train(cands)).select("doc_id", "base", "spans")


def _spans(cands: DataFrame, model: tuple[float, list[list[float]]] | None) -> DataFrame:
    def plain(c):
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    out = cands.withColumn("base", F.array_sort(F.transform(F.filter("cands", lambda c: c["base"]), plain)))
    if model is None:
        return out.withColumn("spans", F.col("base"))
    bias, w = model

    def likely(c):
        z = F.lit(bias)
        for j, (name, _) in enumerate(FEATURES):
            z = z + F.element_at(F.array(*map(F.lit, w[j])), c["features"][name] + 1)
        return 1 / (1 + F.exp(-z)) >= DECIDE

    def clash(c, others):
        return F.exists(others, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (b["end"] > c["start"]))

    # a part lies inside its failed match, so one of them can stay: the whole match, if the model takes it
    taken = F.filter("cands", lambda c: ~c["base"] & likely(c) & ~clash(c, F.col("base")))
    whole = F.transform(F.filter(taken, lambda c: c["features"]["check"] != PART), plain)
    out = out.withColumn("_pii_whole", whole).withColumn("_pii_parts", F.transform(F.filter(taken, lambda c: c["features"]["check"] == PART), plain))
    free = F.concat("_pii_whole", F.filter("_pii_parts", lambda c: ~clash(c, F.col("_pii_whole"))))
    return out.withColumn("spans", F.array_sort(F.array_distinct(F.concat(F.col("base"), free)))).drop("_pii_whole", "_pii_parts")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its text, and other occurrences of their values, replaced by <KIND>; n_chars, if there,
    follows the new text."""
    held = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), text_of(text_col).alias("_pii_all"))
    held = cut(held.withColumn("cands", _all_candidates(F.col("_pii_all"))))  # patterns run once, for training and for redaction
    spans = _spans(held, train(held))
    # overlapping spans unite; then the text between them and their names are joined
    united = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["text"].alias("text"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["text"], F.substring("_pii_all", acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit(">")).alias("text"),
            )
        ),
        lambda acc: F.concat(acc["text"], F.substring("_pii_all", acc["at"] + 1, F.length("_pii_all"))),
    )
    # longer values first, so that none is cut by one that it holds; a value never holds a mark
    values = F.transform("spans", lambda s: F.struct((s["start"] - s["end"]).alias("order"), F.substring("_pii_all", s["start"] + 1, s["end"] - s["start"]).alias("s"), s["kind"].alias("kind")))
    values = F.array_sort(F.array_distinct(F.filter(values, lambda v: v["order"] <= -KNOWN)))
    name = F.array(*map(F.lit, KINDS))
    known = F.aggregate(values, F.col("_pii_new"), lambda acc, v: F.replace(acc, v["s"], F.concat(F.lit("<"), F.upper(F.element_at(name, v["kind"] + 1)), F.lit(">"))))
    none = F.size("spans") == 0
    new = spans.withColumn("_pii_new", F.when(none, F.col(f"doc.{text_col}")).otherwise(united))
    new = new.withColumn("new", F.when(none, F.col("_pii_new")).otherwise(known))
    names = {text_col: F.col("new").alias(text_col)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        names["n_chars"] = F.when(none, F.col("doc.n_chars")).otherwise(F.length("new")).cast(kind).alias("n_chars")
    return new.select(*(names.get(c, F.col(f"doc.{c}").alias(c)) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(table(spark, sf_dir, "documents"))

    def number(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [number(k) for k in range(len(BASE_KINDS))]
    return spans.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
