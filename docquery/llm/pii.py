"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose candidate spans: the four base kinds (email, ip, card, phone) and wider ones (account: 13 to 19
digits like a card's that fail its checksum, so account numbers and mistyped cards; tel: numbers without a leading plus; ssn;
name: runs of capitalised words). Three labelers vote +1, 0 or -1 on each candidate: a regex
labeler (strict form), a gazetteer labeler (known given names, mail domains, reserved ranges) and a context labeler (cue words
before the span). All corpus candidates are counted by vote pattern (at most 8 kinds x 27 votes x 3 lengths = 648 rows, so
only those reach the driver), expectation-maximisation estimates each labeler's reliability for each kind, and its posteriors
train the final classifier: a logistic model over kind, votes and length, applied to every candidate as a column expression.
Base spans that pass their own test always stay; the classifier decides on the others.

The patterns equal the plain ones but never back-track over long runs: quantifiers are possessive where nothing that
follows could match what they took, and a start inside a run that an earlier start has failed on is not tried again.

Defined results: null and empty texts have no spans; spans are code points with an exclusive end; repeated rows are judged
alike; very long texts are searched whole, in time that follows their length and matches (their places are summed up in pieces
of PIECE, so no text's matches are copied for each later one); an added span that overlaps a base one goes; log odds of exactly 0 do not add; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import id_and_text, settle

KINDS = ["email", "ip", "card", "phone", "account", "tel", "ssn", "name"]
BASE = 4
PIECE = 256
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "account": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "tel": r"(?<![0-9+().-])(?<![0-9+().-] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){0,2}+",
}
#: What a text must contain at all before a pattern is tried on it.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GIVEN = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret betty sandra ashley emily donna michelle carol amanda melissa deborah helen ruth "
    "hans karl heinz peter klaus wolfgang jürgen dieter manfred uwe werner günter horst andreas stefan matthias markus florian ursula monika petra elke sabine renate helga ingrid brigitte gisela claudia katrin birgit "
    "jean pierre michel andré philippe alain jacques bernard marcel daniel rené louis françois henri nicolas julien antoine marie jeanne françoise monique catherine nathalie isabelle jacqueline sylvie martine céline claire camille chloé "
    "antonio josé manuel francisco juan pedro jesús luis miguel ángel rafael carlos javier fernando pablo sergio alejandro diego jorge maría carmen ana isabel dolores pilar teresa rosa cristina laura lucía elena sofía marta paula "
    "anna maria julia martin alexander victor leo emma mia lena max felix hugo alice louise eva nina olga ivan anton"
)
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}$",
    "ip": rf"^{_BYTE}(?:\.{_BYTE}){{3}}$",
    "card": r"^(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3}$",
    "account": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
    "tel": r"^\(?[2-9][0-9]{2}\)?([ .-])[2-9][0-9]{2}[.-][0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"^\p{Lu}\p{Ll}+\.? \p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,})+$",
}
KNOWN = {
    "email": r"(?i)(?:@|\.)(?:com|org|net|edu|gov|de|fr|es|uk|io|info|gmail\.com|outlook\.com|yahoo\.com)$|\.(?:com|org|net|edu|gov|de|fr|es|uk|io|info)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.).*$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "account": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "tel": r"^\(?(?!555)[2-9][0-8][0-9]",
    "ssn": r"^(?!219-09-9999|078-05-1120)",
    "name": rf"(?i)\b(?:{'|'.join(GIVEN.split())})\b",
}
CUE = {
    "email": r"(?i)(?:mail|contact|write to|kontakt|correo|courriel|from|to)[^\p{L}]*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|client)[^\p{L}]*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)[^\p{L}]*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|numéro|teléfono)[^\p{L}]*$",
    "account": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|account|konto|compte|cuenta|iban)[^\p{L}]*$",
    "tel": r"(?i)(?:phone|tel|call|mobile|fax|telefon|numéro|teléfono)[^\p{L}]*$",
    "ssn": r"(?i)(?:ssn|social security)[^\p{L}]*$",
    "name": r"(?i)(?:name|dear|signed|contact|by|from|liebe[r]?|cher|chère|querid[oa])[^\p{L}]*$",
}
AGAINST = r"(?i)(?:order|invoice|version|isbn|article|part|serial|build|page|section)[^\p{L}]*$"


def luhn(digits: Column) -> Column:
    turned, n = F.reverse(digits), F.length(digits)
    digit = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(twice(i), F.lit(0))) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """The kind's own test of a match."""
    if kind == "ip":
        return m.rlike(STRICT["ip"])
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "account":
        return ~luhn(F.translate(m, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f's own functions use it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def spans(text: Column, kind: str) -> Column:
    """array<struct<k, s, e, regex, known, cue, len>> of the kind's matches that hold, in order."""
    pattern, k = F.lit(PATTERN[kind]), KINDS.index(kind)
    # Pieces between matches and the matches themselves give the positions.
    pairs = F.arrays_zip(F.split(text, PATTERN[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    none = F.expr("cast(array() as array<struct<s:int,hit:string,before:string>>)")

    def ends(steps: Column) -> Column:
        """Running sums, in pieces."""

        def piece(acc: Column, i: Column) -> Column:
            last = F.when(F.size(acc) > 0, F.element_at(F.element_at(acc, -1), -1)).otherwise(0)
            return F.concat(acc, F.array(F.aggregate(F.slice(steps, i * PIECE + 1, PIECE), F.array(last), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))))

        pieces = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE).cast("int")), F.expr("cast(array() as array<array<int>>)"), piece)
        return F.flatten(F.transform(pieces, lambda p: F.slice(p, 2, PIECE)))

    def located(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda x: F.length(x.gap) + F.coalesce(F.length(x.hit), F.lit(0)))
        kept = F.filter(F.arrays_zip(pairs.alias("p"), once(steps, ends).alias("e")), lambda x: x.p.hit.isNotNull() & holds(kind, x.p.hit))
        return F.transform(kept, lambda x: F.struct((x.e - F.length(x.p.hit)).alias("s"), x.p.hit.alias("hit"), F.right(x.p.gap, F.lit(32)).alias("before")))

    found = once(pairs, located)
    some = F.regexp_like(text, pattern)
    if kind in NEEDS:
        some = F.contains(text, F.lit(NEEDS[kind])) & some
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    return F.transform(
        F.coalesce(F.when(some, found), none),
        lambda x: F.struct(
            F.lit(k).alias("k"), x.s.alias("s"), (x.s + F.length(x.hit)).alias("e"),
            vote(x.hit.rlike(STRICT[kind])).alias("regex"),
            F.when(x.hit.rlike(KNOWN[kind]), 1).otherwise(-1 if kind in ("card", "ip", "ssn") else 0).alias("known"),
            F.when(x.before.rlike(CUE[kind]), 1).when(x.before.rlike(AGAINST), -1).otherwise(0).alias("cue"),
            F.when(F.length(x.hit) < 12, 0).when(F.length(x.hit) < 20, 1).otherwise(2).alias("len"),
        ),
    )


LABELERS = ("regex", "known", "cue")


def reliabilities(patterns: list[dict], rounds: int = 50) -> dict:
    """Expectation-maximisation over counted vote patterns: how often each labeler gives each vote, for true and false
    candidates of a kind, and the share of true ones. Starts from the majority vote; counts are smoothed."""
    post = {i: 1 / (1 + math.exp(-1.5 * sum(p[v] for v in LABELERS))) for i, p in enumerate(patterns)}
    model: dict = {}
    for _ in range(rounds):
        for kind in {p["k"] for p in patterns}:
            rows = [(i, p) for i, p in enumerate(patterns) if p["k"] == kind]
            yes, total = sum(post[i] * p["n"] for i, p in rows), sum(p["n"] for _, p in rows)
            table = {"prior": (yes + 1) / (total + 2)}
            for v in LABELERS:
                for vote in (-1, 0, 1):
                    a = sum(post[i] * p["n"] for i, p in rows if p[v] == vote)
                    b = sum((1 - post[i]) * p["n"] for i, p in rows if p[v] == vote)
                    # A labeler is held to be better than chance: the smoothing leans towards its own vote.
                    table[v, vote] = ((a + 1 + vote * 0.5) / (yes + 3), (b + 1 - vote * 0.5) / (total - yes + 3))
            model[kind] = table
        for i, p in enumerate(patterns):
            t, odds = model[p["k"]], math.log(model[p["k"]]["prior"] / (1 - model[p["k"]]["prior"]))
            odds += sum(math.log(t[v, p[v]][0] / t[v, p[v]][1]) for v in LABELERS)
            post[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return {"model": model, "posterior": post}


def features(p: dict) -> list[str]:
    return ["bias", f"k{p['k']}", f"len{p['len']}", *(f"{v}{p[v]}" for v in LABELERS)]


def train_classifier(patterns: list[dict], posterior: dict, steps: int = 1500, rate: float = 1.0, decay: float = 1e-4) -> dict[str, float]:
    """Logistic regression of the posteriors on the discrete features, weighted by the counts."""
    w: dict[str, float] = {}
    weight = {i: p["n"] for i, p in enumerate(patterns)}
    whole = sum(weight.values()) or 1
    for _ in range(steps):
        slope: dict[str, float] = {}
        for i, p in enumerate(patterns):
            x = features(p)
            miss = weight[i] * (posterior[i] - 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in x)))) / whole
            for f in x:
                slope[f] = slope.get(f, 0.0) + miss
        w = {f: w.get(f, 0.0) + rate * (slope[f] * len(LABELERS) - decay * w.get(f, 0.0)) for f in slope}
    return w


def classified(x: Column, w: dict[str, float]) -> Column:
    """The classifier's log odds of a candidate, as a column."""
    odds = F.lit(w.get("bias", 0.0))
    for name in ("k", "len", *LABELERS):
        values = [(int(m[1]), v) for f, v in sorted(w.items()) if (m := re.fullmatch(rf"{name}(-?\d+)", f))]
        part = F.lit(0.0)
        for at, v in values:
            part = F.when(x[name] == at, v).otherwise(part)
        odds = odds + part
    return odds


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    rows = id_and_text(docs)
    text = F.coalesce("text", F.lit(""))
    found = settle(rows.select("doc_id", F.concat(*(spans(text, k) for k in KINDS)).alias("found")), "candidates")
    counted = found.select(F.explode("found").alias("x")).groupBy("x.k", "x.len", *(f"x.{v}" for v in LABELERS)).agg(F.count(F.lit(1)).alias("n"))
    patterns = [r.asDict() for r in counted.orderBy("k", "len", *LABELERS).collect()]  # at most 648 rows
    w = train_classifier(patterns, reliabilities(patterns)["posterior"])
    found = found.select("doc_id", F.filter("found", lambda x: (x.k < BASE) | (classified(x, w) > 0)).alias("found"))
    # The wider kinds give way to base spans that they overlap.
    base = F.filter("found", lambda x: x.k < BASE)
    found = found.select("doc_id", base.alias("base"), F.filter("found", lambda x: (x.k >= BASE) & ~F.exists(base, lambda y: (x.s < y.e) & (y.s < x.e))).alias("wide"))
    name = F.array(*map(F.lit, KINDS))
    write = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(name, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(write(F.col("base")).cast("binary"), 256).alias("base_sha256"), write(F.concat("base", "wide")).alias("spans"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by plain expressions over the whole text; for tests."""
    text, out = text or "", []

    def good(kind: str, m: re.Match) -> bool:
        digits = [int(c) for c in m[0] if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m[0].split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    for kind, rule in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        out += [(kind, m.start(), m.end()) for m in re.finditer(rule, text) if good(kind, m)]
    return out
