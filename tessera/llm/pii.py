r"""Personal data: patterns propose spans, validators confirm them, context adjusts a score.

Everything is built-in expressions on one row: no shuffle, no Python.  Positions come from
the same engine as the matches: splitting by a pattern gives the gaps between its matches,
and running sums of gap and match lengths give where each match starts.

Patterns are rewritten so that no group repeats without bound (the regular expression
engine would recurse once per repetition) and no run of characters is scanned from each of
its characters, which keeps very long texts linear:

* e-mail: a dot that no domain character follows is masked by ``%``, which only the local
  part may hold; domains are then one character class behind the first dot.
* card: separators that are not alone between two digits are masked; a match is then a run
  of one character class.

Kinds email, ip, card and phone follow fixed rules and always stay.  The method adds IBANs
(length by country, mod-97), social security numbers and secrets (long runs of letters and
digits, as keys and tokens are).  Scores: a base by kind, raised when a word that speaks for
the kind stands within ``NEAR`` characters and lowered when one that speaks against it does;
spans from ``KEEP`` on are reported.  A number like a social security number or a secret
needs a word for it; an IBAN is dropped where words speak against it.

Cases: null and empty texts have no spans; texts are read whole; repeated rows give repeated
results; an empty table gives an empty table; further columns are kept, and a clash with an
output name raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.exprs import let

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
NEAR, KEEP = 40, 0.5

# Patterns, base scores and context words of each kind.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9 -]{2,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LC|LY|PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
SCORE = {"email": 0.8, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.6, "ssn": 0.4, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|address|server|host|adresse",
    "card": "card|visa|credit|payment|carte|tarjeta|karte",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "secret": "token|secret|api|key|password|passwd|auth|bearer|credential",
}
AGAINST = {
    "email": "example|test",
    "ip": "version|release",
    "card": "order|serial|isbn",
    "phone": "order|serial|isbn",
    "iban": "serial|part|order|model|example",
    "ssn": "order|serial|part|example",
    "secret": "sha|md5|commit|checksum|digest|uuid|example",
}
RAISE = 0.2
_WIDE = 256


def running_starts(lengths: Column) -> Column:
    """Exclusive running sums of an array of longs, by blocks so that long arrays stay cheap.

    ``lengths`` is a bound variable (see ``let``).
    """
    n, zero = F.size(lengths), F.lit(0).cast("long")
    block = lambda i: F.floor(i / _WIDE).cast("int")
    part = lambda b, many: F.aggregate(F.slice(lengths, b * _WIDE + 1, many), zero, lambda acc, x: acc + x)
    blocks = F.aggregate(F.sequence(F.lit(0), block(n - 1)), F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + part(b, F.lit(_WIDE)))))
    return let(blocks, lambda before: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(before, block(i)) + part(block(i), i % _WIDE)))


def matches(text: Column, pattern: str, mask: Callable[[Column], Column] = lambda t: t) -> Column:
    """All leftmost non-overlapping matches as array of (start, end, hit), in code points.

    The pattern is matched on ``mask(text)``, which keeps positions; hits are cut from ``text``.
    """

    def placed(text: Column, hits: Column, gaps: Column) -> Column:
        sizes = F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.array(F.length(g).cast("long"), F.length(h).cast("long"))))
        starts = let(sizes, running_starts)
        odd = F.filter(starts, lambda _, i: i % 2 == 1)
        return F.zip_with(hits, odd, lambda h, s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), F.substring(text, (s + 1).cast("int"), F.length(h)).alias("hit")))

    found = lambda m: F.struct(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)).alias("hits"), F.split(m, pattern, -1).alias("gaps"))
    return let(let(mask(text), found), lambda f: F.when(F.size(f["hits"]) > 0, placed(text, f["hits"], f["gaps"])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, d(i)).when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, blanks aside, passes the mod-97 check."""
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97))
    return rest == 1


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def proposals(text: Column) -> dict[str, Column]:
    """For each kind the confirmed matches; null where a text has none."""
    dotless = lambda t: F.regexp_replace(t, r"\.(?![A-Za-z0-9-])", "%")
    runs = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^0-9 -]", "x"), "[ -](?![0-9])", "x"), "(?<![0-9])[ -]", "x")
    in_byte = lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, dotless)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), F.filter(matches(text, IP), lambda m: F.forall(F.split(m["hit"], r"\."), in_byte))),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), F.filter(matches(text, CARD, runs), lambda m: let(_digits(m["hit"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(matches(text, PHONE), lambda m: F.length(_digits(m["hit"])).between(10, 15))),
        "iban": F.when(text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), F.filter(matches(text, IBAN), lambda m: mod97(m["hit"]))),
        "secret": F.when(text.rlike("[A-Za-z0-9_-]{20}"), F.filter(matches(text, SECRET), lambda m: m["hit"].rlike("[A-Za-z]") & (F.length(_digits(m["hit"])) >= 4))),
        "ssn": F.when(text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), matches(text, SSN)),
    }
    return found


def _scorer(text: Column, order: int, kind: str) -> Callable[[Column], Column]:
    def scored(m: Column) -> Column:
        a = F.greatest(m["start"] - NEAR, F.lit(0))
        around = F.lower(F.concat_ws("\n", F.substring(text, (a + 1).cast("int"), (m["start"] - a).cast("int")), F.substring(text, (m["end"] + 1).cast("int"), F.lit(NEAR))))
        score = F.lit(SCORE[kind]) + F.when(around.rlike(rf"\b(?:{CONTEXT[kind]})"), RAISE).otherwise(0.0) - F.when(around.rlike(rf"\b(?:{AGAINST[kind]})"), RAISE).otherwise(0.0)
        return F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["hit"].alias("hit"), F.greatest(score, F.lit(KEEP if order < len(BASE) else 0.0)).alias("score"))

    return scored


def entities(text: Column) -> Column:
    """Spans of a text as array of (start, ord, end, kind, hit, score) from ``KEEP`` on."""
    text = F.coalesce(text, F.lit(""))
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string,hit:string,score:double>>)")
    found = proposals(text)
    out = [F.coalesce(F.transform(found[kind], _scorer(text, order, kind)), none) for order, kind in enumerate(KINDS)]
    return F.array_sort(F.filter(F.concat(*out), lambda e: e["score"] >= KEEP))


def find(df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
    """Add the entities of ``text``."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} is in the input already")
    return df.withColumn(out, entities(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans merge into the first."""
    step = lambda acc, e: F.when(
        e["start"] >= acc["at"],
        F.struct(F.concat(acc["parts"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (e["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(e["kind"]), F.lit("]")))).alias("parts"), e["end"].alias("at")),
    ).otherwise(F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], e["end"]).alias("at")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(0).cast("long").alias("at"))
    done = lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2_000_000_000)))), "")
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the fixed kinds, digest of their spans, all spans."""
    e = find(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "entities").select("doc_id", "entities")
    count = lambda k: F.size(F.filter("entities", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("entities", lambda x: x["ord"] < len(BASE))
    scores = F.array_join(F.transform("entities", lambda x: F.format_number(x["score"], 1)), ",")
    return e.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("entities")).alias("spans"), *map(count, KINDS[len(BASE) :]), F.size("entities").cast("long").alias("n_spans"), scores.alias("scores"))
