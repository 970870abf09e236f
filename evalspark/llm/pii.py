"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a Column expression on the text (no Python, no shuffle).  Each
expression is written so that Java's matcher runs in linear time and without
recursion on any text: possessive loops, and starts only where a run begins.
They match exactly what the plain forms in the comments match.

Base kinds (always kept once confirmed): email, ip (parts at most 255), card
(13-19 digits, Luhn), phone (9-15 digits).  Added kinds: iban (its country's
length, mod-97; what follows it after a blank does not matter) and ssn, kept
when their score reaches ``THRESHOLD``.  A span is (kind, start, end,
score), in code points, end exclusive.

Defined results: a null or empty text has no spans; equal rows get equal spans;
other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.6
CONTEXT_CHARS = 48  # text before a span in which context words count

#: ISO 13616: characters of an IBAN, country code and check digits included, by country code: the registry's, then codes in use without an entry.
IBAN_LENGTHS = {code: int(n) for n, codes in (x.split(":") for x in (
    "15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|"
    "23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|"
    "28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU|"
    "25:AO CV GW MZ|26:DZ IR|27:CF CG CM GA GQ KM MG TD|28:BF BJ CI MA ML NE SN TG").split("|")) for code in codes.split()}


def _iban() -> str:
    """A country code and two digits, from which (group 1) as many characters follow as the country's IBANs have, a blank before any.

    Only the first four characters are consumed, so every start is tried, also one inside a candidate that fails mod-97.
    """
    of_length = (f"(?:{'|'.join(sorted(c for c, m in IBAN_LENGTHS.items() if m == n))})[0-9]{{2}}(?:\\x20?+[A-Z0-9]){{{n - 4}}}"
                 for n in sorted(set(IBAN_LENGTHS.values())))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join(of_length)})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]  (two digits alone also match here; they are too few for a phone)
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: The group that holds the span, where it is not the whole match.
SPAN_GROUP = {"iban": 1}
#: A text without this character or pattern has no such span; spares the full search.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}
#: Score of a confirmed span without context, and the words that raise it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS = 0.4
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse|servidor|serveur)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono|appel)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|insurance)\b",
}


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable is never computed again)."""
    return F.transform(F.array(value), body)[0]


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """The Luhn check of a string of digits: from the right, every second digit doubled."""
    def total(d):
        def add(acc, i):
            x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return total(number) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 13616: first four characters moved to the end, letters as 10-35, remainder 1."""
    s = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def add(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), add) == 1


def confirmed(kind: str, s: Column) -> Column:
    """Whether a proposed span is kept, by the checks of its kind."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: bind(
            F.regexp_replace(p, "^0++", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return bind(digits(s), lambda d: F.when(F.length(d).between(13, 19), luhn_ok(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "iban":
        return bind(F.regexp_replace(s, " ", ""), lambda d: F.when(F.length(d).between(15, 34), mod97_ok(d))
                    .otherwise(F.lit(False)))
    if kind == "ssn":
        return ~s.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, by start: array of struct(kind, start, end, score).

    The text between the matches (``gaps``) and the matches alternate, so a
    match starts after i gaps and i - 1 matches.  ``whole`` are the spans: the
    matches, or what their ``SPAN_GROUP`` holds.
    """
    pattern = PATTERNS[kind]
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")

    def spans(m):
        gaps, found = m["gaps"], m["found"]
        whole = m["whole"] if kind in SPAN_GROUP else found
        kept = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: confirmed(kind, F.element_at(whole, i)))
        chars = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, s: a + F.length(s))

        def span(i):
            start = chars(gaps, i) + chars(found, i - 1)
            before = F.substring(F.concat_ws("", F.slice(found, F.greatest(i - 1, F.lit(1)), F.when(i > 1, 1).otherwise(0)),
                                             F.element_at(gaps, i)), -CONTEXT_CHARS, CONTEXT_CHARS)
            score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"),
                            (start + F.length(F.element_at(whole, i))).alias("end"), score.alias("score"))
        out = F.transform(kept, span)
        if kind in ADDED_KINDS:
            out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
        return F.when(F.size(found) > 0, out).otherwise(none)

    groups = {"found": 0} | ({"whole": SPAN_GROUP[kind]} if kind in SPAN_GROUP else {})
    out = bind(F.struct(F.split(text, pattern, -1).alias("gaps"),
                        *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for name, g in groups.items())), spans)
    if kind in NEEDS:
        return F.when(F.instr(text, NEEDS[kind]) > 0, out).otherwise(none)
    return out


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with a column of all spans, by kind as in :data:`KINDS`, then start."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(out, F.concat(*(kind_spans(t, k) for k in KINDS)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    t, column = F.col(f"`{text}`"), F.col(f"`{spans}`")

    def joined(ordered):
        """Overlapping spans merged: an open span grows until one starts at or after its end."""
        empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")

        def add(acc, s):
            last = F.element_at(acc, -1)
            one = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
            grown = F.struct(last["kind"].alias("kind"), last["start"].alias("start"),
                             F.greatest(last["end"], s["end"]).alias("end"))
            return (F.when(F.size(acc) == 0, F.array(one))
                    .when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))
                    .otherwise(F.concat(acc, F.array(one))))
        return F.aggregate(ordered, empty, add)

    by_start = F.array_sort(F.transform(column, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(m):
        def piece(s, i):
            at = F.when(i == 0, 0).otherwise(F.element_at(m, F.greatest(i, F.lit(1)))["end"])
            return F.concat(F.substring(t, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.concat(F.array_join(F.transform(m, piece), ""), F.substr(t, F.element_at(m, -1)["end"] + 1))
    return docs.withColumn(text, F.when(F.size(column) > 0, bind(joined(by_start), pieces)).otherwise(t))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, hash of the base spans, and all spans as text."""
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    n = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_spans(docs.select("doc_id", "text")).select(
        "doc_id", *(n(k) for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"))
