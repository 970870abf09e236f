import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def kept(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if kept(k, m[0])]


def texts():
    rng = random.Random(3)
    out = [None, "", "a@b.c.+x@y.org", "+12", "+1 (017) 555-7713.", "4111 1111-1111 1111 4283648832092189 0000000000000",
           "1.2.3.4.5.6.7.8 000000255.1.1.1 256.1.1.1 99999999999999999999.1.1.1", "é😀 a@b.co 😀 1.2.3.4",
           "0 " * 30000, "9" * 50000, "a" * 50000 + "@", "x@" + "a." * 20000 + "b", "+1" + " (" * 30000, "1." * 30000]
    for alphabet, n in (("a.@-+%", 400), ("0189. -+()", 600), ("ab@.01 -+é😀", 400)):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    for _ in range(300):  # digits in groups, many of them with a right check digit
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 19)))
        d += next(c for c in "0123456789" if luhn(d + c))
        out.append("".join(c + rng.choice(["", "", "", " ", "-", "  "]) for c in d))
    return out


def test_base_spans_equal_the_plain_expressions(spark):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert len(got) == len(data)
    for i, t in enumerate(data):
        want = brute(t)
        base = [s for s in got[i]["spans"].split(",") if s and s.split(":")[0] in pii.BASE_KINDS]
        assert base == [f"{k}:{a}:{b}" for k, a, b in want], repr(t)[:200]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]


def test_added_kinds_checksums_and_context(spark):
    data = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my ssn 123-45-6789", "part 123-45-6789",
            "ssn 000-45-6789", "card 4111111111111111", "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r["pii_spans"] for r in pii.find_spans(df).collect()}
    kinds = {i: [s["kind"] for s in v] for i, v in got.items()}
    assert kinds[0] == ["iban"] and (got[0][0]["start"], got[0][0]["end"]) == (5, 32)
    assert "iban" not in kinds[1] and kinds[2] == ["ssn"] and kinds[3] == [] and kinds[4] == []
    assert got[5][0]["score"] > got[6][0]["score"]


def test_redaction_round(spark):
    data = ["mail a@b.co now", "x 1.2.3.4", None, "", "none", "a@b.co", "+1 (017) 555-7713 é a@b.co!",
            "+4111 1111 1111 1111", "9" * 100]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_spans(df)).collect()}
    assert got[0] == "mail [EMAIL] now" and got[1] == "x [IP]" and got[2] is None and got[3] == "" and got[4] == "none"
    assert got[5] == "[EMAIL]" and got[6] == "[PHONE] é [EMAIL]!"
    assert got[7] in ("+[CARD]", "[PHONE]")
    clean = pii.digest(spark.createDataFrame(list(got.items()), "doc_id long, text string"))
    assert {r["spans"] for r in clean.collect()} == {""}


def test_edges(spark, odd_docs, no_docs):
    assert pii.digest(odd_docs).count() == odd_docs.count()
    assert pii.digest(no_docs).count() == 0
    clash = odd_docs.withColumn("kind", F.lit("x")).withColumn("start", F.lit(1)).withColumn("gaps", F.lit(2))
    assert sorted(map(tuple, pii.digest(clash).collect())) == sorted(map(tuple, pii.digest(odd_docs).collect()))


def test_runs_no_python(spark, odd_docs):
    plan = pii.digest(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Exchange hash"))


@pytest.mark.parametrize("iban,ok", [("GB82WEST12345698765432", True), ("DE89370400440532013000", True),
                                     ("DE89370400440532013001", False)])
def test_mod97(spark, iban, ok):
    assert spark.range(1).select(pii.mod97_ok(F.lit(iban)).alias("x")).first()["x"] is ok


def iban_spans(text):
    """By definition: from each start, as many characters as the country's IBANs have, a blank before any, mod-97."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}", text):
        n = pii.IBAN_LENGTHS.get(m[1], 0) - 4
        whole = re.compile(r"( ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % max(n, 0)).match(text, m.end()) if n > 0 else None
        if whole:
            d = text[m.start():whole.end()].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1:
                out.append((m.start(), whole.end()))
    return out


def test_ibans_whatever_follows(spark):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    found = {f"IBAN {de} Please pay": [de], f"{gb} AND more": [gb], f"{de} 2024": [de], f"{de} {no} A": [de, no],
             f"to {gb} 7 X": [gb], f"BE12 {de[:4]} 3704 0044 0532 0130 00 Ok": ["DE89 3704 0044 0532 0130 00"],
             f"DE89 {gb}": [gb], f"{de}X": [], f"{de}é": [de], f"x{de}": [], f"{de[:-1]}": [], f"{de[:-1]}1 Please": []}
    rng = random.Random(5)
    more = ["".join(rng.choice([de, gb, no, " ", " A", "Pay ", "DE12", "NO93 ", "BE12 ", "2024 ", ".", "é"]) for _ in range(rng.randint(1, 8)))
            for _ in range(400)] + ["DE89 " * 20000, "A" * 50000, "DE12" + " 1" * 30000]
    data = [*found, *more]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["pii_spans"] if s["kind"] == "iban"] for r in pii.find_spans(df).collect()}
    for i, want in enumerate(found.values()):
        assert [data[i][a:b] for a, b in got[i]] == want, data[i]
    for i, t in enumerate(data):
        assert got[i] == iban_spans(t), t[:200]
    assert sum(map(len, got.values())) > 100
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_spans(df)).collect()}
    assert redacted[0] == "IBAN [IBAN] Please pay" and redacted[1] == "[IBAN] AND more" and redacted[2] == "[IBAN] 2024"
