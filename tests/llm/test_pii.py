import hashlib
import random
import re

from severa.llm import pii

# the contract's own patterns; the others by whole runs
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Za-z0-9]+",
    "ssn": r"[0-9-]+",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, x, near):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "iban":
        return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x)) and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    if kind == "ssn":
        return bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", x)) and bool(re.search(r"(?:^|[^a-z])(?:ssn|social security|tax id)", near))
    return True


def brute(text):
    text = text or ""
    out = []
    for i, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            near = (text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]).lower()
            if valid(kind, m[0], near):
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def row(doc_id, text):
    found = brute(text)
    listed = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
    base = [x for x in found if x[1] < 4]
    return (doc_id, *[sum(x[3] == k for x in base) for k in ("email", "ip", "card", "phone")], hashlib.sha256(listed(base).encode()).hexdigest(), listed(found))


FIXED = [
    None, "", "a@b", "a@b.c", "x a@b.c_d@e.f y", "é ä@b.de a.b+c%d@x-y.co.uk.", "a@b.c.@d.e", "@@a@b.c@d.e.f@", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.256 0001.2.3.004", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111 11111111 4", "5 4111111111111111", "4111111111111111  4111  1111  1111 1111", "x4111111111111111y 378282246310005 79927398713 799273987130", "+1 (743) 555-3824.", "+1 555", "+12(((((", "++49 30 1234567-",
    "+1 (743) 555-3824 +49-30-123456789012345", "DE89370400440532013000 iban GB82WEST12345698765432 xGB82WEST12345698765432 DE89370400440532013001", "ssn 123-45-6789, 123-45-6789-1", "my SSN: 123-45-6789 then " + "z" * 60 + " 987-65-4321", "😀 a@b.c 😀 1.2.3.4",
    "1-2-3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "0" * 30, "0" * 19, "1" * 50000, "a" * 50000 + "@", "a.b@" * 3000 + "c.d",
]


def test_whole_texts(spark):
    rng = random.Random(7)
    bits = ["a", "Z", "@", ".", "-", "+", " ", "1", "4", "0", "9", "(", ")", "_", "é", "😀", "mail ", "ssn ", "\n", "123-45-6789", "255", "4111111111111111", "DE89370400440532013000"]
    texts = FIXED + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _text string")
    got = {r[0]: tuple(r) for r in pii.report(docs).collect()}
    for i, t in rows:
        assert got[i] == row(i, t), t


def test_mask(spark):
    docs = spark.createDataFrame([(1, "to a@b.c, +1 (743) 555-3824!", 28, "q"), (2, None, None, None), (3, "plain", 5, "q"), (4, "+4111111111111111.", 18, "q")], "doc_id long, text string, n_chars long, _pii string")
    got = pii.mask(docs, "text", "n_chars")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "to [EMAIL], [PHONE]!", 20, "q"), (2, None, None, None), (3, "plain", 5, "q"), (4, "+[CARD].", 8, "q")]
    assert pii.mask(docs.limit(0), "text").count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.001"
    want = [row(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_pii(spark, d).collect())) == sorted(want)
