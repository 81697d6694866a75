"""Personal data: base spans beside the patterns themselves, what the parsers add, and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cohortspark.llm.private_data import BASE_KINDS, KINDS, find_private, luhn, mask_private, masked, private_spans
from cohortspark.llm.queries import op12_find_private_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_pattern(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def base(text):
    return [x[:3] for x in find_private(text) if x[3]]


def found(text, kind):
    return [text[s:e] for k, s, e, b in find_private(text) if k == kind and not b]


@pytest.mark.parametrize("alphabet", ["ab@.-", "12.", "0123456789 -", "+1234567890 ().-a", "a1@.+ -:é\U0001f600(", "DE89370400440532013000 @tel:.", "4111 -1x"])
def test_base_spans_as_the_patterns_find_them(alphabet):
    rng = random.Random(alphabet)
    parts = [*alphabet, "a@b.cd", "192.168.0.1", "256.1.1.1", "+49 (30) 1234567", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, [3] * len(alphabet) + [1] * 7, k=rng.randint(0, 40)))
        assert base(text) == by_pattern(text), repr(text)


def test_what_the_parsers_add():
    assert found("write to jörg.müller@bücher.example today", "email") == ["jörg.müller@bücher.example"]
    assert found("call +1 (826) 555-4081 190.137.223.204 now", "phone") == ["+1 (826) 555-4081"]
    assert found("Tel.: 030 1234567, fax 030/7654321", "phone") == ["030 1234567", "030/7654321"] and found("hotel 1234567", "phone") == []
    assert found("order 12 4111 1111 1111 1111 07", "card") == ["4111 1111 1111 1111"] and found("1234 5678 9012 3456 78", "card") == []
    assert found("IBAN DE89 3704 0044 0532 0130 00.", "iban") == ["DE89 3704 0044 0532 0130 00"] == found("(DE89 3704 0044 0532 0130 00)", "iban")
    assert found("DE88 3704 0044 0532 0130 00", "iban") == found("XDE89370400440532013000", "iban") == []
    assert found("Konto Nr. 1234567 and account: 12-345-678", "account") == ["1234567", "12-345-678"] and found("accounts 1234567", "account") == []
    assert found("from 2001:db8:85a3::8a2e:370:7334, at 12:30:45 std::vector", "ip") == ["2001:db8:85a3::8a2e:370:7334"]
    assert found("see https://me:secret@host.example/x and https://host.example/", "url") == ["https://me:secret@host.example"]
    assert all(find_private(x) == [] for x in (None, "", "no data here", "a@b", "+12", "1.2.3", "12:30"))


def test_base_spans_stay_and_others_dont_cross_them():
    text = "tel +49 30 1234567 iban 4111 1111 1111 1111 mail a@b.cd é@b.cd"
    spans = find_private(text)
    assert [x[:3] for x in spans if x[3]] == by_pattern(text) and len(set(spans)) == len(spans)
    assert not [x for x in spans if not x[3] and x[0] in ("phone", "account", "card")]
    assert spans == sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))
    assert masked("to a@b.cd, 192.168.0.1") == "to [email], [ip]" and masked("") == "" and masked(None) is None


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "a@", "a@b.", "+1", "+1 ", ":", "a:", "://", "tel ", "DE8", "@", "é@é.", "1.2.3.4.5.6.7.8@x.yz "])
def test_time_is_linear_in_the_text(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    find_private(text)
    assert time.perf_counter() - began < 20
    assert base(text[:3000]) == by_pattern(text[:3000])


def test_rows(spark, tmp_path):
    texts = [None, "", "mail me: a@b.cd", "mail me: a@b.cd", "\U0001f600 192.168.0.1 4111 1111 1111 1111 +49 30 1234567", "x " * 50_000 + "é a@b.cd"]
    rows = [(i if i else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, private_spans int").withColumns({c: F.lit("x") for c in ("kind", "spans")})
    got = private_spans(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "kind", "spans", "private_spans"] and got.count() == 6
    assert private_spans(docs.limit(0)).count() == 0
    assert [r["text"] for r in mask_private(docs).where("doc_id in (1, 2)").orderBy("doc_id").collect()] == ["", "mail me: [email]"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    by_id = {r["doc_id"]: r for r in op12_find_private_data(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        want = by_pattern(text)
        digest = hashlib.sha256(",".join(":".join(map(str, x)) for x in want).encode()).hexdigest()
        r = by_id[i]
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(x[0] == k for x in want) for k in BASE_KINDS] and r["base_sha256"] == digest
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in find_private(text))
    assert luhn("4111111111111111") and not luhn("4111111111111112")
