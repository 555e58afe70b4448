import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from vitrine.llm.pii import BASE, KINDS, base_spans, find, luhn, mod97, pii_spans, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    """The contract's patterns as they stand."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(PATTERNS[kind], text)
                  if checks(kind, m.group()))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+(0) 19é", max_size=40))
def test_base_spans_are_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_base_spans_on_denser_texts():
    rnd = random.Random(2)
    bits = ["a@b.c", "@", "x.y", "+1 (743) 555-3824", "+", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "79927398713", "5105105105105100", "00012", " ", "é", "-", "--", "a_b%c+d@e-f.g.h", "999999999999999999999", "001.002.3.255"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9)))
        assert base_spans(text) == brute(text), text


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in find(text)]


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433") and not mod97("XX82WEST12345698765432")


def test_further_kinds():
    assert kinds("to DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("to DE89 3704 0044 0532 0130 01 AND MORE") == []
    assert kinds("her SSN is 078-05-1120.") == [("national_id", "078-05-1120")]
    assert kinds("part 078-05-1120 of") == []
    assert kinds("Tel. 0151 2345678 heute") == [("local_phone", "0151 2345678")]
    assert kinds("die 0151 2345678 heute") == []
    assert kinds("at 2001:db8::ff00:42:8329 now") == [("ipv6", "2001:db8::ff00:42:8329")]
    assert kinds("at 12:30:45 now, std::vector") == []
    assert kinds("write jane.doe (at) example (dot) org") == [("masked_email", "jane.doe (at) example (dot) org")]
    assert kinds("geboren 24.12.1980 in") == [("birth_date", "24.12.1980")]
    assert kinds("geboren 34.12.1980 in") == [] and kinds("on 24.12.1980 in") == []


def test_context_moves_the_score_and_base_spans_stay():
    score = {t: find(t)[0][3] for t in ("card 4111111111111111", "x 4111111111111111", "order 4111111111111111")}
    assert score["card 4111111111111111"] > score["x 4111111111111111"] > score["order 4111111111111111"]
    both = find("Konto DE89370400440532013000, +49 (151) 234-5678 und 1.2.3.4")
    assert [k for k, *_ in both] == ["iban", "phone", "ip"]


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" + "(" * 300_000, "a.b@" * 80_000,
                                  "@a" * 100_000, "A1" * 150_000, ":" * 300_000, "a:" * 100_000, "DE89" * 70_000, "1.1.1.1 " * 20_000])
def test_time_grows_with_the_text(text):
    began = time.time()
    find(text)
    assert time.time() - began < 8


def test_rows(table):
    rows = [(1, "mail a@b.co"), (1, "mail a@b.co"), (None, "é 1.2.3.4"), (2, None), (3, ""), (4, "日本 " * 100_000 + "x@y.z")]
    out = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in pii_spans(table(rows)).collect()}
    assert out == {(1, (("email", 5, 11),)), (None, (("ip", 2, 9),)), (2, ()), (3, ()), (4, (("email", 300_000, 300_005),))}
    assert pii_spans(table(rows)).count() == 6 and pii_spans(table([])).count() == 0


def test_redact_keeps_the_other_columns(table):
    df = table([(1, "mail a@b.co and 1.2.3.4!"), (2, None)])
    out = redact(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "mail [email] and [ip]!", 2: None}


def test_query_digest(spark):
    import duckdb

    from vitrine.llm.pii import op13_pii

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    for r in op13_pii(spark, sf_dir).collect():
        want = brute(texts[r["doc_id"]] or "")
        joined = ",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[1] == j for w in want) for j in range(4)]
        assert {s for s in joined.split(",") if s} <= set(r["spans"].split(",")) and KINDS[:4] == BASE
