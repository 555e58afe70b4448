import hashlib
import random

import pytest

from vitrine.llm import fill_in_middle as fim


def brute(key, text, rate=90, spm=20, seed="1"):
    text = text or ""
    n = len(text)
    hexa = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexa[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return key, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [(k, t) for k, t in enumerate([
    "", None, "a", "ab", "é", "日本語のテキスト", "<P>", "a<M>b", "<", "<S", "<<S><", "x<P", "P>S>M>", "<P<S<M", "🙂🙃" * 9, "\n", "é" * 5])]


def rows():
    rnd = random.Random(5)
    some = ["".join(rnd.choice("ab<SPM> é日") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    long = ["a" * 4096, "é" * 4096, "b" * 4097, "xé日🙂" * 5000, "<" * 9000, "<S" * 6000]
    return (ROWS + [(100 + k, t) for k, t in enumerate(some)] + [(400 + k, t) for k, t in enumerate(long)]
            + [(400, "a" * 4096), (400, "other"), (None, "no id"), (None, "no id"), (-5, "negative")])


def test_texts_and_digests(table):
    docs = table(rows())
    got = sorted((tuple(r) for r in fim.fim_texts(docs).collect()), key=str)
    want = sorted((brute(k, t) for k, t in rows()), key=str)
    assert got == want
    restored = fim.digests(fim.restoring(fim.in_order(fim.fim_pieces(docs)))).collect()
    assert sorted((tuple(r) for r in restored), key=str) == sorted(
        ((*brute(k, t)[:5], sha(brute(k, t)[5]), sha(t or "")) for k, t in rows()), key=str)


def test_every_form_with_marks_across_pieces(table, monkeypatch):
    docs = table([(k, t) for k, t in enumerate(["ab<S", "<<<", "S>P>", "x" * 50, "é<é"] * 8)])
    for settings in (fim.Settings(100, 0, "q"), fim.Settings(100, 100, "q"), fim.Settings(0, 0, "q")):
        out = fim.digests(fim.restoring(fim.in_order(fim.fim_pieces(docs, settings=settings)))).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in out:
            want = brute(r["doc_id"], texts[r["doc_id"]], settings.rate, settings.spm_rate, "q")
            assert (r["form"], r["output_sha256"], r["restored_sha256"]) == (want[2], sha(want[5]), sha(texts[r["doc_id"]]))


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_cutter_takes_any_split(form):
    rnd = random.Random(form)
    for _ in range(300):
        part = {p: "".join(rnd.choice("<SPM>a") for _ in range(rnd.randint(0, 6))) for p in fim.PARTS}
        if any(m.decode() in "".join(part.values()) for m in fim.MARKS.values()):
            continue
        out = b"".join(fim.MARKS[p] + part[p].encode() for p in fim.FORMS[form])
        cutter, found = fim._Cutter(form), {0: b"", 1: b"", 2: b""}
        while out:
            size = rnd.randint(1, 4)
            for k, piece in cutter.add(out[:size]):
                found[k] += piece
            out = out[size:]
        for k, piece in cutter.end():
            found[k] += piece
        assert [found[k].decode() for k in range(3)] == [part[p] for p in fim.PARTS]


def test_one_shuffle_and_empty_table(table):
    out = fim.digests(fim.restoring(fim.in_order(fim.fim_pieces(table([(1, "a")])))))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert fim.digests(fim.restoring(fim.in_order(fim.fim_pieces(table([]))))).count() == 0
