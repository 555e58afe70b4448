import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from vitrine.llm import secrets


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage got and gave."""
    rnd = random.Random(7)
    folder = tmp_path_factory.mktemp("tables")
    plain = ["".join(rnd.choice(["ta", "re", "mi", "son", "lu", "pe", "dor"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for key in range(400):
        text = rnd.choices(plain, k=rnd.randint(8, 60))
        toxic = key % 4 == 0
        if toxic:
            text[1:1] = ["blockhead", "nitwit"]
        if key % 9 == 1:
            text.append(f'token = "{rnd.getrandbits(160):040x}" end')
        docs.append((key, " ".join(text)))
        labels.append((key, 1, int(toxic)))
    docs += [(1000 + k, docs[4 * k + 1][1]) for k in range(40)]  # copies
    docs += [(2000 + k, docs[4 * k + 2][1] + " tail") for k in range(40)]  # near copies
    docs += [(3000, None), (3001, ""), (3002, "word " * 9000), (None, "without id here and alone")]
    spark.createDataFrame([(i, t, "xx", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(docs)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.materialize(stage(spark, frame, str(folder)), "test")
        out.append((frame, got))
        frame = got
    return out, str(folder)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


def test_columns_stay(stages):
    for got, out in stages[0][:-1]:
        assert out.columns == got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    got, out = map(pairs, stages[0][0])
    assert key(out) == key([r for r in got if "blockhead" not in (r[1] or "")])


def test_one_of_equal_texts_stays(stages):
    got, out = map(pairs, stages[0][1])
    keep = {}
    for i, t in got:
        old = keep.get(t or "", (None, t))
        keep[t or ""] = max(old, (i, t), key=lambda r: -1 if r[0] is None else r[0])
    assert key(out) == key(keep.values())


def test_one_of_near_copies_stays(stages):
    got, out = map(pairs, stages[0][2])
    near = {i: c for i, _, c in brute.jaccard([r for r in got if r[0] is not None])}
    assert key(out) == key([r for r in got if r[0] is None or near[r[0]] == r[0]])
    assert len(out) < len(got)


def test_secrets_are_masked_and_documents_stay(stages):
    got, out = map(pairs, stages[0][3])
    import re

    want = [(i, re.sub(r'(?<=token = ")[0-9a-f]{40}', secrets.MASK, t) if t else t) for i, t in got]
    assert key(out) == key(want) and key(out) != key(got)


def test_every_token_is_packed(stages):
    got, out = stages[0][4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in pairs(got)}
    have = {}
    for r in out.collect():
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert have == want


def test_run_is_all_stages_and_registered(spark, stages):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    names = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert corpus_pipeline.run(spark, stages[1]).count() == stages[0][4][1].count()
