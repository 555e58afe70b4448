import hashlib
import uuid

from hypothesis import HealthCheck, given, settings, strategies as st

from vitrine.llm.exact_dedup import DigestIndex, digests, exact_dedup, without_copies


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex())
                   for r in exact_dedup(df).collect()], key=str)


def test_cases(table):
    rows = [(1, "a"), (2, "A"), (3, "a"), (4, None), (5, ""), (None, "a"), (6, "x" * 200_000), (7, "x" * 200_000),
            (8, "only"), (8, "only"), (None, "alone")]
    assert found(table(rows)) == brute(rows)


def test_empty_table(table):
    assert exact_dedup(table([])).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["", "a", "b", "ab", None])), max_size=15))
def test_against_brute_force(table, rows):
    assert found(table(rows)) == brute(rows)


def test_hot_group_and_light_groups(table):
    rows = [(i, "same") for i in range(2000)] + [(i, f"t{i % 1500}") for i in range(2000, 4000)]
    assert found(table(rows)) == brute(rows)


def test_index_keeps_first_owner_and_appends_only_new(spark, table):
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=4)
    assert index.add(digests(table([(1, "a"), (2, "b"), (3, "a")]))).count() == 2
    assert index.add(digests(table([(9, "a"), (8, "c")]))).count() == 1
    assert sorted(r["keep_id"] for r in index.rows().collect()) == [2, 3, 8]
    plan = index.rows().join(index.rows().select("digest").hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    index.drop()


def test_index_writes_one_file_per_bucket_and_append(spark, table, monkeypatch):
    frame = type(table([]))
    whole = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *keys: whole(df, max(n, 31), *keys))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=4)
    index.add(digests(table([(k, f"t{k}") for k in range(400)])))
    assert len(index.rows().inputFiles()) <= 4 and index.rows().count() == 400
    index.drop()


def test_rows_that_stay_keep_all_columns(table):
    df = table([(1, "a"), (2, "a"), (2, "a"), (None, "n"), (None, "n"), (5, None), (4, "")])
    out = without_copies(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(2, "a"), (5, None), (None, "n")]


def test_inner_names_may_clash(table):
    df = table([(1, "a"), (2, "a"), (3, "b")]).withColumnsRenamed({"block": "id0_of", "word": "no_id_of", "label": "digest_of"})
    assert sorted(r["doc_id"] for r in without_copies(df).collect()) == [2, 3]
