"""Every query over the smallest tables: its contract's columns, and its SQL where it has one."""

import duckdb
import pytest

from vitrine.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_shingles component_id", "op2": "vec_id n_links component_id kept",
    "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id keep_id group_size kept text_sha256",
    "op7": "doc_id place n_chars candidate_sha256 score is_secret", "op8": "doc_id held_out score predicted",
    "op9": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10": "doc_id own_license own_score license inherited_from depth",
    "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    rows = [r.asDict() for r in out.collect()]
    table = "embeddings" if name.startswith("op2_") else "documents"
    con = duckdb.connect()
    for t in {table, "labels"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    if not name.startswith(("op5_", "op7_", "op11_")):
        assert len(rows) == con.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in SQL:
        result = con.execute(SQL[name])
        names = [d[0] for d in result.description]
        want = sorted(result.fetchall(), key=str)
        assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == want
