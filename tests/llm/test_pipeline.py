"""The corpus pipeline and its stages: edge rows, and exact and near stages against brute force."""

import hashlib

import pytest

import corpus_pipeline
from formloom.llm import bpe, exact, mixing, near, quality

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, _id int, _hash string, _text_hash string, row_key string, copy int, _words int, mix_key int"
TEXTS = [(None, "one text without an id at all"), (None, "another text without an id here"), (None, "another text without an id here"), (7, "first text of id seven stands here"), (7, "second text of id seven is this"), (9, None), (9, ""), (10, ""), (11, "nine " * 3000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en", None if n == 3 else "s", n, "h", "t", "k", 5, 6, 7) for n, (i, t) in enumerate(TEXTS)], COLUMNS)


@pytest.mark.parametrize("stage", [quality.stage_quality, exact.stage_exact_dedup, near.stage_near_dedup, mixing.stage_mixing])
def test_stage_on_odd_rows(spark, rows, stage):
    """Null and shared ids, clashing columns and empty tables: no row is taken for another, columns are as they came."""
    out = stage(spark, rows, SMALL)
    assert out.columns == rows.columns
    got = out.collect()
    assert all(r.copy == 5 and r.mix_key == 7 and r._text_hash == "t" for r in got)
    assert stage(spark, rows.where("1 = 0"), SMALL).count() == 0
    have = {(r.doc_id, r.text or "") for r in got}
    if stage in (exact.stage_exact_dedup, near.stage_near_dedup):
        assert len(got) == len(have)
        assert {t for _, t in have} == {t or "" for _, t in TEXTS}
    if stage is quality.stage_quality:
        assert len(got) <= len(TEXTS) and {(9, ""), (10, "")} <= have


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage_quality, exact.stage_exact_dedup, near.stage_near_dedup, mixing.stage_mixing, bpe.stage_byte_bpe]


def test_pipeline(spark, tmp_path):
    """All stages over the smallest tables: each works on what the one before kept, and its decision is the operator's."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()} if name != "byte_bpe" else None
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if before is not None:
            kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
            assert {*kept[name]} <= before
    last: dict[str, int] = {}
    for i, text in kept["quality"]:
        last[text] = max(i, last.get(text, -1))
    assert sorted(kept["exact_dedup"]) == sorted((i, t) for t, i in last.items())
    texts = dict(kept["near_dedup"])
    of = {i: near.weighed(*near.shingle_names([t.encode()])) for i, t in texts.items()}
    ids = sorted(of)
    assert not any(near._overlap(*of[a][1:], *of[b][1:]) >= near.SIMILARITY for n, a in enumerate(ids) for b in ids[n + 1 :])
    assert len(kept["mixing"]) == docs.count()
    final = corpus_pipeline.run(spark, SMALL).collect()
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in final)
    assert rows == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect())
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept["mixing"]}
    assert all(r.decoded_sha256 == digest[r.doc_id] for r in final)
