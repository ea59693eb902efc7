"""What an executor holds while texts are encoded: one Python worker for a task, and matches of a few texts at a time."""

import hashlib

import public_tokenizers

from formloom.llm import bpe

ROWS = [(None, "no id"), (1, None), (2, ""), (3, "the cat " * 400), (3, "  it's\n\n the  end \t"), (4, "x" * 3000 + " überraschend " + "ab" * 70), (5, "日本 é \U0001f600 Ɤ <|endoftext|>"), *((10 + i, f"row {i} has {i * i} words") for i in range(50))]


def test_stage_has_one_worker_for_a_task(spark):
    """Ids are decoded and hashed where they are put together: no other Python stage follows in the same task."""
    import tiktoken

    out = bpe.stage_byte_bpe(spark, spark.createDataFrame(ROWS, "doc_id long, text string"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.partition("FlatMapCoGroupsInArrow")[0]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := own.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in ROWS]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_slices(monkeypatch):
    """Texts are matched a few at a time, in order and whole, and no word gets lost between."""
    import pyarrow as pa

    texts = [t or "" for _, t in ROWS]
    rows = pa.Table.from_batches([pa.record_batch({"doc_id": list(range(a, a + len(x))), "text": x}) for a in range(0, len(texts), 20) if (x := texts[a : a + 20])]).slice(1)
    whole = sorted({w.encode() for t in texts[1:] for w in bpe._finder(public_tokenizers.PATTERN)(t)})
    for size in (1, 40, 100, 1 << 30):
        monkeypatch.setattr(bpe, "MATCH_BYTES", size)
        parts = [x.column("text").to_pylist() for x in bpe._slices(rows)]
        assert [t for x in parts for t in x] == texts[1:]
        assert all(len(x) == 1 or sum(len(t.encode()) for t in x) <= size for x in parts) and (len(parts) > 1) == (size < 1 << 30)
        assert bpe._distinct(rows, public_tokenizers.PATTERN) == whole
        for x in bpe._slices(rows):
            found, matches, pieces, sizes = bpe._pieces(x.column("text"), public_tokenizers.PATTERN)
            ends, at = [0, *matches.cumsum().tolist()], iter(pieces.tolist())
            got = [[w for _ in range(n) for p in [next(at)] for w in found[ends[p] : ends[p + 1]]] for n in sizes.tolist()]
            assert got == [bpe._finder(public_tokenizers.PATTERN)(t) for t in x.column("text").to_pylist()]


def test_ranks_of_pairs_merge_alike():
    """Long words need no second table of merges beside the ranks of pairs."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    merges = bpe.merge_table(ranks)
    ranked = bpe._Ranked({pair: rank for pair, (rank, _) in merges.items()})
    for word in (b"", b"a", b"ab" * 90, bytes(range(256)), " überraschend".encode() * 20):
        symbols = [ranks[bytes([b])] for b in word]
        assert bpe.merge_symbols(symbols, ranked) == bpe.merge_symbols(symbols, merges)
