"""Near-duplicate classes against all pairs of the small documents table."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from formloom.llm import near

FOLDER = "/root/testdata/sf0.01"


def _all_pairs(texts: list[bytes], least: float) -> list[tuple[int, int]]:
    """Every pair of different texts whose multisets of shingles overlap by `least`, by counting shared shingles."""
    text, name, weight = near.weighed(*near.shingle_names(texts))
    size = np.bincount(text, weight, len(texts)).astype(int)
    by_name: dict[int, list[tuple[int, int]]] = {}
    for t, n, w in zip(text.tolist(), name.tolist(), weight.tolist()):
        by_name.setdefault(n, []).append((t, w))
    common: dict[tuple[int, int], int] = {}
    for members in by_name.values():
        for (a, v), (b, w) in combinations(members, 2):
            common[min(a, b), max(a, b)] = common.get((min(a, b), max(a, b)), 0) + min(v, w)
    return sorted((a, b) for (a, b), n in common.items() if n / (size[a] + size[b] - n) >= least)


def _classes(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    to = list(range(n))

    def root(i: int) -> int:
        while to[i] != i:
            i = to[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("deviations", [near.DEVIATIONS, None])
def test_near_against_all_pairs(spark, deviations):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    deal = random.Random(7)
    for i, t in rows[:400]:  # edited copies, most of them about as near as the bound
        words = t.split()
        for k in deal.sample(range(len(words)), max(1, len(words) // 45)) if len(words) > 60 else []:
            words[k] = f"edit{k}"
        rows.append((10_000 + i, " ".join(words)))
    texts = sorted({t.encode() for _, t in rows})
    place = {t: i for i, t in enumerate(texts)}
    pairs = _all_pairs(texts, near.SIMILARITY)
    known = _classes(len(texts), pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, bytes(r.class_hash)) for r in near.text_classes(docs, deviations).collect()}
    of = {place[t.encode()]: got[i] for i, t in rows}
    met = sum(of[a] == of[b] for a, b in pairs)
    print(f"recall of {len(pairs)} links with deviations {deviations}: {met / len(pairs):.4f}")
    assert len(pairs) > 100 and met >= 0.99 * len(pairs)
    first: dict[tuple, int] = {}
    assert all(known[i] == first.setdefault(c, known[i]) for i, c in sorted(of.items())), "texts in one class without links"


def test_hot_band_in_pieces(spark, monkeypatch):
    """Classes don't depend on how a band's members are cut in pieces."""
    monkeypatch.setattr(near, "PIECE", 2)
    base = [f"w{i}" for i in range(60)]
    rows = [(k * 10 + i, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :] + ["tail"] * i)) for k in range(0, 60, 6) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = _all_pairs([t.encode() for _, t in rows], near.SIMILARITY)
    known = _classes(len(rows), pairs)
    got = {r.doc_id: r.class_id for r in near.text_classes(docs, None).collect()}
    assert len(pairs) > 20
    assert [got[i] for i, _ in rows] == [rows[known[n]][0] for n in range(len(rows))]
