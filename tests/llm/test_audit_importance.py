"""The filter audit and the importance draw against plain Python, on odd rows and by their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from formloom.llm import audit, importance

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and long texts, ties, copies, repeated rows, null ids, and a column whose name clashes with an inner one.
ODD = [
    (1, "", "en"), (2, None, None), (3, " \n ", "en"), (4, "same same text", "de"), (5, "same same text", "de"), (5, "same same text", "de"),
    (6, " ".join(f"w{i}" for i in range(150)), "en"), (7, " ".join(f"w{i}" for i in range(150)), "fr"), (8, "Z" * 20000, "en"), (9, "x " * 30000, "en"),
    (10, "A B C " * 40 + "#", "en"), (None, "same same text", "en"), (None, "no id at all", "fr"), (11, "日本語 ＡＢ été " * 50, None), (12, " lead and trail ", "en"),
]
LABELS = [(6, 1, 0), (7, 1, 1), (7, 0, 0), (9, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 0) for r in ODD], "doc_id long, text string, lang string, text_hash string, mask int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audit_brute_force():
    docs = []
    for i, text, lang in ODD:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in ODD),
        }
        mine = [x for x in LABELS if i is not None and x[0] == i]
        docs.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                own = [d for d in docs if d[0] == part]
                before = [d for d in own if not d[1] & set(order[: step - 1])]
                removed = [d for d in before if name in d[1]]
                shapley[part, name] += len(removed)
                out[part, order, step] = (
                    len(before) - len(removed), len(removed), sum(name in d[1] for d in own) - len(removed), sum(d[1] == {name} for d in own),
                    sum(d[2] for d in removed), sum(d[3] for d in removed),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(odd, labels):
    got = audit.audited(audit.flagged_documents(odd, labels), list("ABCDE")).collect()
    expected = audit_brute_force()
    assert len(got) == len(expected)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == expected


def test_audit_large_group(spark, monkeypatch):
    """Groups joined by broadcast and by their hash give the same; null ids never repeat."""
    rows = [(i if i % 5 else None, f"text {min(i, 20) % 7}") for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("doc_id", "unhex(md5(text)) AS text_hash")
    expected = sorted((str(i), i is not None and any(j is not None and j < i and u == t for j, u in rows)) for i, t in rows)
    for share in (1, 4, 1000):
        monkeypatch.setattr(audit, "HOT_SHARE", share)
        assert sorted((str(r.doc_id), r.repeats) for r in audit.repeats_smaller(df).collect()) == expected


def test_audit_empty(spark, odd, labels):
    assert audit.audited(audit.flagged_documents(odd.limit(0), labels), list("ABCDE")).count() == 0
    assert audit.audited(audit.flagged_documents(odd, labels.limit(0)), list("ABCDE")).where("good_lost + toxic_lost > 0").count() == 0


def importance_brute_force(docs, target, ngram, buckets, percent, min_words):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs], len(words)

    s, t = (Counter(b for text in texts for b in features(text)[0]) for texts in ([x[1] for x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found, n = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((str(r[0]), *r[1:4], ranks.get(id(r))) for r in rows)


@pytest.mark.parametrize(("ngram", "percent", "min_words"), [(1, 10, 20), (1, 50, 0), (2, 100, 1), (3, 34, 2)])
def test_importance(spark, odd, ngram, percent, min_words):
    docs = [(i, t) for i, t, _ in ODD if (i, t) != (None, "same same text")] + [(100 + i, f"word{i % 7} mill road lake {i} " * 6) for i in range(40)]
    target = ["mill lake", None, "", "the W1 w2 W3"]
    extra = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, score int")
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resampled(extra, wanted, ngram=ngram, percent=percent, min_words=min_words).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == importance_brute_force(docs, target, ngram, 10_000, percent, min_words)


def test_importance_many_ranges(spark, monkeypatch):
    """Ranks run on over ranges and blocks; equal scores go by id."""
    monkeypatch.setattr(importance, "parts_of", lambda n, *_: 5)
    monkeypatch.setattr(importance, "BLOCK_ROWS", 7)
    rows = [(i, f"word{i % 3} " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    got = importance.resampled(docs, wanted, percent=90).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == importance_brute_force(rows, ["word1"], 1, 10_000, 90, 20)


def test_importance_empty(spark, odd):
    wanted = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    assert importance.resampled(odd.limit(0), wanted).count() == 0
    assert all(r.weight == 0 or r.n_features for r in importance.resampled(odd, wanted.limit(0)).collect())
