"""Every column of the fingerprints from the texts and the fingerprints themselves, in plain Python, with one range of ids and with many."""

import hashlib

import pytest

from formloom.llm import fingerprint

TEXTS = ["", None, "a", "same words here", "same words here", "x" * 5000, "日本語の文章です。 " * 20, "Ünïcödé 😀 text " * 9, " \n ", "the mill by the road " * 40]
ROWS = [(i * 7 % 40, f"{TEXTS[i % len(TEXTS)] or ''} part {i}" if i > 9 else TEXTS[i]) for i in range(37)] + [(None, "no id"), (None, None), (3, "an id again"), (3, "an id again")]


def marked(text):
    """Distinct hashes of anchors, and links of neighbours with their distance."""
    found = [(h, int(p)) for h, p in (x.split(":") for x in text.split(" "))]
    return {h for h, _ in found} | {(a, b, q - p) for (a, p), (b, q) in zip(found, found[1:])}


def alike(a, b):
    a, b = marked(a), marked(b)
    return 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("rows_per_range", [2000, 4])
def test_every_column(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", rows_per_range)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, anchors string, key int").repartition(5)
    got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    ordered = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    own = {}
    for r in fingerprint.fingerprints(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(ordered)], "doc_id long, text string")).collect():
        own[ordered[r.doc_id][1]] = r.fingerprint
    expected = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[text], text, after))
    expected.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert len(got) == len(expected)
    for r, (i, n, sha, print_, text, after) in zip(got, expected):
        assert (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.n_anchors) == (i, n, sha, print_, len(print_.split(" ")))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(alike(print_, own[after]))
