"""Training-data operators against brute force, libraries and edge cases."""

import hashlib

import pytest

from formloom.llm import bpe, chat, exact, fingerprint, licence, mixing, near, quality, substring

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, " \n ", "a", "same text", "same text", "x " * 400, "y" * 20000, "日本語 <|endoftext|> it's 123 ²", " ".join(f"w{i}" for i in range(120))]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and a column whose name clashes with an inner one."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", 0, "clash") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id", "en", "s", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string")


def test_exact(odd):
    got = exact.exact_groups(odd).collect()
    assert len(got) == 12 and sum(r.kept for r in got if r.group_size > 1) == 2
    assert {r.keep_id for r in got if r.doc_id in (4, 5)} == {5}
    assert sorted(map(tuple, exact.exact_groups(odd, range_bits=1 << 13).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing(odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == 12 and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.budget), []).append(r.taken)
    assert all(sum(v) == k[1] for k, v in by.items())


def test_bpe(odd):
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {i: t or "" for i, t in enumerate(ODD)} | {None: "no id"}
    for r in bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path).collect():
        assert r.ids == own.encode_ordinary(texts[r.doc_id]) and r.decoded.decode() == texts[r.doc_id]
    for r in bpe.digests(bpe.encode(odd, path, public_tokenizers.PATTERN), path).collect():
        ids, sha = own.encode_ordinary(texts[r.doc_id]), lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in bpe.count_tokens(odd, public_tokenizers.path("word_bpe_49k.json")).collect():
        assert r.n_tokens == len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_word_pattern():
    """The fast pattern cuts every assigned character as the other engine does, beside letters, spaces and others of its kind."""
    import unicodedata

    import regex

    chars = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]  # assigned in both
    spaced = public_tokenizers.PATTERN.replace(r"(?!\S)", f"(?![^{bpe.SPACES}])").replace(r"[^\s", "[^" + bpe.SPACES).replace(r"\s", f"[{bpe.SPACES}]")
    for text in ("".join(chars), " ".join(chars), "".join(c + "a" for c in chars), "".join(" é" + c for c in chars), "it's  'tis we'Ll aªb ñµ"):
        assert bpe._finder(public_tokenizers.PATTERN)(text) == regex.findall(spaced, text)


def _put_together(texts, pattern, size=1):
    import pyarrow as pa

    found, matches, pieces, sizes = bpe._pieces(pa.chunked_array([texts[i : i + size] for i in range(0, len(texts), size)], pa.string()), pattern)
    ends = [0, *matches.cumsum().tolist()]
    words, at = [found[a:b] for a, b in zip(ends, ends[1:])], iter(pieces.tolist())
    return found, [[w for _ in range(n) for w in words[next(at)]] for n in sizes.tolist()]


def test_pieces():
    """Pieces between spaces give the matches of whole texts, and a word that repeats is matched once."""
    import random

    r, spaces = random.Random(5), list("\t\n\x0b\x0c\r \x1c\x1f\x85\xa0\u1680\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000")
    texts = ["".join(r.choice([" "] * 12 + ["a", "Bé", "'s", "'", "1²", "_", "。", "日", "\U0001f600", "e\u0301", "\ua7cb", r.choice(spaces)]) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "  ", "a", " a", "a ", "a  ", "  a", "\n a", "a \n", "a\n b", "a \nb", "don't 's 's", *(f"a {s} b {s}c {s}" for s in spaces), *(f"{s} b{s} c" for s in spaces), *spaces]
    find = bpe._finder(public_tokenizers.PATTERN)
    for size in (1, 7, len(texts)):
        assert _put_together(texts, public_tokenizers.PATTERN, size)[1] == [find(t) for t in texts]
    for pattern in (r"\p{L}+|\s+|[^\s\p{L}]+", r"'\s|\p{N}" + bpe.SPACED, public_tokenizers.PATTERN + "|x"):
        assert _put_together(texts, pattern, 7)[1] == [bpe._finder(pattern)(t) for t in texts]
    for text, n, distinct in (("it is " * 1000 + "it", 2001, 3), ("it  is \n" * 1000, 4999, 9)):
        found, (got,) = _put_together([text], public_tokenizers.PATTERN)
        assert got == find(text) and len(got) == n and len(found) == distinct


def test_joined_entries():
    import pyarrow as pa

    table, lists = pa.array([b"a", b"", b"\xff"], pa.binary()), [[0, 2], [], None, [1], [2] * 400_000, [0]]
    ids = pa.array(lists, pa.list_(pa.int32()))
    for part in (ids, ids.slice(1), ids.slice(2, 2), ids.slice(6)):
        want = [b"-".join(table[i].as_py() for i in x or []) for x in part.to_pylist()]
        assert [bytes(x.as_buffer()) for x in bpe.joined_entries(table, part, b"-")] == want
    for outside in (3, -1):
        with pytest.raises(IndexError):
            list(bpe.joined_entries(table, pa.array([[outside]], pa.list_(pa.int32())), b""))


def test_merge_word():
    """Short words merge alike by either way."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    merges = bpe.merge_table(ranks)
    pairs = {p: r for p, (r, _) in merges.items()}
    for word in (b"", b"a", b"aaaaaaaaaaa", b"tiontiontion", " überraschend".encode(), b" thestherethan", bytes(range(64))):
        symbols = [ranks[bytes([b])] for b in word]
        assert bpe.merge_word(list(symbols), pairs) == bpe.merge_symbols(list(symbols), merges)


def test_substring(odd, spark):
    more = spark.createDataFrame([(100 + i, f"start{i} " + " ".join(f"w{k}" for k in range(i, 115)) + f" end{i}") for i in range(6)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").where("doc_id IS NOT NULL").distinct().union(more)
    expected = substring.kept_brute_force({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring.dedup_substrings(docs, chars=2000).collect()}
    assert got == expected and sum(v[1] for v in expected.values()) > 0


def test_near(odd, spark):
    base = [f"w{i}" for i in range(200)]
    copies = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (20, 90, 150)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(200 + i, t) for i, t in enumerate([" ".join(base), *copies])], "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert [got[200 + i] for i in range(4)] == [200] * 4 and got[5] == 4 and got[3] == 3


def test_near_star(spark):
    """Edited copies of a text whose pairs are mostly below the bound are one class through it; a null id takes part."""
    base = [f"w{i}" for i in range(200)]
    edits = [" ".join(base[:k] + ["x"] + base[k + 1 : k + 60] + ["y"] + base[k + 61 :]) for k in range(3, 130, 9)]
    rows = [*enumerate(edits), (None, " ".join(base)), (900, "alone " * 9)]
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r.class_id for r in got if r.doc_id != 900}) == 1


def test_near_shared_ids(spark):
    """Different texts without an id, or with the same one, all stay; near copies of each of them go."""
    text = lambda k, new="": " ".join(f"{k}w{i}" for i in range(200)) + new
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("b", " x")), (9, text("d", " x")), (9, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near.stage_near_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[i] for i in (0, 1, 3, 4, 7)], key=str)
    got = near.near_classes(docs).collect()
    assert len(got) == len(rows) and len({r.class_hash for r in got}) == 5


def test_quality_stage_shared_ids(spark, tmp_path):
    """A rejected row takes no other row without an id, or with the same id, along."""
    good = [f"the {a} of the {b} is near the {c}" for a in ("mill", "road", "lake") for b in ("town", "river", "sea") for c in ("inn", "barn", "well")]
    spark.createDataFrame([(i, 1, 0) for i in range(len(good))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = [(None, "zq#j x%v kk~ qqw"), (None, "the road of the town"), (50, "qx$z vvk} jjq[ zwx"), (50, "the lake of the river")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in [*enumerate(good), *more]], "doc_id long, text string, lang string")
    kept = {r.text for r in quality.stage_quality(spark, docs, str(tmp_path)).collect()}
    assert {t for _, t in more} & kept == {"the road of the town", "the lake of the river"}


def test_near_partners(spark):
    """Partners of one text fall into groups of a bounded size, each pair once."""
    pairs = spark.range(1000).selectExpr("id % 2 AS a", "id AS b")
    got = near._dealt(pairs).groupBy("a", "salt").count().collect()
    assert sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) <= near.PARTNERS


def test_quality(odd, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 10, 2)], "doc_id long, quality int, toxic int")
    got = quality.classified(odd, labels).collect()
    assert len(got) == 12 and all(r.perplexity is None or r.perplexity > 0 for r in got)
    model = quality.probabilities(spark.createDataFrame([("en", (97 << 48) | (98 << 32) | (99 << 16) | c, n) for c, n in ((100, 3), (101, 1), (102, 0))], "lang string, gram long, n long"))
    assert 0.5 < sum(r.p for r in model.collect()) < 1.0001


def test_quality_held_out(spark):
    """A trusted text is scored as if it and its fold were not trusted, so a text that is unlike all others stands out."""
    texts = [f"the {a} of the {b} is near the {c} and far" for a, b, c in zip("mill road lake tree house gate wall bird".split(), "town river sea field hill wood farm sky".split(), "bridge church inn barn well pond yard fence".split())]
    texts.append("qzx jvk wqp xxz kjq vvz qqj zxk pqw")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.perplexities(docs, docs.select("doc_id")).collect()}
    fold = [quality.xxhash.xxh3_64_intdigest(t.encode()) % quality.FOLDS for t in texts]
    others = docs.where(docs.doc_id.isin([i for i, f in enumerate(fold) if f != fold[8]]))
    alone = {r.doc_id: r.perplexity for r in quality.perplexities(docs, others.select("doc_id")).collect()}
    assert all(r.trusted for r in got.values()) and got[8].perplexity == pytest.approx(alone[8], rel=1e-3)
    assert got[8].perplexity > 2 * max(got[i].perplexity for i in range(8))


def _anchors_by_hand(text: str) -> list[int]:
    """Positions of the closed syncmers of a text's tokens, straight from the definition."""
    import regex

    tokens = regex.findall(r"[!-~\u00a1-\u024f]{1,4}+", text)
    names = [0] * (fingerprint.K - 1) + [_murmur(t.encode()) for t in tokens]
    inner = [_murmur_ints(names[i : i + fingerprint.S]) for i in range(len(names) - fingerprint.S + 1)]
    size = fingerprint.K - fingerprint.S + 1
    windows = [inner[i : i + size] for i in range(len(inner) - size + 1)]
    return [i - (fingerprint.K - 1) for i, w in enumerate(windows) if min(w[0], w[-1]) <= min(w[1:-1])]


def _mix(h: int, k: int) -> int:
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
    h ^= k
    return ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF


def _ended(h: int, n: int) -> int:
    h ^= n
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _murmur(data: bytes, seed: int = 42) -> int:
    """Spark's hash() of one string: Murmur 3, the last bytes each a word of its own, signed."""
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = _mix(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = _mix(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    return _ended(h, len(data))


def _murmur_ints(values: list[int]) -> int:
    h = 42
    for v in values:
        h = _ended(_mix(h & 0xFFFFFFFF, v & 0xFFFFFFFF), 4)
    return h


def test_fingerprint(odd, spark):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    texts = ["The mill stands by the river and grinds the corn of the valley; in winter it rests.", "word " * 30, "short", "Ünïcode wörds über alles, naïve façade"]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in rows.select("text", fingerprint.anchors(chat.F.col("text")).alias("a")).collect():
        assert [x.pos for x in r.a] == _anchors_by_hand(r.text)


def test_fingerprint_of_any_length(spark):
    """No length decides how a text is read: each text is about as near to three quarters of itself as it is long enough."""
    words = [f"w{i * 7919 % 1000}x" for i in range(400)]
    rows = [(n, " ".join(words[:n]), " ".join(words[: n * 3 // 4])) for n in range(20, 400, 20)]
    marks = lambda c: fingerprint.marks(fingerprint.anchors(chat.F.col(c)))
    got = spark.createDataFrame(rows, "n int, a string, b string").select("n", fingerprint.likeness(marks("a"), marks("b")).alias("near")).collect()
    assert all(0.7 < r.near < 0.95 for r in got)
    moved = spark.createDataFrame([(" ".join(words), "new words come first " + " ".join(words))], "a string, b string")
    assert moved.select(fingerprint.likeness(marks("a"), marks("b")).alias("near")).first().near > 0.9


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a\\<|im_end|>\n"), (1, 1, "assistant", None), (None, 0, "x\ny", "t")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: [tuple(x) for x in r.t] for r in chat.format_turns(chat.canonical_turns(rows)).select("conv_id", chat.read_turns(chat.F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("user", "a\\<|im_end|>\n"), ("assistant", "")], None: [("x\ny", "t")]}


def test_chat_layouts(spark):
    """Each declared layout comes to the same turns, by its schema and, where it is a whole conversation, as JSON."""
    import json

    say = [("user", "ask"), ("assistant", "answer")]
    records = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in say]}, "share": {"conversations": [{"from": "human", "value": "ask"}, {"from": "gpt", "value": "answer"}]},
        "instruction": {"instruction": "ask", "input": "", "output": "answer"}, "short_instruction": {"instruction": "ask", "output": "answer"}, "prompt": {"prompt": "ask", "completion": "answer"},
        "system_prompt": {"system": "", "prompt": "ask", "completion": "answer"}, "question": {"question": "ask", "answer": "answer"}, "prompt_response": {"prompt": "ask", "response": "answer"},
    }
    assert {*records, "rows"} == {*chat.LAYOUTS}
    for name, record in records.items():
        df = spark.read.json(spark.createDataFrame([(json.dumps({"conv_id": 1, **record}),)], "value string").rdd.map(lambda r: r.value))
        assert chat.layout_of(df) == name
        assert [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()] == say, name
    lines = [(i, json.dumps(r), "x") for i, r in enumerate(records.values())] + [(90, "not json", "x"), (91, None, "x")]
    got = chat.json_turns(spark.createDataFrame(lines, "conv_id long, record string, parsed string").drop("parsed")).orderBy("conv_id", "turn").collect()
    assert [(r.role, r.text) for r in got] == say * len(records)


def test_licence(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.\nother"), (2, "His driving license was renewed in May."), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.families for r in licence.licences(docs, licence.train(spark)).collect()} == {1: "mit", 2: "", 3: ""}


#: Notices that no template or phrase of the training has, with their families, and prose that shares words with notices.
UNSEEN = [
    ("gpl", "You can redistribute it under version 2 of the GNU General Public License; see the file COPYING."), ("mit", "Dieses Paket steht unter der MIT-Lizenz."), ("mit", "Free of charge, any person obtaining a copy of this software may deal in it without restriction, including the rights to use, copy, modify, merge and publish."),
    ("gpl", "GNU General Public License applies to every file here."), ("mit", "This library is\nreleased under the terms\nof the MIT License"), ("apache-2.0", "Contributions are accepted under Apache License 2.0 terms."), ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by", "Text is available under the Creative Commons Attribution License; additional terms may apply."), ("mpl-2.0", "This file is made available under the Mozilla Public License v2."), ("public-domain", "The author has dedicated this text to the public domain under CC0."),
    ("cc-by-sa", "Content is available under CC BY-SA 4.0 unless otherwise noted."), ("lgpl", "The library may be used under the GNU Lesser General Public License version 3."), ("cc-by-nc", "The data set is licensed CC BY-NC 4.0, for noncommercial research."),
]
PROSE = [
    "The license plate of the car was found under the bridge.", "The university library opened a new hall to the public.", "He is licensed to practise medicine in two states.", "A general strike was called by the union of public workers.", "The creative director released a statement about the terms.",
    "Software is distributed to the branch offices each month.", "This program is on television every day.", "Permission to land was granted to the pilot.", "Please retain the receipt as notice of purchase.", "The work was published in version two by the author.", "Mozilla hired three engineers for the browser.",
    "The commons debated the bill at length.", "Attribution of the painting to the master is disputed.",
]


def test_licence_unseen(spark):
    rows = [*enumerate(t for _, t in UNSEEN), *((100 + i, t) for i, t in enumerate(PROSE))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS row", "'y' AS family")
    got = {r.doc_id: r.families for r in licence.licences(docs, licence.train(spark)).collect()}
    right = sum(got[i] == f for i, (f, _) in enumerate(UNSEEN))
    alarms = sum(got[100 + i] != "" for i in range(len(PROSE)))
    print(f"unseen notices named: {right} of {len(UNSEEN)}; false alarms: {alarms} of {len(PROSE)}")
    assert right >= 10 and alarms <= 1


def test_licence_in_prose(spark):
    """A notice is found whatever shares its line; prose about licences is not one."""
    prose = "The tool reads a folder of files and writes a table of their sizes beside them."
    mit = " ".join(licence.TEMPLATES["mit"])
    bare = prose.rstrip(".").lower()
    texts = {1: f"{prose} Released under the MIT License.", 2: f"{prose * 300} Licensed under the GPL version 3. {prose * 300}", 3: mit, 4: f"{bare} {bare} Distributed under the BSD 3-Clause License {bare} {bare}", 5: f"{prose} His driving license was renewed in May. {prose}", 6: f"Released under the MIT License. {prose} Licensed under CC BY 4.0."}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licence.licences(docs, licence.train(spark)).collect()}
    assert got == {1: "mit", 2: "gpl", 3: "mit", 4: "bsd", 5: "", 6: "cc-by,mit"}


def test_counts_newer_characters(spark):
    """Letters and capitals that Python's tables lack count as the library counts them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, counter = Tokenizer.from_file(path), bpe.WordCounter(open(path, encoding="utf-8").read())
    codes = [c for a, b in [*bpe.NEW_LETTERS, *bpe.NEW_NUMBERS] for c in range(a, b + 1)] + [0x32808, 0x3285C, 0x32988, 0x16EA0, 0x125D9, 0x307]
    texts = [f"a{chr(c)}1.{chr(c)} {chr(c)}b" for c in codes] + ["\u0307\U000125d9", "ΑΣ ΑΣ. İ"]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]


def test_quantiles(spark):
    values = [i / 7 + 1 for i in range(1000)]
    got = quality.quantiles(spark.createDataFrame([("en", v) for v in values], "lang string, value double"), 0.98).first().threshold
    assert sum(v <= got for v in values) >= 980 and got == pytest.approx(sorted(values)[979], rel=2e-4)


def _kneser_ney(counts: dict[str, int], gram: str, order: int, symbols: int) -> float:
    """The definition, by recursion over dictionaries; counts: highest-order counts for order, continuation counts below."""
    level = counts if order == quality.ORDER else {}
    if order < quality.ORDER:
        higher = _level(counts, order + 1)
        for g in higher:
            level[g[1:]] = level.get(g[1:], 0) + 1
    t = [sum(n == k for n in level.values()) for k in range(1, 5)]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
    d = [max(0.1 * k, min(float(k), k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5 * k)) for k in (1, 2, 3)]
    off = lambda n: d[min(n, 3) - 1] if n else 0.0
    lower = _kneser_ney(counts, gram[1:], order - 1, symbols) if order > 1 else 1 / symbols
    same = [n for g, n in level.items() if g[:-1] == gram[:-1]]
    if not same:
        return lower
    n = level.get(gram, 0)
    return (n - off(n) + sum(map(off, same)) * lower) / sum(same)


def _level(counts: dict[str, int], order: int) -> dict[str, int]:
    level = {g: n for g, n in counts.items()}
    for _ in range(quality.ORDER - order):
        below: dict[str, int] = {}
        for g in level:
            below[g[1:]] = below.get(g[1:], 0) + 1
        level = below
    return level


def test_quality_against_definition(spark):
    """Every probability of a small model, and of n-grams that it lacks, against the recursive definition."""
    texts = ["the mill by the river", "the miller of the hill", "a river of the hills", "then they met there"]
    counts: dict[str, int] = {}
    for text in texts:
        padded = chr(quality.BEGIN) * (quality.ORDER - 1) + text
        for i in range(len(text)):
            g = padded[i : i + quality.ORDER]
            counts[g] = counts.get(g, 0) + 1
    asked = [*counts, "the ", "zzzz", "mill", "rivx", "ther", " hil"]
    rows = {g: counts.get(g, 0) for g in asked}
    key = lambda g: sum(ord(c) << (16 * (quality.ORDER - 1 - i)) for i, c in enumerate(g))
    got = {r.gram: r.p for r in quality.probabilities(spark.createDataFrame([("en", key(g), n) for g, n in rows.items()], "lang string, gram long, n long")).collect()}
    symbols = len(_level(counts, 1)) + 1
    for g in asked:
        assert got[key(g)] == pytest.approx(_kneser_ney(dict(counts), g, quality.ORDER, symbols), rel=1e-9), g


def test_empty(odd, spark):
    none = odd.where("1 = 0")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    outs = [exact.exact_groups(none), mixing.mixed(none), bpe.encode(none, path, public_tokenizers.PATTERN), substring.dedup_substrings(none), near.near_classes(none), fingerprint.fingerprints(none)]
    outs += [licence.licences(none, licence.train(spark)), chat.format_turns(turns), bpe.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")), quality.classified(none, labels)]
    for out in outs:
        assert out.count() == 0
