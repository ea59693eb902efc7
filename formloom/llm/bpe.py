"""Byte-pair encoding: counting tokens by heap merging, and byte-level encoding of globally distinct words.

merge_all() merges by heap and linked list; encode() and count_tokens() are Spark jobs around it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import block_count, from_payloads, packed_blocks, releasing, squeeze, table, text_of, unsqueeze

#: Distinct words whose result a worker remembers; when full, the memory starts anew (only speed depends on it).
CACHE_WORDS = 1_000_000
#: Code points of a block of the encoding; larger blocks repeat fewer words among them.
ENCODE_CHARS = 9_000_000
#: The same in the pipeline, where workers have served other stages and memory counts more than disk.
STAGE_CHARS = 5_000_000
#: Bytes up to which a word is merged by seeking the lowest rank anew; longer ones are merged by the heap.
SHORT_WORD = 64
NO_RANK = 1 << 62
#: Compression level of the texts that are shuffled.
PACK_LEVEL = 6
#: Ids that are decoded at a time, and pieces of texts whose ids are put together at a time, about.
DECODE_IDS = 300_000
#: Bytes of texts that are matched at a time, about; a text is never cut.
MATCH_BYTES = 1_500_000


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Merge adjacent pairs in place, lowest rank first and leftmost among equals, until none has a rank; the number of
    merges. A symbol that was merged into the one before it is left as -1.

    merges: pair of symbols -> (rank, merged symbol). A heap holds the pairs, a linked list the symbols that are left,
    so a text of n symbols takes O(n log n) steps however long it is.
    """
    n, done = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, found[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, new, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = new, -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := merges.get((new, symbols[k])):
                heapq.heappush(heap, (found[0], i, found[1], new, symbols[k]))
        if (h := before[i]) >= 0 and (found := merges.get((symbols[h], new))):
            heapq.heappush(heap, (found[0], h, found[1], symbols[h], new))
    return done


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols that merge_all() leaves."""
    symbols = [*symbols]
    merge_all(symbols, merges)
    return [x for x in symbols if x >= 0]


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """merge_symbols() for a short word whose symbols are their ranks: the lowest rank is sought anew at each step."""
    left = [ranks.get(pair, NO_RANK) for pair in zip(symbols, symbols[1:])]
    while left and (rank := min(left)) != NO_RANK:
        i = left.index(rank)
        symbols[i] = rank
        del symbols[i + 1], left[i]
        if i < len(left):
            left[i] = ranks.get((rank, symbols[i + 1]), NO_RANK)
        if i:
            left[i - 1] = ranks.get((symbols[i - 1], rank), NO_RANK)
    return symbols


# Token counts ------------------------------------------------------------------------------------------------------


class WordCounter(dict):
    """word -> number of tokens: initial symbols less merges. No token identifier is looked up or emitted; symbols have
    numbers of their own, by which pairs are found."""

    def __init__(self, vocabulary: str):
        super().__init__()
        made = json.loads(vocabulary)
        model = made["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.names: dict[str, int] = {}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self._name(a), self._name(b)] = (rank, self._name(a + b))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte = [chr(hidden.get(b, b)) for b in range(256)]
        split = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = _finder(split.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}"))
        special = [t["content"] for t in made["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.marks = tuple(special)

    def _name(self, symbol: str) -> int:
        return self.names.setdefault(symbol, len(self.names))

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        symbols = [self.byte[b] for b in word.encode()]
        symbols[-1] += self.end
        self[word] = n = len(symbols) - merge_all([self._name(s) for s in symbols], self.merges)
        return n

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as the library has it by default."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))

    def _plain(self, text: str) -> int:
        # Letter by letter, as the library does: no word-final form of sigma.
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = (text.translate(NEW_LOWER) if _is_new(text) else text).replace("Σ", "σ")
        text = text.lower()
        return sum(map(self.__getitem__, self.find(text)))


#: Unicode's White_Space, which \s means in the libraries' patterns.
SPACES = r"\t-\r\x20\x85\xa0  -     　"

_counters: dict[str, WordCounter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row, in one pass without a shuffle.

    vocabulary_path names a tokenizers .json of a word-end BPE; the driver reads it and its text goes to the tasks
    (a fixed file of under 2 MB). Null and empty texts have 0 tokens; other columns aren't read; equal rows give equal
    rows; an empty table gives an empty one.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = vocabulary.value
        key = hashlib.sha256(value.encode()).hexdigest()
        counter = _counters.get(key) or _counters.setdefault(key, WordCounter(value))
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the word-end vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# Byte-level encoding and decoding ----------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: one line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Every way to put a token together from two others; ids are ranks."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = (rank, rank)
    return out


def _joined(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = list(words)
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int32, len(words))


def _cut(data: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    raw, starts = data.tobytes(), [0, *ends]
    return [raw[a:b] for a, b in zip(starts, ends)]


#: The alternative for words in a pattern, and the letters of Latin-1.
WORDS, LATIN = r"| ?\p{L}+|", "A-Za-zªµºÀ-ÖØ-öø-ÿ"

#: The end of a pattern whose matches never go on over a single space before something else.
SPACED = WORDS + r" ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed values, first and last code points: letters and numbers of Unicode 16 that Python's tables (15.1) don't have yet.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: First and last capital and the first small letter, where the library's tables have a pair that Python's don't.
NEW_PAIRS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
NEW_LOWER = {a + i: low + i for a, b, low in NEW_PAIRS for i in range(b - a + 1)}


def _inside(ranges: Iterable[tuple[int, int]]) -> str:
    """First and last code points as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: Finds a character that needs one of the tables above; most texts have none as high as the first of them, which is found faster.
_NEW = [*NEW_LETTERS, *NEW_NUMBERS, *((a, b) for a, b, _ in NEW_PAIRS)]
_is_high, _is_listed = re.compile(f"[{_inside([(min(_NEW)[0], 0x10FFFF)])}]").search, re.compile(f"[{_inside(_NEW)}]").search


def _is_new(text: str) -> bool:
    return bool(_is_high(text) and _is_listed(text))


_finders: dict = {}


def _ranges(codes: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    firsts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    lasts = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return _inside(zip(firsts, lasts))


def _finder(pattern: str):
    """findall of a pattern whose classes are letters, numbers and white space, as the libraries mean them.

    Python's own engine is faster than one that knows \\p: its \\w is letters, numbers and the underscore, so letters
    are \\w less all numbers. A pattern that says more is left to the other engine. Words of Latin-1 letters alone, which
    end before a character of Latin-1, come first where only words with an apostrophe in front come before words.
    """
    if not (found := _finders.get(pattern)):
        numbers = _ranges([c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")])
        letter, number = rf"[^\W\d_{numbers}]", rf"[\d{numbers}]"
        spaced = pattern.replace(r"(?!\S)", f"(?![^{SPACES}])")
        sign = rf"[^\s\p{{L}}\p{{N}}]"

        def written(letter: str, number: str, other: str) -> str:
            return spaced.replace(sign, other).replace(r"\p{L}", letter).replace(r"\p{N}", number).replace(r"\s", f"[{SPACES}]")

        plain = written(letter, number, f"(?:[^\\w{SPACES}]|_)")
        if r"\p" in plain:
            slow = fast = regex.compile(spaced.replace(r"[^\s", "[^" + SPACES).replace(r"\s", f"[{SPACES}]")).findall
        else:
            more = written(f"(?:{letter}|[{_inside(NEW_LETTERS)}])", f"(?:{number}|[{_inside(NEW_NUMBERS)}])", f"(?:[^\\w{SPACES}{_inside(NEW_LETTERS + NEW_NUMBERS)}]|_)")
            if all(x.startswith("'") for x in pattern.partition(WORDS)[0].split("|")) and WORDS in pattern:
                plain = rf" ?[{LATIN}]++(?![^\x00-\xff])|{plain}"
            fast, slow = re.compile(plain).findall, re.compile(more).findall
        found = _finders[pattern] = lambda text: (slow if not text.isascii() and _is_new(text) else fast)(text)
    return found


def _pieces(texts: pa.ChunkedArray, pattern: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(found, matches, pieces, sizes): the matches of each distinct piece of the texts, one piece after the other; how many
    each piece has; the pieces that the texts are made of, by number, and how many each text has.

    Texts are cut before every space that no white space follows, and pieces that repeat are matched once, where the pattern
    allows that: there a match always ends, whatever stands around it, and the next begins with that space. Under other
    patterns each text is one piece.
    """
    find = _finder(pattern)
    n, end = len(texts), pattern.find(SPACED)
    if not n or not pattern.endswith(SPACED) or not all(re.fullmatch("'[a-z]+", x) for x in pattern[:end].split("|")):
        each = [find(t.as_py()) for t in texts]
        return [w for found in each for w in found], np.array([len(found) for found in each], np.int64), np.arange(n), np.ones(n, np.int64)
    cut = pc.split_pattern(texts, " ").combine_chunks()
    parts, bounds = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
    first = np.zeros(len(parts), bool)
    first[bounds[:-1]] = True
    blank = pc.or_(pc.equal(parts.dictionary, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(parts.dictionary, 0, 1)))
    late = blank.to_numpy(zero_copy_only=False)[parts.indices.to_numpy()] & ~first
    if late.any():  # white space follows the space before these parts, so they go to the parts before them
        begin = np.flatnonzero(~late)
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(late)].astype(np.int32)), cut.flatten()), " ").dictionary_encode()
        bounds, first = np.searchsorted(begin, bounds), first[begin]
    at, names = parts.indices.to_numpy(), parts.dictionary
    used = np.flatnonzero(np.bincount(at[~first], minlength=len(names)))
    number = np.zeros(len(names), np.int32)
    number[used] = np.arange(len(used))
    pieces = number[at]
    pieces[first] = len(used) + np.arange(n)  # without a space in front
    spaced = names.take(pa.array(used))
    found = find(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), spaced), " ")[0].as_py()) if len(used) else []
    ends, upto = (np.cumsum(pc.utf8_length(x).to_numpy() + more) for x, more in ((pa.array(found, pa.string()), 0), (spaced, 1)))
    own = [find(x.as_py()) for x in names.take(pa.array(at[first]))]
    matches = np.r_[np.diff(np.r_[0, np.searchsorted(ends, upto, "right")]), [len(x) for x in own]].astype(np.int64)
    for x in own:
        found += x
    return found, matches, pieces, np.diff(bounds)


def _slices(rows: pa.Table) -> Iterator[pa.Table]:
    """The rows in order, as many at a time as have about MATCH_BYTES of texts; at least one."""
    ends = np.cumsum(pc.binary_length(rows.column("text")).to_numpy().astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATCH_BYTES, "right")))
        yield rows.slice(a, b - a)
        a = b


def _distinct(rows: pa.Table, pattern: str) -> list[bytes]:
    words: set[str] = set()
    for part in _slices(rows):
        words.update(_pieces(part.column("text"), pattern)[0])
    return sorted(w.encode() for w in words)


def _taken(values: np.ndarray, lengths: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The values of the entries i, one after the other; lengths: how many values each entry has."""
    n = lengths[i]
    return values[np.repeat((np.cumsum(lengths) - lengths)[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of as many values as each length says."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(lengths)]])


def _shard(words: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (h % np.uint64(shards)).astype(np.int32)


class _Ranked:
    """Ranks of pairs as merge_all() reads them, where the merged symbol is the rank."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.pairs = pairs

    def get(self, pair: tuple[int, int]) -> tuple[int, int] | None:
        rank = self.pairs.get(pair)
        return None if rank is None else (rank, rank)


def encode(docs: DataFrame, ranks_path: str, pattern: str, chars: int = ENCODE_CHARS) -> DataFrame:
    """(doc_id, ids array<int>): each match of the pattern encoded by the ranks, one row per input row.

    Blocks of documents are cut into words; each block sends each of its distinct words once to the word's shard; a
    shard encodes each word once for all blocks and sends the ids back; the block, whose texts were shuffled once and
    are read again, puts them at the words' positions. Words travel sorted and compressed, many in one row. Null and
    empty texts have no ids; a frequent word is one entry for each block, so it can't make a hot shard.
    """
    return _encoded(docs, ranks_path, pattern, chars, lambda ids: [ids], "ids array<int>")


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, chars: int, shown: Callable[[pa.ListArray], list[pa.Array]], columns: str) -> DataFrame:
    """encode() with what shown() makes of the ids, in the task that puts them together: where large lists of ids would
    go on to another Python worker, each task would hold two workers and the ids twice more on their way."""
    ranks = read_ranks(ranks_path)
    kind = "u2" if max(ranks.values()) < 1 << 16 else "i4"
    shared = docs.sparkSession.sparkContext.broadcast((ranks, {pair: rank for pair, (rank, _) in merge_table(ranks).items()}))  # fixed by the vocabulary, a few MB
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]
    blocks = block_count(docs, chars=chars)
    shards = max(4, math.ceil(blocks * 1.5))
    packed = packed_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), blocks, PACK_LEVEL)

    def words_of(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        words = _distinct(from_payloads(group.column("payload")), pattern)
        at = _shard(words, shards)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(shards + 1))
        used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
        values = [squeeze(*_joined(words[i] for i in order[cuts[s] : cuts[s + 1]].tolist())) for s in used]
        return pa.table({"block": pa.array([key[0].as_py()] * len(used), pa.int32()), "shard": pa.array(used, pa.int32()), "words": pa.array(values, pa.binary())})

    def encode_shard(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ranks, pairs = shared.value
        merges = _Ranked(pairs)
        byte = [ranks.get(bytes([b])) for b in range(256)]
        known: dict[bytes, list[int]] = {}
        out = []
        for value in group.column("words"):
            ids: list[int] = []
            lengths: list[int] = []
            data, ends = unsqueeze(value.as_py(), "u1", "i4")
            for w in _cut(data, ends):
                if (got := known.get(w)) is None:
                    whole = ranks.get(w)
                    symbols = [byte[b] for b in w]
                    known[w] = got = [whole] if whole is not None else merge_word(symbols, pairs) if len(w) <= SHORT_WORD else merge_symbols(symbols, merges)
                ids += got
                lengths.append(len(got))
            out.append(squeeze(data, ends, np.array(ids, kind), np.array(lengths, np.int32)))
        return pa.table({"block": group.column("block"), "ids": pa.array(out, pa.binary())})

    def put_back(key: tuple[pa.Scalar, ...], texts: pa.Table, coded: pa.Table) -> pa.Table:
        rows = from_payloads(texts.column("payload"))
        sent = [unsqueeze(value.as_py(), "u1", "i4", kind, "i4") for value in coded.column("ids")]
        data, ends, ids, lengths = (np.concatenate([np.zeros(0, t), *part]) for t, part in zip(("u1", "i4", kind, "i4"), list(zip(*sent)) or [()] * 4))
        offsets = np.r_[0, np.cumsum(ends)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
        return pa.concat_tables(pa.table([part.column("doc_id"), *shown(ids_of(key, part, words, ids, lengths))], names) for part in _slices(rows))

    def ids_of(key: tuple[pa.Scalar, ...], rows: pa.Table, words: pa.StringArray, ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
        found, matches, pieces, sizes = _pieces(rows.column("text"), pattern)
        i = pc.index_in(pa.array(found, pa.string()), value_set=words)
        if i.null_count:
            raise ValueError(f"block {key[0].as_py()}: {i.null_count} words have not been encoded")
        i = i.to_numpy()
        ids, lengths = _taken(ids, lengths, i), _sums(lengths[i], matches)  # of each piece
        flat = [_taken(ids, lengths, pieces[a : a + DECODE_IDS]).astype(np.int32) for a in range(0, len(pieces), DECODE_IDS)]
        offsets = np.r_[0, np.cumsum(_sums(lengths[pieces], sizes))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))

    sent = packed.groupBy("block").applyInArrow(releasing(words_of), "block int, shard int, words binary")
    coded = sent.groupBy("shard").applyInArrow(releasing(encode_shard), "block int, ids binary")
    return packed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(releasing(put_back), f"doc_id long, {columns}")


def token_bytes(ranks_path: str) -> list[bytes]:
    """The token-byte table as a list by id."""
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def joined_entries(table: pa.Array, ids: pa.ListArray, separator: bytes) -> Iterator[pa.Scalar]:
    """For each list of ids the table's entries, joined; null is empty. Ids outside the table fail."""
    offsets = ids.offsets.to_numpy()
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + DECODE_IDS, "right")) - 1)
        entries = table.take(ids.values.slice(offsets[a], offsets[b] - offsets[a]))
        yield from pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a]), entries), separator)
        a = b


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (with ids array<int>) with the bytes that the ids stand for, as column `decoded`.

    Each batch of ids is joined to the token-byte table by id, an array look-up; the table is fixed by the vocabulary
    and goes to every task. Ids outside the table fail; empty and null arrays give empty bytes.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))
    names = encoded.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.binary())
        for batch in batches:
            out = [x.as_py() for x in joined_entries(tokens, batch.column(names.index("ids")), b"")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join, f"{kinds}, decoded binary")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _hashing(spark: SparkSession, ranks_path: str) -> Callable[[pa.ListArray], list[pa.Array]]:
    """What makes the columns DIGESTS of lists of ids; ids are decoded as decode() does it, by the token-byte table."""
    tokens = token_bytes(ranks_path)
    shared = spark.sparkContext.broadcast((pa.array([b"%d" % i for i in range(len(tokens))], pa.binary()), pa.array(tokens, pa.binary())))

    def hashed(ids: pa.ListArray) -> list[pa.Array]:
        of_ids, of_bytes = ([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined_entries(table, ids, by)] for table, by in zip(shared.value, (b" ", b"")))
        return [pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return hashed


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded (doc_id, ids).

    Ids are decoded as decode() does it, and both are hashed beside that, so neither goes back as a column.
    """
    hashed = _hashing(encoded.sparkSession, ranks_path)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *hashed(batch.column(1))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(batches_of, f"doc_id long, {DIGESTS}")


def _digests(docs: DataFrame, chars: int = ENCODE_CHARS) -> DataFrame:
    """digests(encode(docs)), made where the ids are put together."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _encoded(docs, path, public_tokenizers.PATTERN, chars, _hashing(docs.sparkSession, path), DIGESTS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the byte-level ranks and decoded again."""
    return _digests(table(spark, sf_dir, "documents"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, n_tokens and digests of the ids and of the decoded bytes, a row per document."""
    return _digests(docs, STAGE_CHARS)
