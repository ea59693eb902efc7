"""Substring dedup by recompression: equal passages get equal symbols, shared symbols lead to repeated windows.

Words are rewritten in rounds: runs of a symbol become one symbol, then pairs whose two classes (a bit of a hash of the
symbol) are left and right become one. A symbol's name is a hash of what it stands for, so names are the same all over
the corpus without a name table. Each symbol carries the stretch of words that fixes it: wherever these words stand, the
symbol stands too. So a window that holds the stretch of a symbol that no other document has is not repeated; only
the windows that are left are named by 128 bits of their words and compared.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import BLOCK_CHARS, block_count, from_payloads, mix, packed_blocks, releasing, shard_cuts, squeeze, table, text_of, texts_as_bytes, unsqueeze

WINDOW = 50
#: Rounds of recompression; a symbol stands for about 1.33 ** ROUNDS words.
ROUNDS = 6


@dataclass
class Symbols:
    """name, first word start (a symbol ends where the next begins), words [low, high) that fix it; bar: the mark between documents."""

    name: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bar: np.ndarray

    def take(self, i: np.ndarray) -> Symbols:
        return Symbols(self.name[i], self.start[i], self.low[i], self.high[i], self.bar[i])


def merge_runs(x: Symbols, words: np.ndarray) -> Symbols:
    """Each maximal run of a symbol becomes one symbol, named by the symbol and the run's length."""
    # That a run ends is seen by the next word, or, if that could belong to another copy, by the next symbol's stretch.
    low, high = np.maximum(x.start - 1, 0), np.minimum(np.r_[x.start[1:], len(words)] + 1, len(words)).astype(np.int32)
    np.minimum(low, x.low, out=low)
    np.maximum(high, x.high, out=high)
    last = words[np.r_[x.start[1:], len(words)] - 1]
    np.minimum(low[1:], x.low[:-1], out=low[1:], where=last[1:] == last[:-1])
    first = words[x.start]
    np.maximum(high[:-1], x.high[1:], out=high[:-1], where=first[:-1] == first[1:])
    goes_on = (x.name[1:] == x.name[:-1]) & ~x.bar[1:] & ~x.bar[:-1]
    if not goes_on.any():
        return Symbols(x.name, x.start, low, high, x.bar)
    at = np.flatnonzero(np.r_[True, ~goes_on])
    k = np.diff(np.r_[at, len(x.name)])
    name, many = x.name[at], k > 1
    name[many] = mix(name[many], k[many].astype(np.uint64))
    return Symbols(name, x.start[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), x.bar[at])


def merge_pairs(x: Symbols, bit: int) -> Symbols:
    """Each left symbol that a right one follows becomes one symbol with it."""
    right = ((x.name >> np.uint64(bit)) & np.uint64(1)).astype(bool)
    left = ~right & ~x.bar
    right &= ~x.bar
    pair = left[:-1] & right[1:]
    # A symbol stays alone because of its neighbour, whose stretch then counts too.
    low, high, lone = x.low.copy(), x.high.copy(), right[1:] & ~pair
    np.minimum(low[:-1], x.low[1:], out=low[:-1], where=left[:-1])
    np.maximum(high[:-1], x.high[1:], out=high[:-1], where=left[:-1])
    np.minimum(low[1:], x.low[:-1], out=low[1:], where=lone)
    np.maximum(high[1:], x.high[:-1], out=high[1:], where=lone)
    name, p = x.name.copy(), np.flatnonzero(pair)
    name[p] = mix(x.name[p], x.name[p + 1])
    return Symbols(name, x.start, low, high, x.bar).take(np.flatnonzero(np.r_[True, ~pair]))


def recompress(words: np.ndarray, bars: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols after `rounds` rounds over 64-bit word names; bars: positions of the marks between documents."""
    n = len(words)
    at = np.arange(n, dtype=np.int32)
    bar = np.zeros(n, bool)
    bar[bars] = True
    x = Symbols(words, at, at, at + np.int32(1), bar)
    for i in range(rounds):
        x = merge_pairs(merge_runs(x, words), (i * 11 + 5) % 64)  # another bit each time
    return x


def _words(rows: pa.Table) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text; all their names in one array with a mark before, between and after; the first positions."""
    found = [t.split() for t in texts_as_bytes(rows.column("text"))]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    firsts = np.cumsum(sizes + 1) - sizes
    names = np.zeros(int(sizes.sum()) + len(found) + 1, np.uint64)
    inner = np.ones(len(names), bool)
    inner[_bars(names, firsts)] = False
    names[inner] = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    return found, names, firsts


def _bars(names: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.r_[firsts - 1, len(names) - 1]


def _telling(x: Symbols, window: int) -> Symbols:
    """The symbols that some window fixes, sorted by name."""
    x = x.take(np.flatnonzero(~x.bar & (x.high - x.low <= window)))
    return x.take(np.argsort(x.name, kind="stable"))


def _owner(firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(firsts, at, side="right") - 1


def open_windows(x: Symbols, shared: np.ndarray, names: np.ndarray, firsts: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows inside documents that hold no stretch of a symbol of one document only."""
    n = len(names)
    shut = np.zeros(n + 1, np.int64)
    low, high = x.low[~shared], x.high[~shared]
    np.add.at(shut, np.maximum(high - window, 0), 1)
    np.add.at(shut, low + 1, -1)
    free = np.cumsum(shut[:n]) == 0
    inside = np.zeros(n + 1, np.int64)
    sizes = np.diff(np.r_[firsts, n]) - 1
    whole = sizes >= window
    np.add.at(inside, firsts[whole], 1)
    np.add.at(inside, (firsts + sizes - window + 1)[whole], -1)
    return np.flatnonzero(free & (np.cumsum(inside[:n]) > 0))


def window_names(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(n, 2): two independent 64-bit names of the windows that start at `at`, put together from powers of two."""
    out = []
    for salt in (0x1357, 0x2468ACE):
        level, size, start, whole = mix(names, np.full(1, salt, np.uint64)), 1, at, None
        rest = window
        while rest:
            if rest & 1:
                part = level[start]
                whole = part if whole is None else mix(whole, part)
                start = start + size
            rest >>= 1
            if rest:
                pad = np.zeros(min(size, len(level)), np.uint64)
                level, size = mix(level, np.r_[level[size:], pad]), size * 2
        out.append(whole)
    return np.stack(out, 1) if len(at) else np.zeros((0, 2), np.uint64)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts less each word of a window that also starts in a smaller doc_id.

    kept is the bytes of the kept words, joined by one space. Windows are judged on the input. Null and empty texts and
    those of fewer words than a window lose nothing; rows that share a doc_id don't count as smaller than one another;
    null ids are smaller than all others. One row per input row, whatever other columns docs has.

    Blocks of texts are shuffled once. Symbols and then window names go to shards of equal ranges of their name space,
    each name once for a block, so a passage of a third of all documents is one entry for each block; bits go back.
    """
    blocks = block_count(docs, chars=chars)
    shards = max(4, math.ceil(blocks * 1.5))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = packed_blocks(rows, blocks)

    def prepared(payloads: pa.ChunkedArray):
        rows = from_payloads(payloads)
        found, names, firsts = _words(rows)
        symbols = _telling(recompress(names, _bars(names, firsts), rounds), window)
        return rows, names, firsts, symbols

    def sent(block: int, names: np.ndarray, *columns: np.ndarray) -> dict[str, list]:
        cuts = shard_cuts(names, shards)
        used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
        values = [squeeze(names[cuts[s] : cuts[s + 1]], *(c[cuts[s] : cuts[s + 1]] for c in columns)) for s in used]
        return {"block": [block] * len(used), "shard": used, "kind": ["names"] * len(used), "value": values}

    def distinct_symbols(x: Symbols, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names once each, whether two documents of the block have them, and the name of each symbol."""
        if not len(x.name):
            return x.name, np.zeros(0, bool), np.zeros(0, np.int64)
        first = np.r_[True, x.name[1:] != x.name[:-1]]
        at, owner = np.flatnonzero(first), _owner(firsts, x.start)
        many = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        return x.name[at], many, np.cumsum(first) - 1

    def send_symbols(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, _, firsts, x = prepared(group.column("payload"))
        names, many, _ = distinct_symbols(x, firsts)
        return arrow(sent(key[0].as_py(), names, many))

    def share_symbols(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        got = [unsqueeze(v.as_py(), "u8", "?") for v in group.column("value")]
        names = np.concatenate([g[0] for g in got])
        order = np.argsort(names, kind="stable")
        first = np.r_[True, names[order][1:] != names[order][:-1]]
        at = np.flatnonzero(first)
        many = np.maximum.reduceat(np.concatenate([g[1] for g in got])[order], at) | (np.diff(np.r_[at, len(names)]) > 1)
        back = np.zeros(len(names), bool)
        back[order] = many[np.cumsum(first) - 1]
        return arrow(answers(group, back, [len(g[0]) for g in got]))

    def send_windows(key: tuple[pa.Scalar, ...], texts: pa.Table, bits: pa.Table) -> pa.Table:
        rows, names, firsts, x = prepared(texts.column("payload"))
        unique, _, which = distinct_symbols(x, firsts)
        at = open_windows(x, flags_of(bits, shard_cuts(unique, shards))[which], names, firsts, window)
        named = window_names(names, at, window)
        keys = rows.column("key").to_numpy()[_owner(firsts, at)]
        order = np.lexsort((keys, named[:, 1], named[:, 0]))
        at, named, keys = at[order], named[order], keys[order]
        first = np.r_[True, (named[1:] != named[:-1]).any(1)][: len(at)]
        # A name's smallest key in the block settles the others of the block: only (name, smallest key) goes out. Where
        # the windows are, which the block needs again at the end, goes with it and comes back with the answers.
        heads = np.flatnonzero(first)
        later_here = keys > keys[heads][np.cumsum(first) - 1] if len(at) else first
        block, high = key[0].as_py(), named[heads, 0].copy()
        out = sent(block, high, named[heads, 1].copy(), keys[heads])
        out["block"].append(block), out["shard"].append(block % shards), out["kind"].append("own")
        out["value"].append(squeeze(at.astype(np.int32), first, later_here, shard_cuts(high, shards)))
        return arrow(out)

    def judge_windows(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        own = group.filter(pc.equal(group.column("kind"), "own"))
        group = group.filter(pc.equal(group.column("kind"), "names"))
        if not group.num_rows:
            return own
        got = [unsqueeze(v.as_py(), "u8", "u8", "i8") for v in group.column("value")]
        a, b, keys = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.lexsort((keys, b, a))
        first = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        least = keys[order][np.flatnonzero(first)]
        later = np.zeros(len(a), bool)
        later[order] = keys[order] > least[np.cumsum(first) - 1]
        return pa.concat_tables([own, arrow(answers(group, later, [len(g[0]) for g in got]))])

    def cut_texts(key: tuple[pa.Scalar, ...], texts: pa.Table, bits: pa.Table) -> pa.Table:
        rows = from_payloads(texts.column("payload"))
        found = [t.split() for t in texts_as_bytes(rows.column("text"))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        firsts = np.cumsum(sizes + 1) - sizes
        own = bits.filter(pc.equal(bits.column("kind"), "own")).column("value")[0].as_py()
        at, first, later_here, cuts = unsqueeze(own, "i4", "?", "?", "i8")
        later = flags_of(bits, cuts)
        at = at[later_here | later[np.cumsum(first) - 1]] if len(at) else at
        cover = np.zeros(int(sizes.sum()) + len(found) + 2, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        stays = np.cumsum(cover) == 0
        removed, kept = [], []
        for ws, a in zip(found, firsts.tolist()):
            keep = stays[a : a + len(ws)]
            removed.append(len(ws) - int(keep.sum()))
            kept.append(b" ".join([ws[i] for i in np.flatnonzero(keep).tolist()] if removed[-1] else ws))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    def answers(group: pa.Table, flags: np.ndarray, sizes: list[int]) -> dict[str, list]:
        cuts = np.cumsum([0, *sizes])
        values = [squeeze(np.packbits(flags[a:b])) for a, b in zip(cuts, cuts[1:])]
        return {"block": group.column("block"), "shard": group.column("shard"), "kind": ["flags"] * len(values), "value": values}

    def flags_of(bits: pa.Table, cuts: np.ndarray) -> np.ndarray:
        """The flags that came back for sorted names, shard by shard."""
        out = np.zeros(int(cuts[-1]), bool)
        for s, k, v in zip(bits.column("shard").to_pylist(), bits.column("kind").to_pylist(), bits.column("value")):
            if k == "flags":
                out[cuts[s] : cuts[s + 1]] = np.unpackbits(unsqueeze(v.as_py(), "u1")[0], count=int(cuts[s + 1] - cuts[s])).astype(bool)
        return out

    def arrow(x: dict[str, list]) -> pa.Table:
        kinds = {"block": pa.int32(), "shard": pa.int32(), "kind": pa.string(), "value": pa.binary()}
        return pa.table({k: v if isinstance(v := x[k], pa.ChunkedArray) else pa.array(v, t) for k, t in kinds.items()})

    sending = "block int, shard int, kind string, value binary"
    texts = packed.groupBy("block")
    shared = texts.applyInArrow(releasing(send_symbols), sending).groupBy("shard").applyInArrow(releasing(share_symbols), sending)
    judged = texts.cogroup(shared.groupBy("block")).applyInArrow(releasing(send_windows), sending).groupBy("shard").applyInArrow(releasing(judge_windows), sending)
    return texts.cogroup(judged.groupBy("block")).applyInArrow(releasing(cut_texts), "doc_id long, n_words long, n_removed long, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less their repeated 50-word windows."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_brute_force(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256) by a dictionary of all windows, for tests."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen: set[tuple] = set()
    out = {}
    for i in sorted(words):
        ws = words[i]
        wins = [tuple(ws[p : p + window]) for p in range(len(ws) - window + 1)]
        gone = {q for p, w in enumerate(wins) if w in seen for q in range(p, p + window)}
        seen.update(wins)
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out
