"""Maximal runs of repeated words, by a suffix automaton whose link tree is recoloured path by path.

The automaton of a word sequence has a state for every set of substrings that end at the same places; its
suffix links form a tree in which the prefix that ends at i is a node whose path to the root
holds all substrings that end there. Words are appended in turn, and the path of each prefix is recoloured
with its end by the access of a link-cut tree: preferred paths are splay trees, and each carries the last end
of its substrings. A segment of old colour e whose deepest node has length m says that the m words before the
ends e and i are the same, and no more: with p = i - e the last m + p words have period p, and begin
nowhere earlier. If p is within the segment (p <= m) they hold a square, whose least period is p, as a shorter one would have
recoloured the segment later. The largest i at which start and period are found is the run's end.

Only stretches that can hold a run of ``EXPONENT`` periods are put into an automaton. In such a run of
period q and length l all 5-word shingles but the first q are repeats at distance q or less, and there are at least
3 q - 4 of them (one at least): so maximal stretches of repeated shingles, each within a third of the stretch's length,
are found first, by hashes of whole batches.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import BLANK_WORDS, RollingHash, U, mix64, parts, word_spans

EXPONENT, LEAST = 4, 6  # a run has this many periods and words at least
SHINGLE = 5  # LEAST - 1: a run of period 1 has one repeat of it


class SuffixAutomaton:
    """States, their lengths and suffix links, and the state of each prefix."""

    def __init__(self, words: list[int]):
        # a state's first transition stands in two arrays, further ones in a dict
        word, to, more = array("q", [-1]), array("i", [0]), {}
        length, link, last = array("i", [0]), array("i", [-1]), 0
        ends = array("i")

        def target(state: int, w: int) -> int:
            return to[state] if word[state] == w else more[state].get(w, -1) if state in more else -1

        def put(state: int, w: int, goal: int) -> None:
            if word[state] in (w, -1):
                word[state], to[state] = w, goal
            else:
                more.setdefault(state, {})[w] = goal

        def new(n: int, suffix: int) -> int:
            word.append(-1)
            to.append(0)
            length.append(n)
            link.append(suffix)
            return len(length) - 1

        for w in words:
            state, p = new(length[last] + 1, 0), last
            while p >= 0 and (q := target(p, w)) < 0:
                put(p, w, state)
                p = link[p]
            if p >= 0:
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = new(length[p] + 1, link[q])
                    word[clone], to[clone] = word[q], to[q]
                    if q in more:
                        more[clone] = dict(more[q])
                    while p >= 0 and target(p, w) == q:
                        put(p, w, clone)
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
            ends.append(state)
        self.length, self.link, self.ends = length, link, ends


class LastEnds:
    """A link-cut tree over suffix links: preferred paths as splay trees, each with the last end put on it."""

    def __init__(self, link: array):
        n = len(link)
        self.parent = array("i", link)  # of a splay tree's root: the node above its path
        self.left, self.right = array("i", [-1]) * n, array("i", [-1]) * n
        self.end, self.late = array("i", [-1]) * n, array("i", [-1]) * n  # late: an end still to be handed to the subtree

    def splay(self, x: int) -> None:
        parent, left, right, end, late = self.parent, self.left, self.right, self.end, self.late
        way = [x]
        y = x
        while (z := parent[y]) >= 0 and (left[z] == y or right[z] == y):
            way.append(z)
            y = z
        for y in reversed(way):  # ends are handed down from the root
            if (e := late[y]) >= 0:
                for child in (left[y], right[y]):
                    if child >= 0:
                        end[child] = late[child] = e
                late[y] = -1

        def up(c: int) -> None:
            p = parent[c]
            g = parent[p]
            if left[p] == c:
                b = left[p] = right[c]
                right[c] = p
            else:
                b = right[p] = left[c]
                left[c] = p
            if b >= 0:
                parent[b] = p
            parent[p], parent[c] = c, g
            if g >= 0:
                if left[g] == p:
                    left[g] = c
                elif right[g] == p:
                    right[g] = c

        while (p := parent[x]) >= 0 and (left[p] == x or right[p] == x):
            g = parent[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                up(p if (left[g] == p) == (left[p] == x) else x)
            up(x)

    def access(self, node: int, i: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``node`` to the root with the end i; its old segments from below: deepest node, old end."""
        parent, right = self.parent, self.right
        x, below = node, -1
        while x >= 0:
            self.splay(x)
            yield x, self.end[x]
            right[x] = below  # what went on deeper keeps its colour as a path of its own
            below, x = x, parent[x]
        self.splay(node)
        self.end[node] = self.late[node] = i


def runs_of(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length and least period of every maximal run of at least ``exponent`` (2 or more) periods and ``least`` words."""
    automaton = SuffixAutomaton(words)
    length = automaton.length
    tree, found = LastEnds(automaton.link), {}
    for i, node in enumerate(automaton.ends):
        for deepest, end in tree.access(node, i):
            if end >= 0 and (exponent - 1) * (p := i - end) <= (m := length[deepest]) and m + p >= least:
                found[i - m - p + 1, p] = i
    return sorted((s, i - s + 1, p) for (s, p), i in found.items())


def stretches(h: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (first word, end) of hashed words that hold every run of EXPONENT periods and LEAST words whole.

    ``row`` numbers the texts; no stretch spans two. Stretches are disjoint and in order.
    """
    n = len(h) - SHINGLE + 1
    if n < 2:
        return []
    s = np.zeros(n, dtype=U)
    for k in range(SHINGLE):
        s = mix64(s * U(0x9E3779B97F4A7C15) + h[k : k + n])
    s = mix64(s + row[:n].astype(U) * U(0xC2B2AE3D27D4EB4F))
    whole = np.flatnonzero(row[:n] == row[SHINGLE - 1 :])
    order = whole[np.argsort(s[whole], kind="stable")]
    again = np.flatnonzero(s[order[1:]] == s[order[:-1]]) + 1
    last = order[again] + SHINGLE - 1  # of a repeated shingle
    sort = np.argsort(last)
    last, gap = last[sort], (order[again] - order[again - 1])[sort]
    while len(last):  # keep repeats within a third of their stretch until all are
        cut = np.flatnonzero((np.diff(last) > 1) | (row[last[1:]] != row[last[:-1]])) + 1
        size = np.diff(np.concatenate(([0], cut, [len(last)])))
        near = gap <= (np.repeat(size, size) + SHINGLE - 1) // (EXPONENT - 1)
        if near.all():
            break
        last, gap = last[near], gap[near]
    if not len(last):
        return []
    first = last[np.concatenate(([0], cut))]
    final = first + size
    floor = np.searchsorted(row, row[first])
    begin = np.maximum(first - SHINGLE + 1 - (size + SHINGLE - 1) // (EXPONENT - 1), floor)
    out: list[tuple[int, int]] = []
    for a, b in zip(begin.tolist(), final.tolist(), strict=True):
        if out and a < out[-1][1]:
            a = min(a, out.pop()[0])
            while out and a < out[-1][1]:
                a = min(a, out.pop()[0])
        out.append((a, b))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds beyond its first period."""
    change = np.zeros(n + 1, dtype=np.int32)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def looped(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and at which period, the n words of a document are made to repeat; None: they stay.

    A null doc_id counts as the text ``null``.
    """
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long, collapsed string, runs array<struct<start:long,length:long,period:long>>"


def detect(docs: DataFrame, loops: bool = False) -> DataFrame:
    """Every document's runs: maximal stretches of at least 6 words and 4 least periods, and its text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, equal only if their bytes are. start, length, period and exponent_milli are
    those of the longest run (ties: least start, then period), null without one; ``runs`` lists all by start,
    then period, and ``collapsed`` is the text of the n_kept words that no run holds after its first period, joined by
    one space. With ``loops`` the words of some documents are first made to repeat (``looped``). Null texts are empty
    and have no words. Rows that repeat a doc_id are documents of their own. An empty table gives no rows. Other columns
    are not read. A document is one row of one task, and needs memory for its own words only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                yield judged(part.column("doc_id"), buf, offs)

    def judged(ids: pa.Array, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        start, end, row = word_spans(buf, offs, BLANK_WORDS)
        hashed = RollingHash(buf).of(start, end)
        n_rows = len(offs) - 1
        bound = np.searchsorted(row, np.arange(n_rows + 1))
        source = np.arange(len(start))  # the word that stands at each place
        raw, changed = buf.tobytes(), np.zeros(n_rows, dtype=bool)
        if loops:
            for i, name in enumerate(ids.to_pylist()):
                n = int(bound[i + 1] - bound[i])
                if made := looped(name, n):
                    a, p = made
                    source[bound[i] + a : bound[i + 1]] = bound[i] + a + np.arange(n - a) % p
                    changed[i] = True
        found: dict[int, list] = {}
        for a, b in stretches(hashed[source], row):
            codes: dict[bytes, int] = {}
            words = [codes.setdefault(raw[start[k] : end[k]], len(codes)) for k in source[a:b].tolist()]
            i = int(row[a])
            found.setdefault(i, []).extend((s + a - int(bound[i]), length, p) for s, length, p in runs_of(words))
        out: dict[str, list] = {c.split(" ")[0]: [] for c in RESULT.split(", ")[1:]}
        for i in range(n_rows):
            runs, n = sorted(found.get(i, ()), key=lambda x: (x[0], x[2])), int(bound[i + 1] - bound[i])
            if runs or changed[i]:
                kept = source[bound[i] : bound[i + 1]][kept_words(n, runs)]
                collapsed = b" ".join([raw[a:b] for a, b in zip(start[kept].tolist(), end[kept].tolist(), strict=True)])
                n_kept = len(kept)
            else:
                collapsed, n_kept = b" ".join(raw[offs[i] : offs[i + 1]].split()), n
            longest = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
            s, length, p = longest
            spelled = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
            row_out = (len(runs), s, length, p, 1000 * length // p if runs else None, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), n, n_kept, collapsed, runs)
            for column, x in zip(out.values(), row_out, strict=True):
                column.append(x)
        types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.binary(), "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}
        out["runs"] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in out["runs"]]
        columns = {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}
        columns["collapsed"] = columns["collapsed"].cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, *columns.values()], names=["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), loops=True).drop("collapsed", "runs")
