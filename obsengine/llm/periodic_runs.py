"""Periodic runs of words, by online dyadic square catching, and texts with such runs collapsed to one period.

Words are runs of characters other than the ASCII white space. A run is a stretch of consecutive words with smallest period q (words
q apart are identical) that no neighbouring word extends, of at least max(least_words, least_exponent * q) words.

Words are appended one after the other. On level L = 1, 2, 4, ... every completed block of L words, with the L words after
it, is the pattern of a catcher. The catcher waits for the pattern to come again at a distance d of L to 2 L - 1 words: then the
pattern, d words and the pattern's second coming are a repetition with period d and hold a square. At each word one catcher a level is
awake, so a word costs one comparison a level: that of the suffix of 2 L words that it completes with the pattern, by
fingerprints which are doubled from level to level. A catch is checked word by word as it is extended to both sides; squares
of one period that overlap are one run. A run of four periods or more holds a whole pattern and its second coming on the
level of its period, wherever blocks start, so none is missed; fingerprints only nominate. What lies in a run of a
smaller period, found on a lower level, is not looked at again, so a period is the smallest one.

Words are appended an Arrow batch at a time: the steps of all words of a level are one array operation. The texts of a
batch stand one after the other, longest first, each closed by a word of its own that nothing equals, so no square
crosses texts, and a level is only as long as the texts that can hold its periods. A text is never cut, and its row is
worked on alone: there is no shuffle.

Cases: a null, empty or blank text has no words, no runs and an empty rest; rows of null or equal doc_id are worked on one by
one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from obsengine.llm.common import id_and_text, per_batch, raw_texts

_RUN = "struct<start:long,length:long,period:long>"


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Words as numbers, one text after the other, each with a closing word that equals no other."""
    flat = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.empty(int(sizes.sum()) + len(texts), np.uint64)
    closing = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(out), bool)
    inside[closing] = False
    out[inside] = flat.indices.to_numpy(zero_copy_only=False)
    out[closing] = len(flat.dictionary) + np.arange(len(texts))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _equal_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements a and b share from the front."""
    n, step, at = min(len(a), len(b)), 64, 0
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def catch(words: np.ndarray, sizes: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a stream of texts with these sizes (longest first, closing words included in words)."""
    ends = np.cumsum(sizes + 1)
    runs: list[tuple[int, int, int]] = []
    held, ends_held = np.empty(0, np.int64), np.empty(0, np.int64)  # stretches found, by start, and the furthest end so far
    stretches: list[tuple[int, int]] = []
    prints, L = _mixed(words + np.uint64(1)), 1
    while len(ends) and (long := int(np.searchsorted(-sizes, -max(least_words, least_exponent * L), "right"))):
        n = int(ends[long - 1])
        prints = _mixed(prints[: n - 2 * L + 1] + _mixed(prints[L : n - L + 1]))  # of 2 L words
        at = np.arange(L, len(prints))
        caught = at[prints[L:] == np.repeat(prints[::L], L)[: len(prints) - L]] if len(prints) > L else at[:0]
        block = (caught // L - 1) * L
        block, first = np.unique(block, return_index=True)  # the least distance of each
        gap = caught[first] - block
        if len(held):
            k = np.searchsorted(held, block, "right") - 1
            open_ = (k < 0) | (ends_held[k] < block + 2 * L + gap)
            block, gap = block[open_], gap[open_]
        last = (0, 0, 0)
        for s, d in zip(block.tolist(), gap.tolist(), strict=True):
            if d == last[2] and s + 2 * L + d <= last[1]:
                continue
            left = _equal_for(words[:s][::-1], words[: s + d][::-1])
            right = _equal_for(words[s:], words[s + d :])
            if right < 2 * L:  # only the fingerprints were equal
                continue
            last = (s - left, s + right + d, d)
            stretches.append(last[:2])
            if last[1] - last[0] >= max(least_words, least_exponent * d):
                runs.append((last[0], last[1] - last[0], d))
        if len(stretches) > len(held):
            stretches.sort()
            both = np.array(stretches, np.int64)
            held, ends_held = both[:, 0], np.maximum.accumulate(both[:, 1])
        L *= 2
    return sorted(runs)


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_exponent: int = 4, edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of documents: doc_id, n_words, runs (start, length and period in words, by start, then period), strongest (the run
    with the greatest length / period, ties: smallest start, then period; null without runs) and collapsed: the words, one
    space between, without those that a run holds after its first period.

    least_exponent is 4 at least. edit: from a doc_id and its words to the words that take their place."""
    if least_exponent < 4:
        raise ValueError("runs of fewer than four periods can pass between the blocks: least_exponent is 4 at least")
    docs = id_and_text(documents, id_col, text_col)

    def make():
        def f(batch):
            texts = [(raw or b"").split() for raw in raw_texts(batch)]
            if edit:
                texts = [edit(k, words) for k, words in zip(batch.column(0).to_pylist(), texts, strict=True)]
            order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
            sizes = np.array([len(texts[k]) for k in order], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for s, n, q in catch(_numbered([texts[k] for k in order]), sizes, least_words, least_exponent):
                k = int(np.searchsorted(starts, s, "right")) - 1
                found[order[k]].append((s - int(starts[k]), n, q))
            rest, best = [], []
            for words, runs in zip(texts, found, strict=True):
                best.append(max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None))
                if runs:
                    kept = np.ones(len(words), bool)
                    for s, n, q in runs:
                        kept[s + q : s + n] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                rest.append(b" ".join(words))
            named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            return {"doc_id": batch.column(0), "n_words": [len(w) for w in texts], "runs": [list(map(named, runs)) for runs in found], "strongest": list(map(named, best)), "collapsed": pa.array(rest, pa.binary()).cast(pa.string())}

        return f

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")])
    return per_batch(docs, schema, make)
