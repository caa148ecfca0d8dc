"""Held-out test items that stand, wholly or in part, in a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of item text in one broadcast; longer lists are searched for in blocks of this size.
BLOCK_CHARS = 16_000_000
_GAP = re.compile(r"[\W_]+")


def word_list(text: str) -> list[str]:
    """Lower-cased runs of letters or digits of any script."""
    return _GAP.sub(" ", text.lower()).split()


def pieces(words: list[str], run: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item: as few as keep each at most half of run + 1 words long, and alike.

    Any run consecutive words of the item then hold a whole piece, and any copy with fewer edits than pieces does.
    """
    most = max(1, (run + 1) // 2)
    n = -(-len(words) // most)
    cuts = [round(i * len(words) / n) for i in range(n + 1)] if n else []
    return list(zip(cuts, cuts[1:]))


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance, in words, of pattern to any run of text; bit-parallel, one bit a pattern word."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def _searcher(items: list[tuple[int, list[str]]], run: int):
    """A function from text to (item, distance, longest run, pieces found) for the items it holds a piece of."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    found: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, words) in enumerate(items):
        for a, b in pieces(words, run):
            found.setdefault(f" {' '.join(words[a:b])} ", []).append((k, a, b))
    for piece, where in found.items():
        machine.add_word(piece, where)
    if found:
        machine.make_automaton()

    def search(text: str) -> list[tuple[int, int, int, int]]:
        if not found:
            return []
        flat = f" {_GAP.sub(' ', text.lower()).strip()} "
        hits: dict[int, set[tuple[int, int]]] = {}
        for end, where in machine.iter(flat):
            for k, a, b in where:
                hits.setdefault(k, set()).add((end, b))
        if not hits:
            return []
        words = flat.split()
        starts: list[int] | None = None
        out = []
        for k, ends in hits.items():
            if starts is None:  # the number of words up to each space of flat
                starts = [m.start() for m in re.finditer(" ", flat)]
                index = {p: i for i, p in enumerate(starts)}
            item = items[k][1]
            budget = len(pieces(item, run)) - 1
            distance, longest, seen = len(item), 0, set()
            for end, b in sorted(ends):
                shift = index[end] - b  # where the item would begin in the document
                if shift in seen:
                    continue
                seen.add(shift)
                lo, hi = max(0, shift - budget), max(0, shift + len(item) + budget)
                distance = min(distance, myers(item, words[lo:hi]))
                now = 0
                for i in range(max(0, -shift), min(len(item), len(words) - shift)):
                    now = now + 1 if item[i] == words[shift + i] else 0
                    longest = max(longest, now)
            out.append((items[k][0], distance, longest, len(ends)))
        return out

    return search


def leaked_items(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12) -> DataFrame:
    """doc, item, distance, longest_run, n_pieces, budget, n_words: each document with each item it holds a piece of.

    An item of n_words words is cut into budget + 1 pieces of at most (run + 1) / 2 words. A copy with at most budget
    word edits, and any copy of run consecutive words, keeps one of them whole (pigeonhole). Hits of pieces are found by
    one pass of an automaton over the document's words, and verified on each diagonal: distance is the least number of
    word edits between the item and the document near the hit (Myers, bit-parallel), longest_run the most consecutive
    words of the item there. leaked() says which count.

    Words are runs of letters or digits of any script, in lower case. Null texts, and items without words, match
    nothing. Equal items are each reported. Repeated rows of documents give repeated rows. Other columns are ignored.

    Items are broadcast in blocks of at most BLOCK_CHARS characters (with the longest item as its least size); each
    block is one pass over the documents, which are never shuffled.
    """
    listed = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct()
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS) * 2 if chars > BLOCK_CHARS else 1)
    kind = {f.name: f.dataType for f in documents.schema}[doc], {f.name: f.dataType for f in items.schema}[item]
    schema = T.StructType([T.StructField("doc", kind[0]), T.StructField("item", kind[1]), *[T.StructField(c, T.IntegerType()) for c in ("distance", "longest_run", "n_pieces")]])
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def block(i: int) -> DataFrame:
        part = listed.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) if n > 1 else listed
        held = documents.sparkSession.sparkContext.broadcast([(r.item, word_list(r.text)) for r in part.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _searcher(held.value, run)
            for b in batches:
                out = [(d, *hit) for d, x in zip(b.doc, b.text) for hit in find(x)]
                yield pd.DataFrame(out, columns=["doc", "item", "distance", "longest_run", "n_pieces"])

        return rows.mapInPandas(search, schema)

    out = reduce(DataFrame.unionAll, (block(i) for i in range(n)))
    return out.withColumnsRenamed({"doc": doc, "item": item})


def leaked(found: DataFrame, run: int = 12, share: float = 0.15) -> DataFrame:
    """Of leaked_items, the rows that leak: by run consecutive words, or by a copy whose distance in words is at most
    share of the longest run it has of the item."""
    return found.where((F.col("longest_run") >= run) | (F.col("distance") <= share * F.col("longest_run")))
