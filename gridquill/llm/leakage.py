"""Evaluation passages inside corpus documents."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce
from math import ceil, floor

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Consecutive words of a passage that make a document a case.
VERBATIM_WORDS = 12
#: Share of a passage's words, in order, and the stretch they may be spread over.
PARTIAL_SHARE, STRETCH = Fraction(3, 4), Fraction(3, 2)
#: Words of passages and answers that one automaton is built from, at most: that bound is
#: what allows it to be broadcast.  A larger set of items is scanned for in blocks of that size.
AUTOMATON_WORDS = 5_000_000

_WORD = re.compile(r"[^\W_]+")
_OUT = "doc_id bigint, item_id bigint, match_kind string, start_char int, end_char int, matched_words int, answer_present boolean"


def words(text: str) -> list[tuple[str, int, int]]:
    """Maximal runs of letters and digits in lower case, with their offsets in ``text``."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Compiled:
    """Items as one automaton over word numbers.

    Its patterns are the runs of ``verbatim`` words, the answers, and single
    rare words of the passages.  A stretch with three quarters of a passage
    lacks a quarter of its words at most, so of any set of word positions it
    holds all but as many: the rarest half is watched for, and a stretch is a
    candidate where enough of it occurs.  That loses none.
    """

    def __init__(self, items: Sequence[tuple[int, str | None, str | None]], verbatim: int = VERBATIM_WORDS) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.masks: list[dict[int, int]] = []
        patterns: dict[tuple[int, ...], tuple[set[int], set[int], set[int]]] = {}
        sequences: list[list[int]] = []
        at = lambda key: patterns.setdefault(tuple(key), (set(), set(), set()))
        for item_id, passage, answer in items:
            sequence = [self.number(w) for w, _, _ in words(passage or "")]
            if not sequence:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(sequence))
            sequences.append(sequence)
            masks: dict[int, int] = {}
            for i, w in enumerate(sequence):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            for i in range(len(sequence) - verbatim + 1):
                at(sequence[i:i + verbatim])[0].add(k)
            if spoken := [self.number(w) for w, _, _ in words(answer or "")]:
                at(spoken)[1].add(k)
        self.needs = [ceil(PARTIAL_SHARE * n) for n in self.sizes]
        self.spans = [floor(STRETCH * n) for n in self.sizes]
        # How many watched words a stretch must hold.
        self.least: list[int] = []
        spread_over = Counter(w for sequence in sequences for w in set(sequence))
        for k, sequence in enumerate(sequences):
            lacking = len(sequence) - self.needs[k]
            watched = sorted(sequence, key=lambda w: (spread_over[w], w))[:max(lacking + 1, ceil(len(sequence) / 2))]
            self.least.append(len(watched) - lacking)
            for w in set(watched):
                at((w,))[2].add(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, (grams, answers, rare) in patterns.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(grams)), tuple(sorted(answers)), tuple(sorted(rare))))
        self.empty = not patterns
        if not self.empty:
            self.automaton.make_automaton()

    def number(self, word: str) -> int:
        return self.vocabulary.setdefault(word, len(self.vocabulary) + 1)

    def stretches(self, hits: Sequence[int], k: int) -> Iterator[tuple[int, int]]:
        """Where a stretch may hold item ``k``, given the places of its watched words: half-open, apart from each other."""
        span, least = self.spans[k], self.least[k]
        held: tuple[int, int] | None = None
        for first in range(len(hits) - least + 1):
            last = first + least - 1
            if hits[last] - hits[first] < span:
                low, high = max(0, hits[last] - span + 1), hits[first] + span
                if held is not None and low <= held[1]:
                    held = held[0], max(held[1], high)
                else:
                    if held is not None:
                        yield held
                    held = low, high
        if held is not None:
            yield held

    def partial(self, numbers: Sequence[int], k: int) -> tuple[int, int, int] | None:
        """First stretch of ``numbers`` with enough of item ``k``'s words in order: ``(from, to, matched)``."""
        masks, need, span, size = self.masks[k], self.needs[k], self.spans[k], self.sizes[k]
        hits = [(i, masks[w]) for i, w in enumerate(numbers) if w in masks]
        full = (1 << size) - 1
        last = 0
        for a, (at, _) in enumerate(hits):
            while last < len(hits) and hits[last][0] < at + span:
                last += 1
            if last - a < need:
                continue
            free = full  # longest common subsequence, one bit per passage word
            for i, mask in hits[a:last]:
                u = free & mask
                free = ((free + u) | (free - u)) & full
                if size - free.bit_count() >= need:
                    return at, i, need
        return None

    def find(self, text: str) -> list[tuple[int, str, int, int, int, bool]]:
        """Items in a text: ``(item, kind, start, end, matched words, answer present)``."""
        tokens = words(text)
        get = self.vocabulary.get
        sequence = tuple([get(w, 0) for w, _, _ in tokens])
        if self.empty or not any(sequence):
            return []
        found: dict[int, tuple[str, int, int, int]] = {}
        answers: set[int] = set()
        places: dict[int, list[int]] = {}
        for end, (length, grams, spoken, rare) in self.automaton.iter(sequence):
            for k in grams:
                if k not in found:
                    found[k] = ("verbatim", end - length + 1, end, length)
            for k in rare:
                if k in places:
                    places[k].append(end)
                else:
                    places[k] = [end]
            if spoken:
                answers.update(spoken)
        for k, hits in places.items():
            if k not in found and len(hits) >= self.least[k]:
                for low, high in self.stretches(hits, k):
                    if (hit := self.partial(sequence[low:high], k)) is not None:
                        found[k] = ("partial", low + hit[0], low + hit[1], hit[2])
                        break
        return [(self.ids[k], kind, tokens[a][1], tokens[b][2], n, k in answers) for k, (kind, a, b, n) in found.items()]


#: Automata of this Python worker, by broadcast; a worker runs many tasks.
_BUILT: dict[str, Compiled] = {}


def _scan(items: Broadcast[list[tuple[int, str | None, str | None]]], token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _BUILT.get(token)
        if compiled is None:
            _BUILT.clear()
            compiled = _BUILT[token] = Compiled(items.value)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for hit in compiled.find(text)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            names = ("doc_id", "item_id", "match_kind", "start_char", "end_char", "matched_words", "answer_present")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return run


def find_leaks(documents: DataFrame, items: DataFrame, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Documents that contain evaluation items, wholly or in part.

    Result: ``doc_id``, ``item_id``, ``match_kind``, ``start_char`` and
    ``end_char`` (offsets in the original text), ``matched_words``,
    ``answer_present`` (the item's answer occurs in the document too); one row
    per document and item.  ``verbatim``: twelve consecutive words of the
    passage; ``partial``: within a stretch of 1.5 times the passage's words,
    three quarters of them in order.

    One Aho-Corasick automaton over the normalised passages and answers scans
    each text once, whole, whatever its length; both kinds come from its hits.
    Candidates for near matches are settled by an exact longest common
    subsequence (see ``Compiled``).  Null or empty texts hold nothing, items
    without words are in nothing, a repeated item id gives its best match.

    The items are broadcast, up to ``automaton_words`` words (counted); a larger
    set is split by words and the corpus scanned once per block.
    """
    spark = documents.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "passage", "answer")
    length = F.length(F.coalesce("passage", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    # a word takes two characters with the one before the next
    most = known.agg(F.sum((length / 2).cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-most // automaton_words))
    texts = spread(documents.where(F.col("text") != "").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scans = []
    for k in range(blocks):
        block = known.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k) if blocks > 1 else known
        held = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        scans.append(texts.mapInArrow(_scan(held, uuid.uuid4().hex), _OUT))
    hits = reduce(DataFrame.unionByName, scans)
    # "verbatim" sorts after "partial"; the largest struct is the better match
    best = F.max(F.struct("match_kind", "matched_words", "start_char", "end_char", "answer_present")).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.match_kind", "b.start_char", "b.end_char", "b.matched_words", "b.answer_present")
