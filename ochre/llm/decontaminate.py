"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. One pass over the texts counts the n-grams of the benchmark items.  Seeds are two
   words long for items of up to 11 words, three up to 23 and four beyond (an item of up
   to three words is one seed as a whole), as short items have few places that an edit leaves alone.
2. An item's seeds are its rarest n-grams: by the number of places in the corpus, times
   that of items which share them.  All that are rare (``RARE_PLACES``, or a share
   ``RARE_SHARE`` of the corpus' words) are taken, and at least 2 in 3 of the item's
   words plus one, so common n-grams and phrases that many items share are left out.
   With seeds of two words, words changed or left out can't break all of these in a
   copy that scores a half or more: each costs three of the item's 2n points and breaks two.
3. A second pass finds the seeds, joins the places with the items, and
   aligns each stretch around seeds of an item with the item word by word
   (Smith-Waterman), unless it has too few of the item's words to score enough.  The
   score is the best local alignment's share of the item's own score, so copies with
   words changed, put in or left out still score high.

The benchmark is the stated query set: it is taken in blocks of at most
``BLOCK_ITEMS_BYTES`` of text, each block small enough to send to the executors; each block
takes the two passes.  Places are joined with items ``PART_POSTINGS`` at a time.

Defined results: words are runs of letters and digits (and all non-ASCII) of the text
lower-cased by Spark's ``lower``; null or empty texts have none and match nothing; an item with fewer
than four words matches only where it stands as a whole; an item without words matches nothing;
repeated items match each; rows that agree in ``doc_id`` and text are one document;
rows with a null ``doc_id`` are judged like others; a long text is taken whole, in memory
of about thirty times its bytes; of equally good alignments the first counts; tables may
be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, text_bytes, written
from .hashing import mixed, piece_hashes, ragged, runs

BLOCK_ITEMS_BYTES = 4 << 20
#: Items of fewer words than each of these have seeds of so many words; others have ``MOST_WORDS``.
SEED_LENGTHS, MOST_WORDS = {12: 2, 24: 3}, 4
#: Places (times items) up to which an n-gram is rare: so many, or so many for each word of the corpus.
RARE_PLACES, RARE_SHARE = 1000, 1e-5
#: Bytes of the table of documents to be dropped that may be sent to executors, at 24 a row.
SENT_BYTES = 8 << 20
PART_POSTINGS = 1 << 20
#: Starts the names of columns that meet the input's in a join.
OWN = "__decontaminate_"
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "doc_id long, text_hash long, item_id long, score double, start_word int, end_word int"
_SEEDS = mixed(np.arange(100, 200, dtype=np.uint64)) | np.uint64(1)
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower-cased texts that lie one after the other, and where each text's words start (one more than texts)."""
    starts, lengths, text = runs(data, bounds)
    words = _WORD[data[starts]]
    hashes = piece_hashes(data, starts[words], lengths[words])
    return hashes, np.searchsorted(text[words], np.arange(len(bounds)))


def seed_words(n: np.ndarray) -> np.ndarray:
    """The length of the seeds of items of ``n`` words."""
    out = np.full(len(n), MOST_WORDS)
    for below, words in sorted(SEED_LENGTHS.items(), reverse=True):
        out[n < below] = words
    return np.where(n < 4, n, out)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on; meaningless where a text ends before."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(words), np.uint64)
        for k in range(min(n, len(words))):
            out[: len(words) - k] += words[k:] * _SEEDS[k]
    return mixed(out) ^ np.uint64(n)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with equal gaps: the best local score, and the stretch of ``passage`` it covers (from, to)."""
    width = len(passage)
    score, begin = np.zeros(width + 1, np.int64), np.arange(width + 1)
    slope = -GAP * np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        cell = np.concatenate([[0], np.maximum(diagonal, up)])
        origin = np.concatenate([[0], np.where(diagonal >= up, begin[:-1], begin[1:])])
        fresh = cell <= 0
        cell[fresh], origin[fresh] = 0, np.arange(width + 1)[fresh]
        reach = np.maximum.accumulate(cell + slope)  # gaps along the passage
        source = np.maximum.accumulate(np.where(cell + slope == reach, np.arange(width + 1), 0))
        score, begin = reach - slope, origin[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), top)
    return best


class Items(NamedTuple):
    """A block of items: their ids, their words one item after the other, and their distinct n-grams."""

    ids: list
    words: np.ndarray
    ends: np.ndarray
    sizes: list[int]  # lengths of n-grams
    grams: np.ndarray  # ascending
    gram: np.ndarray  # each posting's n-gram, by number; ascending
    item: np.ndarray
    place: np.ndarray
    own_words: np.ndarray  # keys of items with their words, ascending


def _with_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A key of a word and the item it may be of."""
    return mixed(words ^ mixed(item.astype(np.uint64) + np.uint64(1)))


def index_items(ids: list, texts: list[str]) -> Items:
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words, ends = word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds) if bounds[-1] else (np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    n = np.diff(ends)
    item = np.repeat(np.arange(len(ids)), n)
    place = np.arange(len(words)) - np.repeat(ends[:-1], n)
    size = seed_words(n)[item]
    grams = np.zeros(len(words), np.uint64)
    sizes = np.unique(size).tolist()
    for w in sizes:
        grams[size == w] = ngrams(words, w)[size == w]
    use = place + size <= n[item]
    distinct, gram = np.unique(grams[use], return_inverse=True)
    order = np.argsort(gram, kind="stable")
    return Items(ids, words, ends, sizes, distinct, gram[order], item[use][order], place[use][order], np.unique(_with_item(words, item)))


def rare_seeds(items: Items, counts: np.ndarray, total: int) -> Items:
    """``items`` with the postings of rare n-grams alone; ``counts``: places of each n-gram among ``total`` words."""
    shared = np.bincount(items.gram, minlength=len(items.grams))
    volume = (counts * shared)[items.gram]
    order = np.lexsort((items.place, volume, items.item))
    rank = np.empty(len(order), np.int64)
    sorted_ = items.item[order]
    rank[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    enough = 2 * np.diff(items.ends)[items.item] // 3 + 1
    keep = (counts[items.gram] > 0) & ((rank < enough) | (volume <= max(RARE_PLACES, RARE_SHARE * total)))
    left, gram = np.unique(items.gram[keep], return_inverse=True)
    return items._replace(grams=items.grams[left], gram=gram, item=items.item[keep], place=items.place[keep])


def _gram_places(items: Items, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, number of the n-gram) wherever an n-gram of the block stands, in the order of places."""
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(words))
    places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in items.sizes:
        if not len(items.grams) or not len(words):
            continue
        grams = ngrams(words, n)
        at = np.minimum(np.searchsorted(items.grams, grams), len(items.grams) - 1)
        hit = np.flatnonzero((items.grams[at] == grams) & (left >= n))
        places.append(hit)
        numbers.append(at[hit])
    place, number = np.concatenate(places), np.concatenate(numbers)
    order = np.argsort(place, kind="stable")
    return place[order], number[order]


def _counts(documents: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How often each n-gram of a block stands in the texts, and the number of their words."""
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own.grams) + 1, np.int64)  # the last is that of words
        for batch in blocks(batches, "text"):
            words, ends = word_hashes(*text_bytes(batch, "text"))
            total += np.bincount(np.append(_gram_places(own, words, ends)[1], len(own.grams)), minlength=len(total))
            total[-1] += len(words) - 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["gram", "n"])

    counts = np.zeros(len(items.grams) + 1, np.int64)
    for r in map_arrow(documents.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # a row an n-gram of the block
        counts[r["gram"]] = r["n"]
    return counts[:-1], int(counts[-1])


def _stretches(own: Items, words: np.ndarray, ends: np.ndarray, spot: np.ndarray, item: np.ndarray, place: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, first and last word of the stretches around seeds that have enough of the item's words to score ``least``."""
    text = np.searchsorted(ends, spot, "right") - 1
    start = spot - place  # where the item would start
    n = np.diff(own.ends)[item]
    order = np.lexsort((start, item, text))
    text, item, start, n = text[order], item[order], start[order], n[order]
    margin = n // 2 + 2
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - margin[1:] > start[:-1] + (n + margin)[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(text)) - 1
    text, item, n = text[heads], item[heads], n[heads]
    a, b = np.maximum(start[heads] - margin[heads], ends[text]), np.minimum(start[tails] + (n + margin[heads]), ends[text + 1])
    good = np.zeros(len(heads), bool)
    width = b - a
    step = np.cumsum(width) // PART_POSTINGS
    for k in np.unique(step).tolist():  # words are looked up a bounded number at a time
        lot = np.flatnonzero(step == k)
        keys = _with_item(words[ragged(a[lot], width[lot])], np.repeat(item[lot], width[lot]))
        at = np.minimum(np.searchsorted(own.own_words, keys), len(own.own_words) - 1)
        good[lot] = np.add.reduceat((own.own_words[at] == keys).astype(np.int64), np.cumsum(width[lot]) - width[lot]) >= least * n[lot]
    return text[good], item[good], a[good], b[good]


def _score(documents: DataFrame, items: Items, least: float) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in blocks(batches, "text"):
            words, ends = word_hashes(*text_bytes(batch, "text"))
            places, numbers = _gram_places(own, words, ends)
            first, last = np.searchsorted(own.gram, numbers, "left"), np.searchsorted(own.gram, numbers, "right")
            best: dict[tuple[int, int], tuple] = {}
            for spot, posting in _parts(places, first, last):
                for text, item, a, b in zip(*map(np.ndarray.tolist, _stretches(own, words, ends, spot, own.item[posting], own.place[posting], least))):
                    target = own.words[own.ends[item] : own.ends[item + 1]]
                    found, begin, end = align(target, words[a:b])
                    share = found / (MATCH * len(target))
                    row = (share, begin + a - int(ends[text]), end + a - int(ends[text]))
                    if share >= least and (-share, *row[1:]) < best.get((text, item), (0,)):
                        best[text, item] = (-share, *row[1:])
            if best:
                rows = [(t, own.ids[i], -x[0], x[1], x[2]) for (t, i), x in sorted(best.items())]
                columns = list(zip(*rows))
                at = pa.array(columns[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], names=[x.split()[0] for x in FOUND.split(", ")])

    return map_arrow(documents, score, FOUND)


def _parts(places: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places joined with postings ``first`` to ``last`` of each, at most ``PART_POSTINGS`` pairs at a time: place and posting of each pair."""
    ends = np.cumsum(last - first)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, PART_POSTINGS):
        pair = np.arange(begin, min(begin + PART_POSTINGS, int(ends[-1])))
        at = np.searchsorted(ends, pair, "right")
        yield places[at], first[at] + pair - (ends[at] - (last - first)[at])


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """A row a document and item whose alignment scores ``least`` or more: ids, the text's hash, the score and the words it covers."""
    spark: SparkSession = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("text", F.lower("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = -(-size // BLOCK_ITEMS_BYTES)
    found = []
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()  # of bounded size
        own = index_items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(own.grams):
            continue
        own = rare_seeds(own, *_counts(texts, own))
        if len(own.grams):
            found.append(_score(texts, own, least))
    if not found:
        return spark.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, found).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """``documents`` without those in which an item stands."""
    bad = written(contaminated(documents, benchmark, least).select(F.col("doc_id").alias(f"{OWN}d"), F.col("text_hash").alias(f"{OWN}t")).distinct(), "contaminated")
    if 24 * bad.count() <= SENT_BYTES:
        bad = F.broadcast(bad)
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return documents.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{OWN}d")) & (own == F.col(f"{OWN}t")), "left_anti")
