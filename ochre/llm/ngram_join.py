"""Grouped prefix join: documents whose word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts gives each document's number of shingles, a 128-bit
   signature of its set and four minima under independent hashes, and counts all
   shingles in a sketch of fixed size.  Documents with one signature are one class.
2. Classes that share a minimum are compared with the first of them.  Links found
   here join large groups of near copies at a cost in proportion to their number.
3. A second pass orders each set from rare to frequent (by the sketch; the order is
   total, so it loses nothing) and keeps the prefix in which two similar sets must
   meet.  Documents of one component with the same prefix and size are one group.
   Only shingles that stand in prefixes of two or more components matter any more;
   pairs of groups that meet there are filtered by size and place (groups alike in
   both stand for each other), expanded to members, and verified on whole sets.
4. Links of both steps give the components.

A pair is verified as part of a star: the hub's set is held once while the others
stream past; stars are salted, so a hub with many partners is shared by many tasks.
Only pairs of different components are ever candidates in step 3, so a group of near
copies doesn't make all its pairs.

What is sent to executors is bounded: the sketch (``2 ** SKETCH_BITS`` bytes, through
files in the shared folder), and sets of ids or shingles of at most ``SENT_BYTES``;
beyond that a shuffle join takes their place.

Defined results: null or empty text, or one without words, has 0 shingles and is its
own component; a text with fewer than five words is one shingle; a row with a null
``doc_id`` is linked with nothing and its component is null; rows that share a
``doc_id`` are one node; a long text is taken whole; an empty table gives no rows; other
columns are ignored.  The result is a written table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, filesystem, map_arrow, scratch, shuffle_partitions, temporary, text_bytes, written
from .components import connected_components
from .hashing import LOWER, mixed, piece_hashes, spaced_words

WORDS = 5
#: Similarity as a fraction: 100 * |A & B| >= 80 * |A | B|.
PART, WHOLE = 4, 5
MINIMA = 4
SKETCH_BITS, CHUNK_BITS = 25, 17
#: Bytes of a set of ids or shingles that may be sent to executors, at 16 a row as Spark hashes it.
SENT_BYTES = 16 << 20
#: Members of a star that one task compares with its hub.
STAR_ROWS = 64
_SEEDS = mixed(np.arange(1, 64, dtype=np.uint64))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    texts = len(bounds) - 1
    starts, lengths, text = spaced_words(data, bounds)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * texts
    word = piece_hashes(LOWER[data], starts, lengths)
    with np.errstate(over="ignore"):
        whole = np.zeros(len(word), np.uint64)
        for k in range(min(WORDS, len(word))):
            whole[: len(word) - k] += word[k:] * (_SEEDS[k] | np.uint64(1))
        n = np.bincount(text, minlength=texts)
        first = np.cumsum(n) - n
        use = np.zeros(len(word), bool)
        use[: len(word) - WORDS + 1] = text[: len(word) - WORDS + 1] == text[WORDS - 1 :] if len(word) >= WORDS else False
        for t in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
            i = first[t]
            whole[i] = np.uint64(n[t]) + (word[i : i + n[t]] * (_SEEDS[20 : 20 + n[t]] | np.uint64(1))).sum(dtype=np.uint64)
            use[i] = True
    shingles = mixed(whole[use])
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[use], minlength=texts))]).tolist()
    return [np.unique(shingles[a:b]) for a, b in zip(ends[:-1], ends[1:])]


MARKS = f"doc_id long, n int, s1 long, s2 long, {', '.join(f'm{k} long' for k in range(MINIMA))}, chunk int, counts binary"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document; then the task's sketch, a row a chunk (``doc_id`` null, ``chunk`` set)."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint8)
    names = [x.split()[0] for x in MARKS.split(", ")]
    for batch in blocks(batches, "text"):
        sets = shingle_sets(*text_bytes(batch, "text"))
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        spot, more = np.unique(flat >> np.uint64(64 - SKETCH_BITS), return_counts=True)
        counts[spot] = np.minimum(counts[spot] + more, 255)  # more makes no difference
        sums = np.zeros((2 + MINIMA, len(sets)), np.uint64)
        full = n > 0
        if full.any():
            at = (np.cumsum(n) - n)[full]
            for k in range(2):
                sums[k, full] = np.add.reduceat(mixed(flat ^ _SEEDS[30 + k]), at)
            for k in range(MINIMA):
                sums[2 + k, full] = np.minimum.reduceat(mixed(flat ^ _SEEDS[40 + k]), at)
        empty = len(sets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int32)), *map(pa.array, sums.view(np.int64)), pa.nulls(empty, pa.int32()), pa.nulls(empty, pa.binary())], names=names)
    chunks = counts.reshape(-1, 1 << CHUNK_BITS)
    for i in np.flatnonzero(chunks.any(axis=1)).tolist():
        row = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * (2 + MINIMA), pa.array([i], pa.int32()), pa.array([zlib.compress(chunks[i].tobytes(), 1)], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, names=names)


def _sketch(marks: DataFrame) -> str:
    """Merges the tasks' sketches; a chunk is a file in the shared folder, a byte a counter, on a log scale.  Returns the folder."""
    folder = scratch(marks.sparkSession, "sketch")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the chunks dealt to this task
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), np.uint8)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint32)
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        for chunk, own in sums.items():
            name = f"{path}/{chunk}-{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(np.minimum(8 * np.log2(1.0 + own), 255).astype(np.uint8).tobytes())
            store.move(name, f"{path}/{chunk}")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32())], names=["chunk"])

    rows = marks.where("chunk is not null").select("chunk", "counts")
    map_arrow(rows.repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk"), merge, "chunk int").count()
    return folder


def _read_sketch(folder: str) -> np.ndarray:
    from pyarrow import fs

    sketch = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    store, path = filesystem(folder)
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.isdigit():
            with store.open_input_file(info.path) as file:
                sketch[int(info.base_name)] = np.frombuffer(file.read(), np.uint8)
    return sketch.ravel()


def _prefixes(documents: DataFrame, folder: str) -> DataFrame:
    """``doc_id, n, prefix``: a set's first shingles from rare to frequent, among which any similar set has one."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _read_sketch(folder)
        for batch in blocks(batches, "text"):
            sets = shingle_sets(*text_bytes(batch, "text"))
            out = []
            for s in sets:
                size = len(s) - -(-PART * len(s) // WHOLE) + 1 if len(s) else 0
                out.append(s[np.lexsort((s, counts[s >> np.uint64(64 - SKETCH_BITS)]))[:size]].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], names=["doc_id", "n", "prefix"])

    return map_arrow(documents, prefix, "doc_id long, n int, prefix array<long>")


def _check_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and salt with the hub's own first; yields the verified links."""
    place, hubs = None, []
    for batch in blocks(batches, "text"):
        u, v = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "member", "id")), shingle_sets(*text_bytes(batch, "text")))
        for hub, salt, member, key, own in rows:
            if place != (hub, salt):
                place, hubs = (hub, salt), []
            if not member:
                if not any(np.array_equal(own, h) for h in hubs):
                    hubs.append(own)
                continue
            for other in hubs:
                a, b = (own, other) if len(own) <= len(other) else (other, own)
                if WHOLE * len(a) < PART * len(b) or not len(a):
                    continue
                at = np.searchsorted(b, a)
                both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
                if (PART + WHOLE) * both >= PART * (len(a) + len(b)):
                    u.append(key)
                    v.append(hub)
                    break
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _small(df: DataFrame) -> DataFrame:
    """``df``, of one or two numbers a row, marked for broadcast if it is small; a written table, as it is counted."""
    return F.broadcast(df) if 8 * (1 + len(df.columns)) * df.count() <= SENT_BYTES else df


def verified_links(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of ids whose texts are similar; v is each star's hub."""
    pairs = written(pairs, "pairs")
    stars = pairs.groupBy(F.col("v").alias("hub")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_salts", F.ceil(F.col("_n") / STAR_ROWS).cast("int"))
    members = pairs.join(stars, F.col("v") == F.col("hub")).select(F.col("u").alias("id"), "hub", F.pmod(F.xxhash64("u"), F.col("_salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    centres = stars.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    needed = written(members.unionByName(centres), "stars")
    ids = written(needed.select(F.col("id").alias("doc_id")).distinct(), "ids")
    texts = documents.join(_small(ids), "doc_id", "left_semi")
    rows = texts.join(needed, F.col("doc_id") == F.col("id")).select("hub", "salt", "member", "id", "text")
    dealt = rows.repartition(shuffle_partitions(documents.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "member", "id")
    return written(map_arrow(dealt, _check_stars, "u long, v long").distinct(), "links")


def _star_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes that share a minimum: each with the first of those that do."""
    minima = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(MINIMA)]))
    rows = classes.select("id", "n", minima.alias("x")).select("id", "n", "x.k", "x.m")
    hubs = rows.groupBy("k", "m").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    near = (WHOLE * F.least("n", "hub.n") >= PART * F.greatest("n", "hub.n")) & (F.col("id") != F.col("hub.id"))
    return rows.join(hubs, ["k", "m"]).where(near).select(F.col("id").alias("u"), F.col("hub.id").alias("v")).distinct()


def _cross_pairs(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of ids in different components whose prefixes meet and whose sizes and places allow the similarity."""
    own = prefixes.join(_small(labels), F.col("doc_id") == F.col("id")).select("id", "component", "n", "prefix", F.xxhash64("prefix", "n").alias("group"))
    own = written(own, "prefixes")
    ones = written(own.groupBy("group", "component", "n").agg(F.min("id").alias("one")).select("one"), "groups")
    groups = own.join(_small(ones), F.col("id") == F.col("one"), "left_semi").select("group", "component", "n", "prefix")
    at = F.posexplode("prefix").alias("at", "shingle")
    shared = groups.select("component", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("shingle")
    shared = written(shared, "shared")
    met = written(groups.select("group", "component", "n", at).join(_small(shared), "shingle"), "met")
    # groups with one component, size and place meet others alike, so they stand for each other here
    kinds = written(met.select("shingle", "component", "n", "at").distinct(), "kinds")
    a = kinds.where((PART + WHOLE) * (F.col("n") - F.col("at")) >= 2 * PART * F.col("n")).select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("component", "n", "at")])
    b = kinds.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("component", "n", "at")])
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("component_a") < F.col("component_b"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("component_a") != F.col("component_b")) & smaller & (WHOLE * F.col("n_a") >= PART * F.col("n_b")) & ((PART + WHOLE) * rest >= PART * (F.col("n_a") + F.col("n_b")))
    hits = written(a.join(b, "shingle").where(fits), "kind-pairs")
    side = lambda x: met.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("group", "component", "n", "at")])
    pairs = hits.join(side("a"), ["shingle", "component_a", "n_a", "at_a"]).join(side("b"), ["shingle", "component_b", "n_b", "at_b"])
    pairs = pairs.select("group_a", F.col("component_a").alias("ca"), "n_a", "group_b", F.col("component_b").alias("cb"), "n_b").distinct()
    members = own.select("group", "component", "n", "id")
    left = members.select(*[F.col(c).alias(x) for c, x in (("group", "group_a"), ("component", "ca"), ("n", "n_a"), ("id", "u"))])
    right = members.select(*[F.col(c).alias(x) for c, x in (("group", "group_b"), ("component", "cb"), ("n", "n_b"), ("id", "v"))])
    return pairs.join(left, ["group_a", "ca", "n_a"]).join(right, ["group_b", "cb", "n_b"]).select("u", "v").distinct()


def similar_documents(documents: DataFrame) -> DataFrame:
    """A row a document: ``doc_id, n_shingles, component_id``."""
    with temporary(documents.sparkSession) as keep:
        return keep(written(_similar(documents), "similar"))


def _similar(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = written(map_arrow(rows, _marks, MARKS), "marks")
    known = marks.where("chunk is null")
    classes = known.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), *[F.first(f"m{k}").alias(f"m{k}") for k in range(MINIMA)])
    classes = written(classes, "classes")
    real = rows.where("doc_id is not null")

    links = verified_links(real, _star_pairs(classes))
    # a doc_id that comes with several sets ties their classes together
    sets = F.struct("n", "s1", "s2")
    split = known.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("_a"), F.max(sets).alias("_b")).where("_a <> _b").select("doc_id")
    if split.take(1):
        of = known.join(split, "doc_id").join(classes.select("n", "s1", "s2", "id"), ["n", "s1", "s2"]).select("doc_id", "id").distinct()
        links = links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").where("id <> v").select(F.col("id").alias("u"), "v"))
    nodes = classes.select("id").distinct()
    first = connected_components(links)
    labels = written(nodes.join(first, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    # of documents with equal sets only one needs a prefix
    more = verified_links(real, _cross_pairs(_prefixes(real.join(_small(labels.select("id")), F.col("doc_id") == F.col("id"), "left_semi"), _sketch(marks)), labels))
    final = connected_components(first.select(F.col("vertex").alias("u"), F.col("component").alias("v")).unionByName(more)) if more.take(1) else first
    found = classes.select("n", "s1", "s2", "id").join(final, F.col("id") == F.col("vertex"), "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("_c"))
    joined = known.select("doc_id", "n", "s1", "s2").join(found, ["n", "s1", "s2"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, similar: DataFrame) -> DataFrame:
    """``documents`` with one row of each component of ``similar``, the one with the smallest id; rows with a null id stay.  ``similar`` is a written table."""
    gone = similar.where("doc_id <> component_id").select(F.col("doc_id").alias("__ngram_join_gone")).distinct()
    kept = documents.join(_small(written(gone, "gone")), F.col("doc_id") == F.col("__ngram_join_gone"), "left_anti")
    twice = similar.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not twice.take(1):
        return kept
    single = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return single.unionByName(kept.where("doc_id is null"))


SIMILAR_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, m FROM reached JOIN sides ON x = doc_id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
