"""Line dedup over overlapping windows of three lines.

Each run of ``width`` consecutive lines is hashed (128 bits); windows that occur more
than once in the whole corpus keep their first occurrence (smallest ``doc_id``, then
place) and all later ones are covered; a line goes when any covered window holds it.
What is removed stays in the corpus at an earlier place.

Only built-in functions are used.  The windows' counts are combined before the
shuffle; the join that finds later occurrences can be split where one window is very
frequent; covered places are gathered by document, so they are bounded by its lines.

Defined results: a null text stays null; texts with fewer than ``width`` lines stay;
windows of blank lines alone are not compared; a text whose lines all go becomes
empty and its row stays; rows that agree in ``doc_id`` and text are one document and
get the same result; a long text is taken whole, in time and memory that grow with the
number of its lines; an empty table gives no rows; other columns pass through, but those
named like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Starts the names of columns that are joined to the input for a while.
OWN = "__line_windows_"
OUTPUTS = ("n_lines", "n_removed")


def _windows(lines: Column, width: int) -> Column:
    """Structs of place and hash, one for each window that is not blank."""
    at = lambda i, k: F.get(lines, i + k)

    def window(i: Column) -> Column:
        own = [at(i, k) for k in range(width)]
        return F.struct(i.alias("at"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(width), *own).alias("h2"))

    blank = lambda i: reduce(lambda a, b: a & b, [F.trim(at(i, k)) == "" for k in range(width)])
    places = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: ~blank(i)), window)


def dedup_lines(documents: DataFrame, width: int = 3) -> DataFrame:
    """``documents`` with later occurrences of repeated windows taken out of ``text``, and ``n_lines`` and ``n_removed`` (null text: 0)."""
    found = F.flatten(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: _windows(lines, width)))
    windows = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("_hash"), found.alias("_found"))
    windows = windows.select("doc_id", "_hash", F.explode("_found").alias("w")).select("doc_id", "_hash", "w.*")  # a step of its own, else the text is hashed for each window
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_hash", "at")).alias("first")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_hash") == F.col("first._hash")) & (F.col("at") == F.col("first.at"))))
    covered = later.groupBy(F.col("doc_id").alias(f"{OWN}doc"), F.col("_hash").alias(f"{OWN}text")).agg(F.collect_set("at").alias(f"{OWN}starts"))
    joined = documents.join(covered, F.col("doc_id").eqNullSafe(F.col(f"{OWN}doc")) & (F.xxhash64("text") == F.col(f"{OWN}text")), "left")
    starts = F.col(f"{OWN}starts")
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (width - 1)))))
    # the lines are bound once: a lambda that named the split itself would split the text for each line
    bound = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), gone.alias("gone")))

    def cut(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        text = F.when(x["gone"].isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(x["lines"], i)), "\n"))
        return F.struct(text.alias("text"), F.size(x["lines"]).alias("lines"), F.size(x["gone"]).alias("gone"))

    joined = joined.withColumn(f"{OWN}cut", F.when(F.col("text").isNotNull(), F.get(F.transform(bound, cut), F.lit(0))))
    done = F.col(f"{OWN}cut")
    text = F.when(starts.isNull(), F.col("text")).otherwise(done["text"])
    n_lines = F.coalesce(done["lines"], F.lit(0))
    removed = F.when(starts.isNull(), 0).otherwise(done["gone"])
    own = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c not in OUTPUTS]
    return joined.select(*own, n_lines.alias("n_lines"), removed.alias("n_removed"))


DEDUP_SQL = r"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS l FROM documents),
places AS (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, text, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS w FROM places WHERE NOT (trim(l[pos]) = '' AND trim(l[pos + 1]) = '' AND trim(l[pos + 2]) = '')),
ranked AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w),
covered AS (SELECT doc_id, text, list(DISTINCT line) AS gone FROM (SELECT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS line FROM ranked WHERE k > 1) GROUP BY doc_id, text)
SELECT doc_id, CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)), '') END AS text,
       lang, source, n_chars, coalesce(len(l), 0)::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed
FROM d LEFT JOIN covered c USING (doc_id, text)
"""
