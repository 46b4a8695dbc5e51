"""Line dedup over overlapping three-line windows.

Every window of three consecutive lines is hashed (128 bits). The first place
of each window that occurs more than once is found by a partially aggregated
minimum; the later occurrences are joined back (a join Spark can split on a
hot window), their covered line numbers merge per document, and those lines go.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import arrow_map, as_bytes, keyed_texts, table, u64_as_i64, write_table

WINDOW = 3


def _window_hashes(size: int):
    def build():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            who, pos, dig = [], [], []
            for i, t in enumerate(as_bytes(b.column(2))):
                if not t:
                    continue
                lines = t.split(b"\n")
                # each line's digest first: a window's hash then takes no separator into account
                one = [blake2b(x, digest_size=16).digest() for x in lines]
                for j in range(len(lines) - size + 1):
                    if any(x.strip() for x in lines[j : j + size]):
                        who.append(i)
                        pos.append(j)
                        dig.append(blake2b(b"".join(one[j : j + size]), digest_size=16).digest())
            h = np.frombuffer(b"".join(dig), dtype=np.uint64).reshape(-1, 2)
            w = np.array(who, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[w]), pa.array(ths[w]), pa.array(np.array(pos, dtype=np.int32)), u64_as_i64(h[:, 0].copy()), u64_as_i64(h[:, 1].copy())],
                names=["_id", "_th", "pos", "h1", "h2"],
            )

        return work

    return build


def repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, starts): per document the starts of windows that begin earlier
    elsewhere (smaller id, then text hash, then line)."""
    w = arrow_map(keyed_texts(docs, id_col, text_col), _window_hashes(window), "_id long, _th long, pos int, h1 long, h2 long")
    place = F.struct("_id", "_th", "pos")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "f")
    first = write_table(first, "line-first")  # plain shuffles on both sides of the join: a hot window can be split
    later = w.join(first, ["h1", "h2"]).where(place > F.col("f"))
    # a document's starts are fewer than its lines
    return later.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): ``row`` is the input row as a struct.

    Lines are cut at ``\\n`` and compared exactly. A window of three lines (not
    all blank) that starts earlier in the corpus is a repeat; every line covered by
    a repeat is removed, windows being judged on the input. Null text stays null,
    empty text and texts of fewer than three lines stay as they are. Rows with
    the same id and text are one place: none is a repeat of the other. Ids that
    are null sort first. An empty table gives an empty result."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(text_col)
    base = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    j = base.join(repeated_lines(docs, window, id_col, text_col), ["_id", "_th"], "left")
    lines = F.split("_text", "\n", -1)
    # covered line numbers: each start covers `window` lines; a set, so overlaps merge
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    flags = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.when(F.col("starts").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(flags, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("_text").isNull() | (F.length("_text") == 0), 0).otherwise(F.size(lines))
    return j.select("row", kept.alias("text"), n.alias("n_lines"), F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the kept lines, UTF-8)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM l WHERE len(ls) >= 3),
x AS (SELECT doc_id, pos, ls[pos + 1 : pos + 3] AS win FROM w),
y AS (SELECT * FROM x WHERE regexp_matches(array_to_string(win, ''), '[^\\x20\\x09-\\x0D]')),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM y),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE r > 1),
k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE
    array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN k USING (doc_id)
"""
