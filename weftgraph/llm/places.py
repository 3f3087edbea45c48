"""Rows by their place, so that a decision about rows reaches their texts without moving a text.

`numbered` gives every row of a Parquet scan one number: its file's first number plus its place in the file. The numbers are the
same on each read, in any number of tasks, so a task can read its part of the table again and know what was decided about its
rows. `within` does that: decisions travel as bitmaps of 64 rows a word, broadcast, and the texts stay where they are read.

A broadcast holds at most MOST_WORDS words (of 16 bytes and a hash table's slack). Larger decisions are applied in rounds, each
over a range of files, whose results are written to the shared folder; a file with more words than that is joined by a shuffle.
One row a file is brought to the driver, which lists the files itself.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The column of row numbers.
RID = "_weft_rid"
#: Words of 64 rows in one broadcast.
MOST_WORDS = 1 << 21


def _scan(df: DataFrame) -> bool:
    """Whether the frame is a Parquet scan, some of its columns or expressions of them at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


def _file(df: DataFrame) -> Column:
    return F.xxhash64(df.metadataColumn("_metadata")["file_path"])


class Numbered:
    """A frame whose rows are numbered: `rows` is the frame with the column RID, `starts` the files' hashes and first numbers."""

    def __init__(self, df: DataFrame, name: str = "numbered"):
        self.scan = df if _scan(df) else common.materialise(df, name)
        meta = self.scan.metadataColumn("_metadata")
        sizes = self.scan.select(_file(self.scan).alias("h"), meta["file_path"].alias("path")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("path") == F.max("path")).alias("one"))
        self.starts, self.total = [], 0
        at = 0
        for r in sorted(sizes.collect()):
            if not r["one"]:
                raise ValueError("two files of the table have one hash")
            self.starts.append((r["h"], at))
            self.total += r["n"]
            at += -(-r["n"] // 64) * 64  # words of 64 rows never span two files
        self.end = at
        self.columns = df.columns

    def _rows(self, scan: DataFrame) -> DataFrame:
        files = F.broadcast(scan.sparkSession.createDataFrame(self.starts, "_weft_h long, _weft_at long"))
        placed = scan.withColumns({"_weft_f": _file(scan), "_weft_r": scan.metadataColumn("_metadata")["row_index"]})
        return placed.join(files, F.col("_weft_f") == F.col("_weft_h")).select(*[placed[c] for c in self.columns], (F.col("_weft_at") + F.col("_weft_r")).alias(RID))

    @property
    def rows(self) -> DataFrame:
        return self._rows(self.scan)

    def within(self, wanted: DataFrame, keep: bool = True, most_words: int | None = None) -> DataFrame:
        """The numbered rows that are in wanted (a column RID), or with keep=False those that aren't. No row is shuffled."""
        most = most_words or MOST_WORDS
        bit = F.expr(f"shiftleft(1L, cast({RID} % 64 as int))")
        words = common.materialise(wanted.select(RID).groupBy(F.shiftright(RID, 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "words")
        n = words.count()

        def taken(rows: DataFrame, some: DataFrame) -> DataFrame:
            at = rows.join(some.select(F.col("word").alias("_weft_w"), F.col("bits").alias("_weft_b")), F.shiftright(RID, 6) == F.col("_weft_w"), "inner" if keep else "left")
            hit = F.getbit(F.coalesce("_weft_b", F.lit(0).cast("long")), F.pmod(RID, F.lit(64)).cast("int")) == 1
            return at.where(hit if keep else ~hit).drop("_weft_w", "_weft_b")

        if n <= most:
            return taken(self.rows, F.broadcast(words))
        # ranges of files with at most so many words; a range starts at a file
        firsts = [(self.starts[0][0], 0)]
        for h, at in self.starts[1:]:
            if (at - firsts[-1][1]) // 64 >= most // 2:
                firsts.append((h, at))
        done = []
        for (h, lo), (stop, hi) in pairwise([*firsts, (None, self.end)]):
            mine = words.where(F.col("word").between(lo // 64, hi // 64 - 1))
            file = _file(self.scan)
            part = self.scan.where((file >= h) if stop is None else (file >= h) & (file < stop))
            done.append(common.materialise(taken(self._rows(part), F.broadcast(mine) if (hi - lo) // 64 <= most else mine), "part"))
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out


def tie(df: DataFrame) -> Column:
    """A hash of a row's simple columns, by which rows with one id and one text are ordered."""
    return F.xxhash64(*[df[c] for c, t in df.dtypes if "map<" not in t and "variant" not in t], F.lit(1))
