"""A change feed: statements inserted and deleted in a stream, with the points-to result maintained batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental
from ..plans.fixpoint import Relations
from ..plans.scratch import table


class Maintained:
    """Statements and their solution; `take` applies a batch of changes (op '+' or '-', kind, src, dst)."""

    def __init__(self, stmt: DataFrame, solution: Relations, seen: Callable[[int, DataFrame], None] | None = None):
        self.stmt, self.pts, self.copy, self.seen = table(stmt), table(solution["pts"]), table(solution["copy"]), seen

    def take(self, batch: DataFrame, number: int) -> None:
        """In one batch a deletion of a statement wins over its insertion."""
        batch = table(batch.select("op", "kind", "src", "dst"))
        gone = batch.where("op = '-'").select("kind", "src", "dst")
        new = batch.where("op = '+'").select("kind", "src", "dst").join(gone, ["kind", "src", "dst"], "left_anti")
        before = self.pts
        now, solved = incremental.apply(self.stmt, self.pts, self.copy, gone, new)
        self.stmt, self.pts, self.copy = now, table(solved["pts"]), table(solved["copy"])
        if self.seen:
            self.seen(number, incremental.changes(before, self.pts))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).start()
