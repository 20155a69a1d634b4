"""Table functions for SQL: rules over ordered boxes that read a table argument one partition at a time.

    SELECT * FROM box_rows(TABLE(boxes) PARTITION BY doc_id ORDER BY (y_center, box_id), 20.0D)
    SELECT * FROM row_cells(TABLE(lines) PARTITION BY doc_id ORDER BY (row_no, x_center, box_id))

A partition is read once, row by row, and what is kept of it is a few numbers or one line of a table, so a document may have any number of boxes.
Other rules plug in the same way: a class with ``analyze``, ``eval`` and ``terminate``, named by :func:`register`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def field_of(table: AnalyzeArgument, name: str) -> T.StructField:
    """A column of a table argument; an error says which one is missing."""
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE argument")
    found = [f for f in table.dataType.fields if f.name == name]
    if not found:
        raise ValueError(f"the table argument needs a column {name}")
    return found[0]


@udtf
class BoxRows:
    """The row of a table that each box belongs to: a box opens a new one unless it is less than the tolerance below the box before it.

    Columns: doc_id, box_id, y_center and any others; all are passed on, with ``row_no``.  Partition by doc_id, order by y_center and box_id.
    """

    def __init__(self) -> None:
        self.last, self.row = None, -1

    @staticmethod
    def analyze(table: AnalyzeArgument, tolerance: AnalyzeArgument) -> AnalyzeResult:
        for name in ("doc_id", "box_id", "y_center"):
            field_of(table, name)
        if tolerance.value is None or float(tolerance.value) < 0:
            raise ValueError("the tolerance must be a constant that is not negative")
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("row_no", T.LongType())]))

    def eval(self, row: Row, tolerance) -> Iterator[tuple]:
        y = row["y_center"]
        if self.last is None or y - self.last >= float(tolerance):
            self.row += 1
        self.last = y
        yield (*row, self.row)


@udtf
class RowCells:
    """Cells of the rows that :class:`BoxRows` has found: the first row names the columns by ordinal, each later one gives as many values.

    Columns: doc_id, row_no, text.  Partition by doc_id, order by row_no and the place in the row.  Values beyond the names are left out, missing ones are empty.
    """

    def __init__(self) -> None:
        self.doc, self.row, self.texts, self.names = None, None, [], None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        doc = field_of(table, "doc_id")
        for name in ("row_no", "text"):
            field_of(table, name)
        cells = [T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()), T.StructField("col_name", T.StringType()), T.StructField("value", T.StringType())]
        return AnalyzeResult(T.StructType([T.StructField("doc_id", doc.dataType), *cells]))

    def line(self) -> Iterator[tuple]:
        """The cells of the row that has just ended; of the first one, its names are kept."""
        if self.row is None:
            return
        if self.names is None:
            self.names = self.texts
            return
        for k, name in enumerate(self.names):
            yield self.doc, self.row - 1, k, name, self.texts[k] if k < len(self.texts) else ""

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["row_no"] != self.row:
            yield from self.line()
            self.doc, self.row, self.texts = row["doc_id"], row["row_no"], []
        self.texts.append(row["text"])

    def terminate(self) -> Iterator[tuple]:
        yield from self.line()


def register(spark: SparkSession) -> None:
    spark.udtf.register("box_rows", BoxRows)
    spark.udtf.register("row_cells", RowCells)
