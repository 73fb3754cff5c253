"""Rules of a user's own as table functions of SQL: each sees one file's rows, in order, and no others.

    class Repeated:
        def line(self, row): ...   # a row of the relation; yields (line, message)
        def end(self): ...         # after the file's last row

    register_table_rule(spark, "repeated", Repeated)
    SELECT * FROM repeated(TABLE(lines) PARTITION BY path ORDER BY line_number)

Spark brings the rows of a file together and sorts them; a relation with a path is all that is needed, so no join is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from csift.operators.lines import line_rows
from csift.rules.custom import CustomRule

FOUND = "path string, line int, message string"


def table_rule(rule: Callable):
    """The table function of a rule; its input has a column path."""

    class Handler:
        def __init__(self):
            self.rule, self.path = rule(), None

        def eval(self, row):
            self.path = row["path"]
            for line, message in self.rule.line(row) or ():
                yield self.path, int(line), str(message)

        def terminate(self):
            if self.path is not None and hasattr(self.rule, "end"):
                for line, message in self.rule.end() or ():
                    yield self.path, int(line), str(message)

    return udtf(Handler, returnType=FOUND)


def register_table_rule(spark: SparkSession, name: str, rule: Callable) -> None:
    spark.udtf.register(name, table_rule(rule))


def line_rule(rule_id: str, name: str, rule: Callable, **values) -> CustomRule:
    """A rule over files' lines (path, line_number, line; comments are blank) that scans take like others."""
    function = f"csift_rule_{uuid.uuid4().hex}"

    def query(parses: DataFrame) -> DataFrame:
        spark = parses.sparkSession
        register_table_rule(spark, function, rule)
        line_rows(parses, ["path"], "clean").createOrReplaceTempView(f"{function}_lines")
        return spark.sql(f"SELECT path, line, 1 AS column, message FROM {function}(TABLE({function}_lines) PARTITION BY path ORDER BY line_number)")

    return CustomRule(rule_id, name, query=query, **values)
