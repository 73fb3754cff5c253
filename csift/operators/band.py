"""Band join: pairs of events of one key whose places are near each other.

Places are binned by the width of the band. An event on the left is in its own bin and the next, one on the right in its own,
so each pair within the band meets in exactly one bin, by an equi-join on (key, bin). A key of any share of the rows is many
bins, and only events of neighbouring bins are ever compared. Null keys and null places have no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """All columns of pairs with 0 <= right_at - left_at <= width, keys once. Other columns differ in name."""
    own = lambda c: F.floor(F.col(f"`{c}`") / (width + 1))
    a = left.withColumn("_csift_bin", F.explode(F.array(own(left_at), own(left_at) + 1)))
    b = right.withColumn("_csift_bin", own(right_at))
    apart = F.col(f"`{right_at}`") - F.col(f"`{left_at}`")
    return a.join(b, [*keys, "_csift_bin"]).filter((apart >= 0) & (apart <= width)).drop("_csift_bin")
