"""Groups kept up to date: new records meet their own blocks, and a threshold is only a filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import THRESHOLD
from .dedup import LEAST_BY_SEGMENTS, SPLIT_ABOVE, assign_groups, keyed, similar_names
from .lineage import cut


@dataclass(frozen=True)
class Matches:
    """What groups are made of: records by key, and names of a block that are similar at the lowest threshold a reviewer can choose.

    Both are kept, so another threshold filters the names' scores and compares nothing again.
    """

    keys: DataFrame  # id, dom, key, block
    similar: DataFrame  # block, key1, key2, score
    largest: int

    @classmethod
    def of(cls, records: DataFrame) -> Matches:
        keys = cut(keyed(records))
        return cls(keys, cut(similar_names(keys, LEAST_BY_SEGMENTS)), largest_block(keys))

    def groups(self, threshold: float = THRESHOLD) -> DataFrame:
        """The groups of all blocks, as find_duplicates gives them; not for thresholds below LEAST_BY_SEGMENTS."""
        if threshold < LEAST_BY_SEGMENTS:
            raise ValueError(f"similar names are kept from {LEAST_BY_SEGMENTS} on")
        return assign_groups(self.keys, threshold, self.largest > SPLIT_ABOVE, self.similar)

    def add(self, records: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> tuple[Matches, DataFrame]:
        """With more records, and the groups brought up to date from those of the same threshold before.

        Only blocks that get a record are compared and folded again; all other groups stay
        as they are.
        """
        new = cut(keyed(records))
        touched = new.select("block").distinct()
        before = self.keys.join(touched, "block", "left_semi")
        here = cut(before.unionByName(new))
        compared = cut(similar_names(here, LEAST_BY_SEGMENTS))
        firsts = before.groupBy("block").agg(F.min("id").alias("block_first")).select("block_first")
        largest = max(self.largest, largest_block(here))
        again = assign_groups(here, threshold, largest > SPLIT_ABOVE, compared)
        kept = self.similar.join(touched, "block", "left_anti")
        matches = Matches(self.keys.unionByName(new), kept.unionByName(compared), largest)
        return matches, groups.join(firsts, "block_first", "left_anti").unionByName(again)


def largest_block(keys: DataFrame) -> int:
    return keys.groupBy("block").count().agg(F.max("count").alias("n")).first().n or 0
