"""One id counter for several jobs: a ledger that hands out ranges of ids."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from logweave.files import last_number, put_if_absent, read_text
from logweave.functions.cyclic import MIN_SEQID, next_seqid


@dataclass(frozen=True)
class IdLedger:
    """Entries 1, 2, ... below ``root``, which all jobs share; ``start`` is the first id of all.

    An entry is put only where there is none, so of two jobs that claim at once one looks again. It names the next free id
    and every owner's last range: the newest entry says all there is to know. Entries are never removed, or a job that had
    stopped for long could put one again. They hold a row for each owner (a collector and its stream checkpoint), of which there are few.
    """

    root: str
    start: int = MIN_SEQID

    def _path(self, nr: int) -> str:
        return f"{self.root}/ranges/{nr:012d}.json"

    def claim(self, spark: SparkSession, owner: str, batch_id: int, count: int) -> int:
        """The first of ``count`` ids for a batch of ``owner``. A batch that is replayed gets the range it had; no id goes out twice
        and none is left out, as long as batches are replayed until they are through."""
        while True:
            nr = last_number(spark, self._path)
            entry = json.loads(read_text(spark, self._path(nr))) if nr else {"next": self.start, "owners": {}}
            batch, first, had = entry["owners"].get(owner, (-1, 0, 0))
            if batch == batch_id:
                if had != count:
                    raise ValueError(f"batch {batch_id} of {owner} had {had} ids and wants {count}")
                return first
            if batch > batch_id:
                raise ValueError(f"{owner} has ids for batch {batch}, {batch_id} can't come after it; a new checkpoint needs a new owner")
            if count == 0:
                return entry["next"]
            owners = entry["owners"] | {owner: (batch_id, entry["next"], count)}
            if put_if_absent(spark, self._path(nr + 1), json.dumps({"next": next_seqid(entry["next"], count), "owners": owners})):
                return entry["next"]
