"""A keyed store on files, where the last write wins.

Rows lie in generations, one folder each; a manifest names the folders that make up the
store, and the newest manifest counts.  A batch writes its own folder and then publishes a
manifest that has it.  Generations of a level are merged into one of the next level as
soon as there are ``FAN`` of them, so reading touches a number of folders that grows with
the logarithm of the batches, and a row is rewritten that often.  Whatever is cut off before
the manifest appears leaves the store as it was, and a batch that comes again after it was
published changes nothing.  One query writes to a store; any number may read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epiflux.sources import files

#: Generations of a level that are merged into one of the next.
FAN = 4

_BATCH = "_batch"


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Row with the highest ``order`` per key, combined before the shuffle.

    Of rows with the same order the one with the highest digest of all its values is
    taken, so a row read twice or in another order gives the same result.
    """
    rest = [name for name in df.columns if name != key]
    row = F.struct(*[F.col(f"`{name}`") for name in rest])
    rank = F.struct(*order, F.sha2(F.to_json(row), 256))
    return df.groupBy(key).agg(F.max_by(row, rank).alias("last")).select(key, "last.*").select(*df.columns)


class KeyedStore:
    """Rows of ``schema`` by ``key``; the highest ``order`` wins, then the later batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    def _manifests(self) -> list[str]:
        return [name for name in files.list_names(self.spark, f"{self.path}/manifest") if name.endswith(".json")]

    def manifest(self) -> dict:
        """``version``, the last batch, and the folders with their levels."""
        names = self._manifests()
        if not names:
            return {"version": 0, "batch": -1, "folders": []}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{names[-1]}"))

    def _publish(self, manifest: dict) -> None:
        files.publish_text(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json", json.dumps(manifest))

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = f"level-{level}-{uuid.uuid4().hex}"
        last_per_key(rows, self.key, [self.order, _BATCH]).write.parquet(f"{self.path}/data/{name}")
        return {"name": name, "level": level}

    def _read(self, folders: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{folder['name']}" for folder in folders]
        return self.spark.read.schema(f"{self.schema}, {_BATCH} bigint").parquet(*paths)

    def put(self, batch: DataFrame, number: int) -> None:
        """Add a batch; one that was published already is left out."""
        now = self.manifest()
        if number <= now["batch"]:
            return
        rows = batch.withColumn(_BATCH, F.lit(number).cast("long"))
        folders = [*now["folders"], self._write(rows, 0)]
        level = 0
        while sum(folder["level"] == level for folder in folders) >= FAN:
            merged = [folder for folder in folders if folder["level"] == level]
            folders = [folder for folder in folders if folder["level"] != level]
            folders.append(self._write(self._read(merged), level + 1))
            level += 1
        self._publish({"version": now["version"] + 1, "batch": number, "folders": folders})

    def read(self) -> DataFrame:
        """The store as it stands: the last write per key over the folders of the newest manifest."""
        folders = self.manifest()["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return last_per_key(self._read(folders), self.key, [self.order, _BATCH]).drop(_BATCH)

    def vacuum(self, keep: int = 2) -> int:
        """Remove data that none of the last ``keep`` manifests names; returns the number of folders.

        Readers that started from an older manifest must have ended, and no batch may be under way.
        """
        names = self._manifests()[-keep:]
        named = [json.loads(files.read_text(self.spark, f"{self.path}/manifest/{name}"))["folders"] for name in names]
        held = {folder["name"] for folder in reduce(list.__add__, named, [])}
        old = [name for name in files.list_names(self.spark, f"{self.path}/data") if name not in held]
        for name in old:
            files.remove_folder(self.spark, f"{self.path}/data/{name}")
        return len(old)


def put_by_key(stream: DataFrame, store: KeyedStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Put every batch of a stream into the store."""
    return (
        stream.writeStream.foreachBatch(store.put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
