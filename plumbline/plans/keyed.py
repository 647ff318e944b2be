"""A keyed table in a folder: rows are merged in, the latest of a key wins, and a new state is there at once or not at all.

The state is a list of segments, each with a row for each of its keys, the newer ones first in turn. What is put becomes a
segment of its own, so that costs follow what changes; two segments become one as soon as the newer has half the rows of the
older, which leaves a logarithm of them, and no history. A state is a small file of the next number, which is put in place by
one rename: readers go by the highest number, a run that fails before leaves the old state, and of two writers the later
one takes up the earlier one's state and tries again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError


class KeyedStore:
    """Rows by key, in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    def _numbers(self) -> list[int]:
        place = self._at("states")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _state(self) -> tuple[int, dict]:
        """The number and content of the current state; 0 and no segments at first."""
        numbers = self._numbers()
        if not numbers:
            return 0, {"segments": [], "left": []}
        stream = self._fs.open(self._at(f"states/{numbers[-1]:020d}.json"))
        try:
            return numbers[-1], json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, state: dict) -> bool:
        """Whether the state could be put in place under its number: not if another writer came first."""
        part, to = self._at(f"states/.{uuid.uuid4().hex}"), self._at(f"states/{number:020d}.json")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        done = not self._fs.exists(to) and self._fs.rename(part, to)
        if not done:
            self._fs.delete(part, False)
        return done

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{name}")

    def _latest(self, names: list[str]) -> DataFrame:
        """The rows of segments, the older ones first; a later row of a key replaces those before."""
        if len(names) == 1:
            return self._segment(names[0])
        parts = [self._segment(n).withColumn("__age", F.lit(k)) for k, n in enumerate(names)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rest = [c for c in every.columns if c not in (*self.key, "__age")]
        won = every.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "__age").alias("__row"))
        return won.select(*self.key, "__row.*").select(*[c for c in every.columns if c != "__age"])

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{name}")
        return name, self._segment(name).count()

    def read(self) -> DataFrame | None:
        """The rows of the current state, one for each key; None before the first are put."""
        names = [n for n, _ in self._state()[1]["segments"]]
        return self._latest(names) if names else None

    def put(self, rows: DataFrame, tries: int = 10) -> None:
        """Merges rows in; they must have one row for each key, whose columns may not be null. No rows change nothing."""
        fresh = self._write(rows)
        if not fresh[1]:
            self._fs.delete(self._at(f"segments/{fresh[0]}"), True)
            return
        for _ in range(tries):
            number, state = self._state()
            segments, gone = [*map(tuple, state["segments"]), fresh], []
            while len(segments) > 1 and segments[-2][1] <= 2 * segments[-1][1]:
                two = segments[-2:]
                segments[-2:] = [self._write(self._latest([n for n, _ in two]))]
                gone += [n for n, _ in two]
            # What the state before this one no longer had can go: whoever reads that has had a whole state's time.
            if self._publish(number + 1, {"segments": segments, "left": gone}):
                for name in state["left"]:
                    self._fs.delete(self._at(f"segments/{name}"), True)
                for old in self._numbers()[:-3]:
                    self._fs.delete(self._at(f"states/{old:020d}.json"), False)
                return
            for name in {n for n, _ in segments} - {n for n, _ in state["segments"]} - {fresh[0]}:
                self._fs.delete(self._at(f"segments/{name}"), True)
        raise PlumblineError(f"{self.path} is written by too many at once")
