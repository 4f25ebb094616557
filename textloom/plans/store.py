"""Small files of a bank on any store that Spark reaches: markers of versions, a lock, logs and prices."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.settings import SettingError

#: A lock that was not renewed for so long belongs to a run that is gone, in seconds.
LEASE = 6 * 3600
USAGE = "at timestamp, bank string, purpose string, model string, tokens_in long, tokens_out long, requests long"
PURPOSES = ("embed", "embed-query", "semantic", "enrich")
#: Prices per million tokens in and out that hold without an override; a bank's own models are priced by ``set_price``.
DEFAULT_PRICES: dict[str, tuple[float, float]] = {"hash": (0.0, 0.0)}


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """False where the file is there and may not be replaced; otherwise it is written whole."""
        try:
            stream = self._fs().create(self._path(name), replace)
        except Exception as e:
            if not replace and "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    @contextlib.contextmanager
    def locked(self, now: float | None = None) -> Iterator[None]:
        """One writer at a time. The lock of a run that died counts for LEASE seconds."""
        now = time.time() if now is None else now
        mine = json.dumps({"owner": uuid.uuid4().hex, "at": now})
        if not self.write("LOCK", mine, replace=False):
            held = json.loads(self.read("LOCK") or "{}")
            if now - held.get("at", now) < LEASE:
                raise SettingError("another run holds this bank")
            self.remove("LOCK")
            if not self.write("LOCK", mine, replace=False):
                raise SettingError("another run holds this bank")
        try:
            yield
        finally:
            self.remove("LOCK")

    # --- lines, a file for each append, so that two writers never meet in one ---

    def append(self, log: str, rows: list[dict]) -> None:
        if rows:
            self.write(f"{log}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl", "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))

    def lines(self, log: str, schema: str) -> DataFrame:
        """The rows of a log; blank lines are skipped, and a line that is no JSON fails the read."""
        if not self.names(log):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(f"{self.root}/{log}")

    def tail(self, log: str, n: int, rejected: bool = False) -> list[dict]:
        """The last n rows of a journal, oldest first, or the last n rejected ones. Reads files from the newest on until it has them."""
        out: list[dict] = []
        for name in reversed(self.names(log)):
            rows = [json.loads(x) for x in self.read(f"{log}/{name}").split("\n") if x.strip()]
            out = [r for r in rows if not rejected or r.get("decision") == "reject"] + out
            if len(out) >= n:
                break
        return out[-n:]

    # --- usage ---

    def used(self, bank: str, purpose: str, model: str, tokens_in: int, tokens_out: int, requests: int = 1, at: float | None = None) -> None:
        """Log a call; one without tokens is not logged."""
        if purpose not in PURPOSES:
            raise SettingError(f"no purpose {purpose}")
        if tokens_in or tokens_out:
            moment = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() if at is None else at))
            self.append("usage", [{"at": moment, "bank": bank, "purpose": purpose, "model": model, "tokens_in": tokens_in, "tokens_out": tokens_out, "requests": requests}])

    def usage(self) -> DataFrame:
        return self.lines("usage", USAGE)

    def set_price(self, model: str, tokens_in: float, tokens_out: float) -> None:
        if min(tokens_in, tokens_out) < 0:
            raise SettingError("a price is not below 0")
        own = json.loads(self.read("prices.json")) if self.exists("prices.json") else {}
        self.write("prices.json", json.dumps(own | {model: [tokens_in, tokens_out]}, indent=1))

    def prices(self) -> DataFrame:
        """(model, price_in, price_out): the defaults under the bank's own."""
        own = json.loads(self.read("prices.json")) if self.exists("prices.json") else {}
        rows = [(m, float(a), float(b)) for m, (a, b) in (DEFAULT_PRICES | {m: tuple(p) for m, p in own.items()}).items()]
        return self.spark.createDataFrame(rows, "model string, price_in double, price_out double")
