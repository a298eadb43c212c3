"""A release ledger: noisy tables that are charged to a privacy budget once, kept, and read again ever after.

A budget is a folder of entries, numbered from 1 without a gap. Charging a release is creating the next entry, which a file system lets one writer do:
whoever finds it taken reads the ledger again. The charge comes before the table, so a job that dies may leave a release without its table, never a table
without its charge; asking for it again completes it, with the same noise and no second charge. A release that the budget can't bear is refused, and
one that is stored is returned as it is, since fresh noise on the same counts would tell more than was paid for.

    root/budget/entry=1.json                 {"release": ..., "epsilon": ...}
    root/budget/release=name/part-*.parquet  the table
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .ledger import noisy

ROOM = 1e-12


class BudgetSpent(ValueError):
    """The budget can't bear the release."""


class ReleaseLedger:
    """root: a folder that driver and executors share. total: what all releases of the budget may cost together; the same for every user of it."""

    def __init__(self, spark: SparkSession, root: str, budget: str, total: float) -> None:
        if not re.fullmatch(r"[\w.-]+", budget):
            raise ValueError("a budget's name has letters, digits, dots and dashes")
        self.spark, self.folder, self.total = spark, f"{root.rstrip('/')}/{budget}", total
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.folder}/{name}"))

    def entries(self) -> list[tuple[str, float]]:
        """(release, epsilon) in the order they were charged. A budget has few: each has cost part of it."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(self.folder))]
        numbers = sorted(int(m[1]) for m in (re.fullmatch(r"entry=(\d+)\.json", n) for n in names) if m)
        out = []
        for n in numbers:
            lines = self.spark.read.text(f"{self.folder}/entry={n}.json").collect()
            told = json.loads(lines[0][0]) if lines else None
            if told is None:  # being written, or left by a writer that died: nothing was released on it, and its cost isn't known
                raise BudgetSpent(f"entry {n} of the ledger has no content; remove it if its writer has died")
            out.append((told["release"], float(told["epsilon"])))
        return out

    def spent(self) -> float:
        return sum(e for _, e in self.entries())

    def _charge(self, release: str, epsilon: float) -> None:
        while True:
            entries = self.entries()
            for name, paid in entries:
                if name == release:
                    if paid != epsilon:
                        raise ValueError(f"{release} was charged with {paid}, not {epsilon}")
                    return
            if sum(e for _, e in entries) + epsilon > self.total + ROOM:
                raise BudgetSpent(f"{release} needs {epsilon}; {self.total - sum(e for _, e in entries):.6g} of {self.total} is left")
            text = json.dumps({"release": release, "epsilon": epsilon}) + "\n"
            if self._create(f"{self.folder}/entry={len(entries) + 1}.json", text):
                return

    def _create(self, name: str, text: str) -> bool:
        """Whether this call has made the file; False if it was there."""
        try:
            out = self._files.create(self._path(name), False)
        except Exception as error:  # noqa: BLE001
            if self._files.exists(self._path(name)):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def release(self, table: DataFrame, name: str, keys: list[str], value: str, sensitivity: float, epsilon: float, seed: int) -> DataFrame:
        """table's keys and `noisy`, from the store; the first call under a name charges epsilon and writes it. value itself isn't stored."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError("a release's name has letters, digits, dots and dashes")
        if not (epsilon > 0 and sensitivity > 0):
            raise ValueError("epsilon and sensitivity must be above 0")
        where = f"{self.folder}/release={name}"
        self._charge(name, epsilon)
        made = noisy(table, keys, value, sensitivity, epsilon, seed).select(*keys, "noisy")
        if not self._exists(f"release={name}/_SUCCESS"):
            made.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(made.schema).parquet(where)
