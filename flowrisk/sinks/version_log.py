"""A log of numbered states on shared storage, each put at once or not at all.

A state is one small JSON document in a file of its own. It is written beside the log and
renamed to its number, which fails if the number is there: of two writers that put the same
number one wins, and a reader sees a whole state or none. The newest state says all that a
reader needs, so earlier ones are removed after ``KEPT`` more.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

#: States that stay readable behind the newest.
KEPT = 1000


class VersionTaken(RuntimeError):
    """Another writer has put this number."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    where, fs = _file_system(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


class VersionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:012d}.json"

    def numbers(self) -> list[int]:
        where, fs = _file_system(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def read(self, number: int) -> dict:
        where, fs = _file_system(self.spark, self._file(number))
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """Number and document of the newest state; (-1, None) of an empty log."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def put(self, number: int, state: dict) -> None:
        """Put the state, if the number is free and follows the newest."""
        numbers = self.numbers()
        if numbers and number != numbers[-1] + 1:
            raise VersionTaken(f"{self.path}: state {number} does not follow {numbers[-1]}; another writer is at work")
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        draft, fs = _file_system(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(state, sort_keys=True).encode())
        stream.close()
        names = jvm.org.apache.hadoop.fs
        rename = getattr(names, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        to = names.Path(self._file(number))
        try:
            names.FileContext.getFileContext(to.toUri(), hadoop).rename(draft, to, options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(f"{self.path}: state {number} is there already") from e
            raise
        for old in [n for n in numbers if n <= number - KEPT]:
            self.remove(old)

    def remove(self, number: int) -> None:
        where, fs = _file_system(self.spark, self._file(number))
        fs.delete(where, False)
