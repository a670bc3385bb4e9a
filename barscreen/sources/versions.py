"""Tables kept by key in buckets, in versions: what a symbol's data is made of is said by a manifest.

``<path>/data/folder=<name>/bucket=<n>`` holds rows, never changed once written; ``<path>/versions/<n>`` lists the folders
of each bucket that make up version n. A change writes new folders first, then one manifest, by a rename that refuses to
replace: a reader sees the table before or after, a job that dies in between changes nothing, and of two writers
of one version the second starts again from the first's. Old versions stay readable until ``forget``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

Entries = dict[int, list[str]]  # the folders of each bucket, oldest first
#: Tries to change a version while others do.
TRIES = 20
#: Files of a bucket, on average, from which they are written as fewer when they are rewritten, if they are smaller than this.
MOST_FILES, SMALL_FILE = 8, 16 << 20


class KeyedTable:
    """A table at ``path`` of rows with a ``key`` column, dealt to ``buckets`` by its hash."""

    def __init__(self, spark: SparkSession, path: str, key: str = "symbol", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(self.path).getFileSystem(self._conf)

    @classmethod
    def at(cls, spark: SparkSession, path: str, key: str = "symbol") -> KeyedTable:
        """The table that is at ``path``, with as many buckets as it was made with."""
        table = cls(spark, path, key)
        found = table.versions()
        if found:
            table.buckets = json.loads(table._text(f"{table.path}/versions/{found[-1]}"))["buckets"]
        return table

    # versions

    def versions(self) -> list[int]:
        folder = self._file(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """The number of a version (the newest) and what it says: schema, buckets, notes and entries. Version 0 is empty."""
        found = self.versions()
        number = (found[-1] if found else 0) if version is None else version
        if number == 0:
            return 0, {"schema": None, "buckets": self.buckets, "notes": {}, "entries": {}}
        said = json.loads(self._text(f"{self.path}/versions/{number}"))
        if said["buckets"] != self.buckets:
            raise ValueError(f"the table has {said['buckets']} buckets")
        said["entries"] = {int(b): folders for b, folders in said["entries"].items()}
        return number, said

    def change(self, make: Callable[[dict], dict | None]) -> int:
        """Make a version of the newest one: ``make`` takes what it says and returns what the next says, or None to leave it."""
        for _ in range(TRIES):
            number, said = self.manifest()
            after = make(said)
            if after is None:
                return number
            if self._publish(number + 1, after):
                return number + 1
        raise RuntimeError(f"{self.path} changes faster than this writer")

    def _publish(self, number: int, said: dict) -> bool:
        draft = f"{self.path}/versions/_draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._file(draft))
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        refuse = self.spark.sparkContext._gateway.new_array(rename, 1)
        refuse[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._file(self.path).toUri(), self._conf)
        try:
            context.rename(self._file(draft), self._file(f"{self.path}/versions/{number}"), refuse)
        except Exception as error:
            self._fs.delete(self._file(draft), False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        return True

    def forget(self, before: int) -> None:
        """Drop the versions before ``before``, and the data that only they list."""
        kept = [v for v in self.versions() if v >= before]
        if not kept:
            raise ValueError("the newest version stays")
        listed = lambda v: {(b, f) for b, folders in self.manifest(v)[1]["entries"].items() for f in folders}
        needed = set().union(*map(listed, kept))
        for version in [v for v in self.versions() if v < before]:
            for bucket, folder in listed(version) - needed:
                self._fs.delete(self._file(self._place(bucket, folder)), True)
            self._fs.delete(self._file(f"{self.path}/versions/{version}"), False)

    # rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, folder: str | None = None, dealt: bool = False) -> tuple[str, list[int]]:
        """Write rows to a folder of their own, not yet part of any version; its name and the buckets that got any.

        Rows that are ``dealt`` come from files of buckets: they aren't shuffled again.
        """
        folder = folder or uuid.uuid4().hex
        out = f"{self.path}/data/folder={folder}"
        rows = rows.withColumn("bucket", self.bucket())
        if dealt:
            pass
        elif rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            rows = rows.hint("rebalance", "bucket")  # a large bucket may be several files
        else:  # so in the session of a stream with state, where the hint is passed over and each task would write to each bucket
            rows = rows.repartitionById(self.buckets, "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(out)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._file(out))]
        return folder, sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def read(self, buckets: list[int] | None = None, said: dict | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of some buckets only if they are named, with the columns folder and bucket; None if there are none."""
        said = said or self.manifest(version)[1]
        places = [self._place(b, f) for b, folders in said["entries"].items() if buckets is None or b in buckets for f in folders]
        if not places:
            return None
        schema = StructType.fromJson(json.loads(said["schema"])).add("folder", StringType()).add("bucket", IntegerType())
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*places)

    def append(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Add rows; the buckets that got any. A ``batch`` that is run again, as its number tells, is not added twice."""
        folder, touched = self.write(rows, None if batch is None else f"batch-{batch}")
        schema = rows.schema.json()

        def make(said: dict) -> dict | None:
            if batch is not None and batch <= said["notes"].get("batch", -1):
                return None
            entries = {**said["entries"], **{b: [*said["entries"].get(b, []), folder] for b in touched}}
            notes = said["notes"] if batch is None else {**said["notes"], "batch": batch}
            return {**said, "schema": said["schema"] or schema, "entries": entries, "notes": notes}

        self.change(make)
        return touched

    def replace(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], notes: dict | None = None) -> int:
        """Rewrite the buckets that ``rows`` has keys of, as ``merge`` (old rows, new rows) says; other buckets aren't read or written.

        The rows are written first, and read from there: what was computed once is computed once. A bucket that another
        writer changes meanwhile is merged anew.
        """

        def merged(stale: list[int], said: dict, new: DataFrame) -> Entries:
            folder, filled = self.write(merge(self._held(stale, said, new), new))
            return {b: [folder] if b in filled else [] for b in stale}

        return self._rewrite(rows, merged, notes)

    def renew(self, rows: DataFrame, wins: Callable[[DataFrame, DataFrame], DataFrame], notes: dict | None = None) -> int:
        """Put ``rows`` in the place of what their keys had, for the keys that ``wins`` (old rows, new rows) gives; for others nothing changes.

        As ``replace``, but only new rows are shuffled, those that count: old ones that stay are copied from their
        bucket's files, and buckets without a winner are left as they are.
        """

        def renewed(stale: list[int], said: dict, new: DataFrame) -> Entries:
            after = {b: said["entries"].get(b, []) for b in stale}
            # a row a key, stored: by its size Spark chooses how to join
            place = f"{self.path}/data/folder={uuid.uuid4().hex}"
            found = wins(self._held(stale, said, new), new).select(self.key).distinct()
            found.write.parquet(place)
            winners = self.spark.read.schema(found.schema).parquet(place)
            won = [r[0] for r in winners.select(self.bucket()).distinct().collect()]
            if won:
                stay = self._held(won, said, new).join(winners, self.key, "left_anti")
                parts = [self.write(stay, dealt=not self._scattered(won, said))] if any(after[b] for b in won) else []
                parts.append(self.write(new.join(winners, self.key, "left_semi")))
                after.update({b: [folder for folder, filled in parts if b in filled] for b in won})
            self._fs.delete(self._file(place), True)
            return after

        return self._rewrite(rows, renewed, notes)

    def _rewrite(self, rows: DataFrame, work: Callable[[list[int], dict, DataFrame], Entries], notes: dict | None) -> int:
        """A version in which ``work`` (buckets, what the newest version says, the new rows of these) says the folders of the buckets of ``rows``."""
        place = f"{self.path}/data/folder={uuid.uuid4().hex}"
        rows.write.parquet(place)
        schema = rows.schema.json()
        new = self.spark.read.schema(rows.schema).parquet(place)
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        made: dict[int, tuple[list[str], list[str]]] = {}  # bucket: the folders it was made from, and into

        def make(said: dict) -> dict:
            stale = [b for b in touched if b not in made or made[b][0] != said["entries"].get(b, [])]
            if stale:
                after = work(stale, said, new.where(self.bucket().isin(stale)))
                made.update({b: (said["entries"].get(b, []), after[b]) for b in stale})
            entries = {**said["entries"], **{b: made[b][1] for b in touched}}
            return {**said, "schema": said["schema"] or schema, "entries": entries, "notes": {**said["notes"], **(notes or {})}}

        number = self.change(make)
        self._fs.delete(self._file(place), True)
        return number

    def _held(self, buckets: list[int], said: dict, new: DataFrame) -> DataFrame:
        """The rows of some buckets, or none with the columns of ``new``."""
        old = self.read(buckets, said)
        if old is not None:
            return old.drop("folder", "bucket")
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(said["schema"])) if said["schema"] else new.schema)

    def _scattered(self, buckets: list[int], said: dict) -> bool:
        """Whether buckets are in many small files, so that their rows are better dealt anew."""
        sizes = [self._fs.getContentSummary(self._file(self._place(b, f))) for b in buckets for f in said["entries"].get(b, [])]
        files, size = sum(s.getFileCount() for s in sizes), sum(s.getLength() for s in sizes)
        return files > MOST_FILES * len(buckets) and size < files * SMALL_FILE

    def compact(self, most: int = 8) -> int:
        """Write each bucket of more than ``most`` folders into one. Writers go on meanwhile: what they add stays beside it."""
        number, said = self.manifest()
        long = {b: folders for b, folders in said["entries"].items() if len(folders) > most}
        if not long:
            return number
        rows = self.read(list(long), said).drop("folder", "bucket")
        folder, _ = self.write(rows)

        def make(now: dict) -> dict | None:
            entries = dict(now["entries"])
            for b, folders in long.items():
                if entries.get(b, [])[: len(folders)] != folders:
                    continue  # another writer has rewritten this bucket
                entries[b] = [folder, *entries[b][len(folders) :]]
            return {**now, "entries": entries}

        return self.change(make)

    def folders_per_bucket(self) -> int:
        return max((len(f) for f in self.manifest()[1]["entries"].values()), default=0)

    def _place(self, bucket: int, folder: str) -> str:
        return f"{self.path}/data/folder={folder}/bucket={bucket}"

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._file(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
