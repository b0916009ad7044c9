"""Tables that are published together: a log of commits, each one file that is created once or not at all.

Writers stage their files where no reader looks, hold them against what is stored, and then try to create the next
file of the log. Whoever creates it has committed all tables of that run in one step. A writer that comes second holds
its files against what the first one added, and tries the file after that. Readers take the folders that the log names,
so half a run is never seen, and a snapshot once taken stays as it is.
"""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators.invariants import InvariantBroken
from lexmill.sources.scratch import remove

#: After so many commits the log is summed up in one file, so that readers open few.
SUMMED = 64


class Contended(RuntimeError):
    """Other writers were faster every time."""


def _plain(value):
    return value.isoformat() if isinstance(value, datetime.date | datetime.datetime) else value if isinstance(value, int | float | str) else None


class Store:
    """The tables below a folder and their log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._entries: list[dict] = []
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Create a file with all its content, or find that it exists. Local files are linked, others renamed without
        leave to overwrite, which file systems do in one step."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        staged, target = self._at(f"_log/.staged-{uuid.uuid4().hex}"), self._at(name)
        self._fs.mkdirs(self._at("_log"))
        stream = self._fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(staged, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:  # the file system's own word for it
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(staged, False)

    def commits(self, since: int = 0, upto: int | None = None) -> list[dict]:
        """Commits after number since, in order; what was read once is not read again, since it cannot change."""
        log = self._at("_log")
        if self._fs.exists(log):
            names = [s.getPath().getName() for s in self._fs.listStatus(log)]
            sums = [int(n.split(".")[0]) for n in names if n.endswith(".sum")]
            if sums and max(sums) > len(self._entries):
                self._entries = json.loads(self._read(f"_log/{max(sums):020d}.sum"))
            last = max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)
            self._entries += [json.loads(self._read(f"_log/{v:020d}.json")) for v in range(len(self._entries) + 1, last + 1)]
        return self._entries[since:upto]

    def last(self) -> int:
        return len(self.commits())

    def version_of(self, run: str) -> int | None:
        """The commit that published a run."""
        return next((i + 1 for i, c in enumerate(self.commits()) if c["run"] == run), None)

    def folders(self, table: str, since: int = 0, upto: int | None = None, key: str | None = None, within: tuple | None = None, run: str | None = None) -> list[str]:
        """The folders of a table that commits after since, up to upto, have added; of those whose range of a key is
        known, only the ones that may hold a value within the given ends."""
        out = []
        for c in self.commits(since, upto):
            added = c["tables"].get(table)
            if not added or (run is not None and c["run"] != run):
                continue
            ends = added["ranges"].get(key) if within else None
            # Nulls lie in no range; a folder of nothing else has null ends.
            apart = ends is not None and not (added["nulls"].get(key) and within[2]) and (ends[0] is None or within[0] is None or ends[1] < within[0] or ends[0] > within[1])
            if not apart:
                out.append(added["folder"])
        return out

    def table(self, name: str, upto: int | None = None, **which) -> DataFrame | None:
        """The rows of a table as of a commit (the last one if none is named); None where nothing was published."""
        schemas = [c["tables"][name]["schema"] for c in self.commits(0, upto) if name in c["tables"]]
        if not schemas:
            return None
        schema, paths = StructType.fromJson(schemas[-1]), self.folders(name, upto=upto, **which)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def publish(self, run: str, tables: dict[str, DataFrame], unique: dict[str, list[str]] | None = None, stored: str = "refuse", check: Callable[[dict[str, DataFrame]], set[str] | None] | None = None, options: dict[str, str] | None = None, tries: int = 100) -> int:
        """Commit all tables of a run, or none; the number of the commit.

        A run that is in the log is not written again. unique names the columns by which a row of a table is stored once:
        rows whose values the store has are refused, or left out where stored is "skip"; nulls are values. They are
        looked for in the folders whose range of the first column meets theirs, so a batch of new values reads none.
        check gets the staged tables before anything can be seen, and refuses by raising; it may return the names of tables whose
        unique columns it found to be so, which are not looked at again. Options go to the writer. What is staged and not
        committed is deleted here, or by sweep() if the writer died.
        """
        if (done := self.version_of(run)) is not None:
            return done
        unique, mark = unique or {}, uuid.uuid4().hex[:16]
        staged, held = {}, 0
        early = stored == "skip" and bool(options) and set(tables) <= set(unique)
        if early:
            held = self.last()
        try:
            for name, rows in tables.items():
                if early:  # what is looked up by its key lies in the order of its key
                    rows = self._lacked(name, rows, unique[name], held)
                elif stored == "skip" and name in unique:
                    rows = rows.dropDuplicates(unique[name])
                staged[name] = {"folder": self._folder(name, mark)}
                staged[name] = self._stage(staged[name]["folder"], rows, unique.get(name, []), options)
            sure = (check({n: self._staged(s) for n, s in staged.items()}) if check else None) or set()
            for name, keys in unique.items():
                if name in staged and name not in sure and stored != "skip" and not self._staged(staged[name]).groupBy(*keys).count().filter("count > 1").isEmpty():
                    raise InvariantBroken(f"{name}: rows of one key")
            for _ in range(tries):
                last = self.last()
                if (done := self.version_of(run)) is not None:
                    break
                for name, keys in unique.items():
                    if name in staged and (clash := self._clash(name, staged[name], keys, held, last)) is not None:
                        if stored != "skip":
                            raise InvariantBroken(f"{name}: stored already")
                        left = self._anti(self._staged(staged[name]), clash, keys)
                        before = staged[name]
                        staged[f"{name} "] = {"folder": self._folder(name, uuid.uuid4().hex[:16])}
                        staged[name] = self._stage(staged[f"{name} "]["folder"], left, keys, options)
                        del staged[f"{name} "]
                        remove(self.spark, f"{self.path}/{before['folder']}")
                held = last
                entry = {"version": last + 1, "run": run, "tables": staged}
                if self._create(f"_log/{last + 1:020d}.json", json.dumps(entry)):
                    staged = {}
                    if (last + 1) % SUMMED == 0:
                        self._create(f"_log/{last + 1:020d}.sum", json.dumps(self.commits(0, last + 1)))
                    return last + 1
            if done is None:
                raise Contended(run)
            return done
        finally:
            for s in staged.values():
                remove(self.spark, f"{self.path}/{s['folder']}")

    @staticmethod
    def _folder(name: str, mark: str) -> str:
        return f"{name}/commit={mark}".lstrip("/")

    def _stage(self, folder: str, rows: DataFrame, keys: list[str], options: dict[str, str] | None = None) -> dict:
        rows.write.mode("overwrite").options(**(options or {})).parquet(f"{self.path}/{folder}")
        first = keys[:1]
        read = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        out = read.agg(F.count("*").alias("n"), *[f(F.col(f"`{k}`")).alias(f"{a}_{k}") for k in first for f, a in ((F.min, "min"), (F.max, "max"))], *[F.count_if(F.col(f"`{k}`").isNull()).alias(f"null_{k}") for k in first]).first()
        ranges = {k: [_plain(out[f"min_{k}"]), _plain(out[f"max_{k}"])] for k in first if out[f"min_{k}"] is None or _plain(out[f"min_{k}"]) is not None}
        return {"folder": folder, "rows": out["n"], "schema": json.loads(rows.schema.json()), "ranges": ranges, "nulls": {k: out[f"null_{k}"] for k in first}}

    def _staged(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    @staticmethod
    def _anti(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
        r, g = rows.alias("r"), gone.alias("g")
        same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return r.join(g, on, "left_anti")

    def _lacked(self, name: str, rows: DataFrame, keys: list[str], upto: int) -> DataFrame:
        """The rows whose keys the commits up to upto lack, each key once, in the order of their keys.

        Keys alone tell first what is stored. Rows then go through one shuffle, by ranges of keys, in which keys that are
        stored meet them; rows of an upload without a new key go through none.
        """
        had = None
        if self.folders(name, 0, upto):
            mine, k = rows.select(*keys).distinct(), F.col(f"`{keys[0]}`")
            own = mine.agg(F.count("*").alias("n"), F.min(k).alias("least"), F.max(k).alias("most"), F.count_if(k.isNull()).alias("nulls")).first()
            ends = [_plain(own["least"]), _plain(own["most"])]
            known = own["least"] is None or ends[0] is not None
            had = self._held({"ranges": {keys[0]: ends} if known else {}, "nulls": {keys[0]: own["nulls"]}}, name, mine, keys, 0, upto) if own["n"] else None
            n = had.count() if had is not None else 0
            if n == own["n"]:
                return rows.limit(0)
            had = had if n else None
        others = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys])
        met = rows.select(*keys, others.alias("__row"), F.lit(False).alias("__old"))
        if had is not None:
            met = met.unionByName(had.select(*keys, F.lit(True).alias("__old")), allowMissingColumns=True)
        per = met.repartitionByRange(*keys).groupBy(*keys).agg(F.bool_or("__old").alias("__old"), F.first("__row", ignorenulls=True).alias("__row"))
        return per.filter(~F.col("__old")).sortWithinPartitions(*keys).select(*keys, "__row.*").select(*rows.columns)

    def _clash(self, name: str, entry: dict, keys: list[str], since: int, upto: int) -> DataFrame | None:
        """The keys of a staged table that commits after since have stored, None if there are none."""
        if upto <= since or not entry["rows"]:
            return None
        both = self._held(entry, name, self._staged(entry).select(*keys), keys, since, upto)
        return None if both is None or both.isEmpty() else both

    def _held(self, entry: dict, name: str, mine: DataFrame, keys: list[str], since: int, upto: int) -> DataFrame | None:
        """Those of some keys that commits after since have stored, looked for where their ranges meet; None where none do."""
        ends = entry["ranges"].get(keys[0])
        within = (*ends, entry["nulls"].get(keys[0], 0) > 0) if ends else None
        if not self.folders(name, since, upto, keys[0], within):
            return None
        had = self.table(name, upto=upto, since=since, key=keys[0], within=within)
        if within and within[0] is not None:
            # Ranges reach the scan, so that row groups apart from them are not read.
            k = F.col(f"`{keys[0]}`")
            had = had.filter(k.between(F.lit(ends[0]), F.lit(ends[1])) | k.isNull())
        had = had.select(*keys)
        m, h = mine.alias("m"), had.alias("h")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"m.`{k}`").eqNullSafe(F.col(f"h.`{k}`"))
        return h.join(m, on, "left_semi")

    def sweep(self, tables: list[str], older: float = 86_400) -> list[str]:
        """Delete folders that no commit names and that are older than so many seconds; their names."""
        named = {t["folder"] for c in self.commits() for t in c["tables"].values()}
        out = []
        for table in tables:
            if not self._fs.exists(self._at(table)):
                continue
            for s in self._fs.listStatus(self._at(table)):
                folder = f"{table}/{s.getPath().getName()}".lstrip("/")
                if s.getPath().getName().startswith("commit=") and folder not in named and s.getModificationTime() / 1000 <= time.time() - older:
                    remove(self.spark, f"{self.path}/{folder}")
                    out.append(folder)
        return out
