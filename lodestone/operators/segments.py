"""Tables of a knowledge base in segments under one manifest: a build's tables change together, or not at all.

A commit adds a segment to each table that it touches and names the keys whose older rows are gone; nothing that is
there is written again, so taking in a document writes bytes in proportion to it. A commit is one small file that names all
segments of all tables, put in place by a rename; until then readers see the version before, whole. Older versions stay
readable until :meth:`Segments.vacuum`, and :meth:`Segments.restore` makes one of them the last again.

A rename has to refuse a name that is taken, as HDFS does; a local disk and object stores need one writer at a time. A table
may gain columns: they are null in rows of older segments, which stay as they are.

Keys that are gone are left out when rows are read, by a join of the segments older than they are; newer ones are read as they
are. Segments of like size are merged when there are ``FAN`` of them, so their number grows with the logarithm of the table and
a row is written again as often.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many segments of like size become one.
FAN = 8
#: The column that says in which commit a row was written.
SEQ = "_seq"


class Conflict(RuntimeError):
    """Another build has committed since this one began."""


class Segments:
    """``tables`` names each table's schema, its key column and the group of tables whose rows of a key go together."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, tuple[T.StructType, str, str]], layout: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, options: Mapping[str, Mapping[str, str]] | None = None, thin: bool = False):
        """``layout`` deals out and sorts a table's rows before they are written, with its ``options``. With ``thin`` a commit lets
        go of segments that are gone by half: for tables that are read often, each time by a join with the keys that are gone.
        """
        self.thin = thin
        self.spark, self.path, self.tables, self.layout, self.options = spark, path.rstrip("/"), dict(tables), dict(layout or {}), dict(options or {})

    # files -------------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(f"{self.path}/commits") if n.startswith("v") and n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """What a version is made of: of the last one, or one that is named. Nothing committed: an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": -1, "segments": {}, "gone": {}}
        if version is not None and version not in known:
            raise FileNotFoundError(f"no version {version} under {self.path}")
        v = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/commits/v{v}.json", wholetext=True).first()[0]) | {"version": v}

    def _commit(self, state: dict, version: int) -> None:
        """The file is complete before it has its name, and a name is given once."""
        fs, folder = self._fs(f"{self.path}/commits")
        fs.mkdirs(folder)
        _, draft = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/commits/v{version}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} was committed by another build")

    # reading -----------------------------------------------------------------------------------------------------------

    def _rows(self, table: str, segments: list[dict], gone: list[dict]) -> DataFrame:
        """Living rows of some segments, with SEQ: those that no later commit says are gone."""
        schema, key, _ = self.tables[table]
        full = T.StructType([*schema, T.StructField(SEQ, T.LongType())])
        if not segments:
            return self.spark.createDataFrame([], full)
        files = lambda some: self.spark.read.schema(full).parquet(*[s["path"] for s in some])
        older = [s for s in segments if any(g["seq"] > s["low"] for g in gone)]
        whole = [s for s in segments if s not in older]
        if not older:
            return files(whole)
        rows = files(older).withColumn("_key", F.col(key).cast("string"))
        living = rows.join(self._gone(gone, older), self._later(), "left_anti").select(*full.fieldNames())
        return living.unionByName(files(whole)) if whole else living

    def _gone(self, gone: list[dict], segments: list[dict]) -> DataFrame:
        """gone_key, gone_hash, gone_seq of the keys that went after some of the segments were written."""
        low = min(s["low"] for s in segments)
        keys = self.spark.read.schema(f"_key string, {SEQ} bigint").parquet(*[g["path"] for g in gone if g["seq"] > low])
        return keys.select(F.col("_key").alias("gone_key"), F.xxhash64("_key").alias("gone_hash"), F.col(SEQ).alias("gone_seq")).where(F.col("gone_seq") > low)

    @staticmethod
    def _later() -> Column:
        # the hash comes first, as sorting keys that begin alike takes long
        return (F.xxhash64("_key") == F.col("gone_hash")) & (F.col("_key") == F.col("gone_key")) & (F.col(SEQ) < F.col("gone_seq"))

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """The rows of a table as a version has them."""
        state = self.state() if state is None else state
        group = self.tables[table][2]
        return self._rows(table, state["segments"].get(table, []), state["gone"].get(group, [])).drop(SEQ)

    # writing -----------------------------------------------------------------------------------------------------------

    def _write(self, table: str, df: DataFrame, seq: int, low: int | None = None, beside: T.StructType | None = None) -> list[dict]:
        """A new segment, or none where there are no rows; the files themselves tell how many there are."""
        schema, path = self.tables[table][0], f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in [*schema, *(beside or [])]], *([SEQ] if SEQ in df.columns else [F.lit(seq).cast("bigint").alias(SEQ)]))
        self.layout.get(table, lambda d: d)(rows).write.options(**self.options.get(table, {})).parquet(path)
        n = self._count(path)
        return [{"path": path, "rows": n, "seq": seq, "low": seq if low is None else low}] if n else []

    def _count(self, path: str) -> int:
        return self.spark.read.schema(f"{SEQ} bigint").parquet(path).count()

    def written(self, table: str, df: DataFrame, state: dict, beside: T.StructType | None = None) -> list[dict]:
        """Rows of the commit that follows ``state``, written but part of no version yet.

        Columns ``beside`` the table's own are written with them, for the build that goes on from there; versions don't have them.
        """
        return self._write(table, df, state["version"] + 1, None, beside)

    def fresh(self, table: str, segments: list[dict], beside: T.StructType | None = None) -> DataFrame:
        """Rows as they were just written, so that what is made of them needs no table of its own."""
        schema = T.StructType([*self.tables[table][0], *(beside or [])])
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in segments]) if segments else self.spark.createDataFrame([], schema)

    def commit(self, state: dict, added: Mapping[str, list[dict]], gone: Mapping[str, DataFrame]) -> int:
        """The version after ``state``: with segments ``added``, and without older rows of the keys ``gone`` (by group).

        Raises :class:`Conflict` if ``state`` isn't the last version any more.
        """
        version = state["version"] + 1
        new = {"segments": {t: state["segments"].get(t, []) + list(added.get(t, [])) for t in self.tables}, "gone": {g: list(x) for g, x in state["gone"].items()}}
        for group, keys in gone.items():
            path = f"{self.path}/data/gone/{uuid.uuid4().hex}"
            keys.select(F.col(keys.columns[0]).cast("string").alias("_key"), F.lit(version).cast("bigint").alias(SEQ)).where("_key is not null").write.parquet(path)
            if n := self._count(path):
                new["gone"].setdefault(group, []).append({"path": path, "seq": version, "rows": n})
                if self.thin:
                    new["segments"] |= self._thinned(group, new, version)
        for table in self.tables:
            new["segments"][table] = self._merged(table, new["segments"][table], new["gone"].get(self.tables[table][2], []), version)
        for group in new["gone"]:
            new["gone"][group] = self._needed(group, new)
        self._commit(new, version)
        return version

    def _thinned(self, group: str, state: dict, version: int) -> dict[str, list[dict]]:
        """The segments of a group's tables, those that are gone by half written again without what is gone.

        Only segments at most twice as large as the keys that went since are looked at, all in one join, so the work is in
        proportion to those keys.
        """
        gone, tables = state["gone"][group], {t: key for t, (_, key, g) in self.tables.items() if g == group}
        went = lambda s: sum(g.get("rows", 0) for g in gone if g["seq"] > s["low"])
        some = [(t, s) for t in tables for s in state["segments"][t] if 2 * went(s) >= s["rows"]]
        if not some:
            return {}
        keys = [self.spark.read.schema(T.StructType([*self.tables[t][0], T.StructField(SEQ, T.LongType())])).parquet(s["path"]).select(F.lit(s["path"]).alias("path"), F.col(tables[t]).cast("string").alias("_key"), SEQ) for t, s in some]
        held = reduce(DataFrame.unionByName, keys).join(self._gone(gone, [s for _, s in some]), self._later(), "left_semi")
        dead = {r["path"]: r["count"] for r in held.groupBy("path").count().collect()}
        out = {}
        for t in tables:
            most = [s for s in state["segments"][t] if 2 * dead.get(s["path"], 0) >= s["rows"]]
            left = [s for s in most if dead[s["path"]] < s["rows"]]
            again = self._write(t, self._rows(t, left, gone), version, version) if left else []
            out[t] = [s for s in state["segments"][t] if s not in most] + again
        return out

    def _merged(self, table: str, segments: list[dict], gone: list[dict], version: int) -> list[dict]:
        """Segments after merging: the last ones, where FAN of them are of one size (within a factor of eight)."""
        size = lambda s: len(f"{s['rows']:o}")  # noqa: E731  octal digits
        while len(segments) >= FAN:
            most, run = 0, 0
            for s in reversed(segments):
                if run >= FAN and size(s) > most:
                    break
                most, run = max(most, size(s)) if run < FAN else most, run + 1
            if any(size(s) > size(segments[-1]) for s in segments[-FAN:]):
                return segments
            # rows keep the commit that they came with; all that is gone by now is left out, so no older list of it is needed
            segments = segments[:-run] + self._write(table, self._rows(table, segments[-run:], gone), version, version)
        return segments

    def _needed(self, group: str, state: dict) -> list[dict]:
        """Files of gone keys that some segment still needs; FAN of them become one."""
        segments = [s for t, (_, _, g) in self.tables.items() if g == group for s in state["segments"][t]]
        gone = [g for g in state["gone"][group] if any(s["low"] < g["seq"] for s in segments)]
        if len(gone) < FAN:
            return gone
        path = f"{self.path}/data/gone/{uuid.uuid4().hex}"
        self.spark.read.schema(f"_key string, {SEQ} bigint").parquet(*[g["path"] for g in gone]).groupBy("_key").agg(F.max(SEQ).alias(SEQ)).write.parquet(path)
        return [{"path": path, "seq": max(g["seq"] for g in gone), "rows": self._count(path)}]

    def restore(self, version: int) -> int:
        """Makes an older version the last one again, as a new commit."""
        last = self.state()
        self._commit(self.state(version), last["version"] + 1)
        return last["version"] + 1

    def vacuum(self) -> None:
        """Deletes older versions, and all files that the last one doesn't name."""
        last = self.state()
        used = {s["path"] for part in ("segments", "gone") for x in last[part].values() for s in x}
        fs, _ = self._fs(self.path)
        for v in self.versions()[:-1]:
            fs.delete(self._fs(f"{self.path}/commits/v{v}.json")[1], False)
        for folder in self._names(f"{self.path}/data"):
            for name in self._names(f"{self.path}/data/{folder}"):
                if f"{self.path}/data/{folder}/{name}" not in used:
                    fs.delete(self._fs(f"{self.path}/data/{folder}/{name}")[1], True)


class Cache:
    """Vectors of texts by content: a provider is asked once for a text, whatever build, document or chunk it comes in.

    Rows are the hash of a text and its vector, in a folder for each provider; they are added as soon as they are made, whether
    or not a build then ends well.
    """

    def __init__(self, spark: SparkSession, path: str, provider: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{provider}"

    def _folders(self) -> list[str]:
        """Folders that were written to their end."""
        files = Segments(self.spark, self.path, {})
        return [f"{self.path}/{n}" for n in files._names(self.path) if "_SUCCESS" in files._names(f"{self.path}/{n}")]

    def read(self) -> DataFrame:
        folders = self._folders()
        schema = "hash binary, embedding array<float>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def hash(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))

    def filled(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """hash, embedding of ``texts`` (text): ``embed`` (of hash and text, giving hash and embedding) sees only new ones, once each."""
        wanted = texts.select(self.hash(F.col("text")).alias("hash"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["hash"])
        new = wanted.join(self.read().select("hash"), "hash", "left_anti")
        path = f"{self.path}/{uuid.uuid4().hex}"
        embed(new).select("hash", "embedding").sortWithinPartitions("hash").write.parquet(path)
        if self.spark.read.schema("hash binary").parquet(path).isEmpty():
            fs, p = Segments(self.spark, self.path, {})._fs(path)
            fs.delete(p, True)
        return self.read().join(wanted.select("hash"), "hash", "left_semi")
