"""A table of immutable versions: data files, deletion vectors and one manifest for each commit.

A manifest names what its version adds and removes and which deletion vectors it lays over files,
so the record changes between two versions follow from the manifests between them alone; no data
of the versions before is read. A commit is the creation of the next manifest by a rename that
fails if the name is taken: a writer that dies leaves files nobody names, a second writer of the
same version fails. ``properties`` of a commit carry what must be saved with it, such as the source
version an output was made from.

Every ``EVERY`` versions a checkpoint lists the files and vectors that are live, so no reader goes
back further than that. ``compact`` rewrites what is live without changing it, and ``collect_garbage``
removes the files that no version since a given one names.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.session import read_bytes, write_bytes


#: Versions between two checkpoints of the live files.
EVERY = 10


class CommitConflict(RuntimeError):
    """Another writer took the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        if schema is not None and not self._exists(f"{self.path}/schema.json"):
            self._put(f"{self.path}/schema.json", schema.json().encode())

    # files

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        p = self._p(path)
        return p.getFileSystem(self._conf).exists(p)

    def _put(self, path: str, data: bytes) -> None:
        """Write beside and rename; an existing target fails."""
        at = f"{self.path}/.{uuid.uuid4().hex}"
        write_bytes(self.spark, at, data)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._p(path)
        fs = target.getFileSystem(self._conf)
        fs.mkdirs(target.getParent())
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(self._p(at), target, none)
        except Exception as e:
            fs.delete(self._p(at), False)
            raise CommitConflict(path) from e

    def _files(self, path: str) -> list[str]:
        p = self._p(path)
        fs, out = p.getFileSystem(self._conf), []
        if not fs.exists(p):
            return out
        it = fs.listFiles(p, True)
        while it.hasNext():
            f = it.next().getPath().toString()
            if f.endswith(".parquet"):
                out.append(f)
        return sorted(out)

    @cached_property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(read_bytes(self.spark, f"{self.path}/schema.json")))

    # manifests

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        p = self._p(f"{self.path}/manifests")
        fs = p.getFileSystem(self._conf)
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()[:-5]) for s in fs.listStatus(p)), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(read_bytes(self.spark, f"{self.path}/manifests/{version:012d}.json"))

    def properties(self) -> dict:
        v = self.version()
        return self.manifest(v)["properties"] if v else {}

    def commit(self, after: int, added: list[str] = (), removed: list[str] = (), vectors: list[str] = (), properties: dict | None = None, base: int | None = None) -> int:
        """Make version after + 1; CommitConflict if it exists. It builds on version after, or on an earlier
        base: what versions between the two did is then no part of it."""
        body = {"version": after + 1, "added": list(added), "removed": list(removed), "vectors": list(vectors), "properties": properties or {}}
        if base is not None and base != after:
            body["base"] = base
        return self._commit(after, body)

    def _commit(self, after: int, body: dict) -> int:
        version = after + 1
        self._put(f"{self.path}/manifests/{version:012d}.json", json.dumps(body, ensure_ascii=False).encode())
        if version % EVERY == 0 or body.get("rewrite"):
            live, vectors = self._state(version)
            try:
                self._put(f"{self.path}/checkpoints/{version:012d}.json", json.dumps({"live": live, "vectors": vectors}).encode())
            except CommitConflict:
                pass
        return version

    def _state(self, version: int) -> tuple[list[str], list[str]]:
        """The live files and the vectors over them, from the last checkpoint and the manifests since."""
        live: dict[str, None] = {}
        vectors: list[str] = []
        p = self._p(f"{self.path}/checkpoints")
        fs = p.getFileSystem(self._conf)
        saved = {int(x.getPath().getName()[:-5]) for x in fs.listStatus(p)} if fs.exists(p) else set()
        chain = []
        while version and version not in saved:
            m = self.manifest(version)
            chain.append(m)
            version = m.get("base", version - 1)
        if version:
            have = json.loads(read_bytes(self.spark, f"{self.path}/checkpoints/{version:012d}.json"))
            live, vectors = dict.fromkeys(have["live"]), have["vectors"]
        for m in reversed(chain):
            if m.get("rewrite"):
                live, vectors = {}, []
            for f in m["removed"]:
                live.pop(f, None)
            live.update(dict.fromkeys(m["added"]))
            vectors = vectors + m["vectors"]
        return list(live), vectors

    # writes

    def append(self, rows: DataFrame, properties: dict | None = None, delete: Column | None = None) -> int:
        """One commit that adds rows and, with delete, lays a deletion vector over the matching present rows."""
        after = self.version()
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(at)
        vector = []
        if delete is not None and after:
            to = f"{self.path}/vectors/{uuid.uuid4().hex}"
            self._present(after).filter(delete).select("_file", "_row").write.parquet(to)
            vector = [to]
        return self.commit(after, self._files(at), vectors=vector, properties=properties)

    def append_each(self, rows: DataFrame, by: str, known: list) -> dict:
        """One commit for each value of by, in order, from a single write; the version of each value.

        known lists the values, so that a value without rows still is a (then empty) version. A
        value that holds much of the table is spread over several files.
        """
        if not known:
            return {}
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, F.col(by).alias("_by")).hint("rebalance", "_by").write.partitionBy("_by").parquet(at)
        files: dict[str, list[str]] = {}
        for f in self._files(at):
            files.setdefault(f.split("/_by=")[1].split("/")[0], []).append(f)
        after, out = self.version(), {}
        for value in sorted(known):
            after = out[value] = self.commit(after, files.get(str(value), []), properties={by: value})
        return out

    # reads

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("bigint")})
        src = self.spark.read.schema(self.schema).parquet(*files)
        return src.select("*", F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+/[^/]+$", 0).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.schema("_file string, _row bigint").option("recursiveFileLookup", "true").parquet(*paths).filter("_file is not null") if paths else None

    def _present(self, version: int, only: list[str] | None = None) -> DataFrame:
        """The live rows with their place, of all partitions (as ``append_parts`` names them) or only some."""
        live, vectors = self._state(version)
        if only is not None:
            names = {f"/_by={x}/" for x in only}
            live = [f for f in live if any(n in f for n in names)]
        rows, gone = self._rows(live), self._vectors(vectors)
        return rows if gone is None else rows.join(gone, ["_file", "_row"], "left_anti")

    def replace(self, base: int, keys: DataFrame, by: str, rows: DataFrame, properties: dict | None = None, named: bool = True) -> int:
        """One commit on top of base: rows are added, those present with one of the keys are gone.

        named: base must be the newest version (CommitConflict if another writer was faster); else
        newer versions are left aside.
        """
        data, vector = f"{self.path}/data/{uuid.uuid4().hex}", f"{self.path}/vectors/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(data)
        vectors = []
        if base:
            self._present(base).join(keys.select(by).distinct(), by, "left_semi").select("_file", "_row").write.parquet(vector)
            vectors = [vector]
        after = base if named else self.version()
        return self.commit(after, self._files(data), vectors=vectors, properties=properties, base=base)

    def append_parts(self, rows: DataFrame, part: Column, after: int, properties: dict | None = None) -> int:
        """One commit of rows written in partitions; where a row brings _file and _row, it supersedes that
        row: the data files are the deletion vector too."""
        data = self.write_parts(rows, part)
        return self.commit(after, self._files(data), vectors=[data], properties=properties)

    def write_parts(self, rows: DataFrame, part: Column) -> str:
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, "_file", "_row", part.alias("_by")).hint("rebalance", "_by").write.partitionBy("_by").parquet(data)
        return data

    def compact(self) -> int:
        """A version of the same rows in new files, without deletion vectors; properties stay."""
        after = self.version()
        if not after:
            return 0
        live, _ = self._state(after)
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        part = F.regexp_extract("_file", "_by=([^/]*)", 1)
        self._present(after).withColumn("_by", part).hint("rebalance", "_by").select(*self.schema.names, "_by").write.partitionBy("_by").parquet(data)
        return self._commit(after, {"version": after + 1, "added": self._files(data), "removed": live, "vectors": [], "properties": self.properties(), "rewrite": True})

    def collect_garbage(self, since: int) -> list[str]:
        """Delete the data and vector folders that no version from since on needs; older versions can't be read any more."""
        need: set[str] = set()
        folder = lambda f: f.split(f"{self.path.rsplit('/', 1)[-1]}/", 1)[1].split("/")[1]
        for v in range(since, self.version() + 1):
            live, vectors = self._state(v)
            need.update(map(folder, (*live, *vectors)))
        gone = []
        for kind in ("data", "vectors"):
            p = self._p(f"{self.path}/{kind}")
            fs = p.getFileSystem(self._conf)
            for x in fs.listStatus(p) if fs.exists(p) else ():
                name = x.getPath().getName()
                if name not in need:
                    fs.delete(x.getPath(), True)
                    gone.append(f"{kind}/{name}")
        return sorted(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._present(self.version() if version is None else version).select(*self.schema.names)

    def added(self, after: int, upto: int) -> list[str]:
        """The files that a reader of the changes in between has to read."""
        return [f for v in range(after + 1, upto + 1) for f in self.manifest(v)["added"]]

    def changes(self, after: int, upto: int) -> DataFrame:
        """The record changes from one version to a later one: the rows with _change (insert, delete).

        Rows that were both added and deleted in between are no change. A compaction in between hides
        where rows came from and is an error.
        """
        new: dict[str, None] = {}
        dropped: list[str] = []
        laid: list[str] = []
        for v in range(after + 1, upto + 1):
            m = self.manifest(v)
            if m.get("rewrite"):
                raise ValueError(f"version {v} is a compaction: read the changes up to it first")
            for f in m["removed"]:
                if f in new:
                    del new[f]
                else:
                    dropped.append(f)
            new.update(dict.fromkeys(m["added"]))
            laid += m["vectors"]
        gone = self._vectors(laid)
        ins = self._rows(list(new))
        if gone is not None:
            ins = ins.join(gone, ["_file", "_row"], "left_anti")
        out = ins.select(*self.schema.names, F.lit("insert").alias("_change"))
        if not after or not (dropped or laid):
            return out
        old = self._present(after)
        if dropped:
            lost = self.spark.createDataFrame([("/".join(f.split("/")[-3:]),) for f in dropped], "_file string")
            out = out.unionByName(old.join(lost, "_file", "left_semi").select(*self.schema.names, F.lit("delete").alias("_change")))
            old = old.join(lost, "_file", "left_anti")
        if gone is not None:
            out = out.unionByName(old.join(gone, ["_file", "_row"], "left_semi").select(*self.schema.names, F.lit("delete").alias("_change")))
        return out
