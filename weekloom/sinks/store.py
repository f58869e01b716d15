"""A store of products in versions: only partitions whose content changed are written, and readers see one version.

Tables are kept by partition; a manifest names, for each table and partition, the folder with its rows, their number and
a digest. A new version's folders are written first, its manifest last and in one move, so that a write that fails leaves the
version before as it was. Old folders stay for readers that began before, until vacuum() drops them. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ProductStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a version, the newest by default: {name: {"by": column, "schema": ..., "parts": {value: {path, rows, digest, version}}}}."""
        every = self.versions()
        if not every:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version or every[-1]:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, tables: dict, version: int) -> None:
        final, fs = self._fs(f"{self.path}/manifests/{version:09d}.json")
        if fs.exists(final):
            raise FileExistsError(f"version {version} was published meanwhile")
        draft, _ = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise OSError(f"version {version} could not be published")

    def publish(self, tables: dict[str, DataFrame], by: dict[str, str]) -> int | None:
        """Publishes the tables as a new version, all at once; by names the column by whose values each is kept. None, and no file, if nothing changed.

        Rows count as a multiset: their order makes no difference. Values of by are few (seasons, years); a null is one of them. Tables
        that aren't given stay as they are. A table without rows has no partitions. Give tables that are cheap to read twice.
        """
        old, number = self.manifest(), (self.versions() or [0])[-1] + 1
        new, changed = dict(old), False
        for name, df in tables.items():
            part, before = by[name], old.get(name, {"parts": {}})
            cells = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v"))) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes], *[F.col(c).isNull() for c in df.columns])
            total = F.sum(cells.cast("decimal(38,0)")).cast("string")
            said = df.groupBy(F.col(part).cast("string").alias("part")).agg(F.count("*").alias("rows"), F.concat_ws("|", F.count("*"), total, F.bit_xor(cells)).alias("digest")).collect()
            same_schema = before.get("schema") == df.schema.json() and before.get("by") == part
            fresh = [r for r in said if not same_schema or before["parts"].get(_key(r["part"]), {}).get("digest") != r["digest"]]
            parts = {_key(r["part"]): before["parts"].get(_key(r["part"])) for r in said}
            if fresh:
                path = f"{self.path}/tables/{name}/{uuid.uuid4().hex}"
                wanted = [r["part"] for r in fresh if r["part"] is not None]
                mine = F.col(part).cast("string").isin(wanted)
                mine = mine | F.col(part).isNull() if any(r["part"] is None for r in fresh) else mine
                folder = F.when(F.col(part).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(part).cast("string")))
                df.where(mine).withColumn("__part", F.hex(folder)).write.partitionBy("__part").parquet(path)
                for r in fresh:
                    key = _key(r["part"])
                    parts[key] = {"path": f"{path}/__part={key.encode().hex().upper()}", "rows": r["rows"], "digest": r["digest"], "version": number}
            if fresh or parts.keys() != before["parts"].keys() or not same_schema:
                new[name], changed = {"by": part, "schema": df.schema.json(), "parts": parts}, True
        if not changed:
            return None
        self._publish(new, number)
        return number

    def read(self, name: str, version: int | None = None, parts: list | None = None) -> DataFrame:
        """A table of a version; of some partitions alone, if these are given."""
        from pyspark.sql.types import StructType

        table = self.manifest(version)[name]
        schema = StructType.fromJson(json.loads(table["schema"]))
        wanted = None if parts is None else {_key(None if x is None else str(x)) for x in parts}
        paths = [v["path"] for k, v in table["parts"].items() if wanted is None or k in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def written(self) -> DataFrame:
        """(table, part, rows, version) of the newest version: since which one each partition is as it is."""
        rows = [(n, None if k == "~" else k[1:], v["rows"], v["version"]) for n, t in self.manifest().items() for k, v in t["parts"].items()]
        return self.spark.createDataFrame(rows, "table string, part string, rows long, version long")

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the newest keep versions, and the partitions that only these had; returns the number of dropped folders."""
        every = self.versions()
        held = [self.manifest(v) for v in every[-keep:]]
        used = {p["path"] for m in held for t in m.values() for p in t["parts"].values()}
        gone = {p["path"] for v in every[:-keep] for t in self.manifest(v).values() for p in t["parts"].values()} - used
        for path in [*gone, *[f"{self.path}/manifests/{v:09d}.json" for v in every[:-keep]]]:
            at, fs = self._fs(path)
            fs.delete(at, True)
        return len(gone)


def _key(part: str | None) -> str:
    return "~" if part is None else f"={part}"
