"""A schema registry kept in a JSON file, compatibility rules, and codecs with the registry's wire framing."""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")
# Numeric types and what they may be read as.
WIDENS = {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("int", "float")}


def ddl(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)


def can_read(reader: T.StructType, writer: T.StructType) -> list[str]:
    """What keeps ``reader`` from reading data of ``writer``; nothing if it can."""
    have = {f.name: f for f in writer}
    out = []
    for f in reader:
        w = have.get(f.name)
        if w is None:
            if not f.nullable:
                out.append(f"{f.name}: required, but not written")
        else:
            a, b = w.dataType.simpleString(), f.dataType.simpleString()
            if isinstance(f.dataType, T.StructType) and isinstance(w.dataType, T.StructType):
                out += [f"{f.name}.{x}" for x in can_read(f.dataType, w.dataType)]
            elif a != b and (a, b) not in WIDENS:
                out.append(f"{f.name}: {a} isn't read as {b}")
            if w.nullable and not f.nullable:
                out.append(f"{f.name}: may be missing, but is required")
    return out


def compatible(new: T.StructType, old: list[T.StructType], mode: str) -> list[str]:
    """Against the newest version, or with a transitive mode against all."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "NONE" or not old:
        return []
    out = []
    for o in old if mode.endswith("TRANSITIVE") else old[-1:]:
        if mode.startswith(("BACKWARD", "FULL")):
            out += can_read(new, o)
        if mode.startswith(("FORWARD", "FULL")):
            out += can_read(o, new)
    return out


class SchemaRegistry:
    """Subjects with versions; identifiers are unique over all subjects."""

    def __init__(self, path: str | None = None, mode: str = "BACKWARD"):
        self.path = Path(path) if path else None
        self.data = json.loads(self.path.read_text()) if self.path and self.path.exists() else {"next": 1, "subjects": {}, "modes": {}, "default": mode}
        self.by_id = lru_cache(maxsize=1024)(self._by_id)

    def _save(self) -> None:
        if self.path:
            self.path.write_text(json.dumps(self.data))

    def register(self, subject: str, schema: T.StructType | str, check: bool = True) -> int:
        s = ddl(schema)
        versions = self.data["subjects"].setdefault(subject, [])
        for v in versions:
            if v["schema"] == s.json():
                return v["id"]
        if check and (why := self.test(subject, s)):
            raise ValueError("; ".join(why))
        n = self.data["next"]
        self.data["next"] += 1
        versions.append({"id": n, "version": (versions[-1]["version"] if versions else 0) + 1, "schema": s.json()})
        self._save()
        return n

    def test(self, subject: str, schema: T.StructType | str) -> list[str]:
        old = [T.StructType.fromJson(json.loads(v["schema"])) for v in self.data["subjects"].get(subject, [])]
        return compatible(ddl(schema), old, self.mode(subject))

    def mode(self, subject: str) -> str:
        return self.data["modes"].get(subject, self.data["default"])

    def set_mode(self, subject: str, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        self.data["modes"][subject] = mode
        self._save()

    def _by_id(self, n: int) -> T.StructType:
        for versions in self.data["subjects"].values():
            for v in versions:
                if v["id"] == n:
                    return T.StructType.fromJson(json.loads(v["schema"]))
        raise KeyError(n)

    def latest(self, subject: str) -> tuple[int, T.StructType]:
        v = self.data["subjects"][subject][-1]
        return v["id"], T.StructType.fromJson(json.loads(v["schema"]))

    def version(self, subject: str, version: int) -> T.StructType:
        return next(T.StructType.fromJson(json.loads(v["schema"])) for v in self.data["subjects"][subject] if v["version"] == version)

    def subjects(self) -> list[str]:
        return sorted(self.data["subjects"])

    def versions(self, subject: str) -> list[int]:
        return [v["version"] for v in self.data["subjects"][subject]]

    def delete(self, subject: str) -> None:
        del self.data["subjects"][subject]
        self.by_id.cache_clear()
        self._save()


def frame(payload: Column, schema_id: int) -> Column:
    """A zero byte, the schema's identifier in four bytes, the payload."""
    return F.concat(F.lit(b"\0" + struct.pack(">i", schema_id)), payload.cast("binary"))


def unframe(data: Column) -> tuple[Column, Column]:
    """(schema identifier or null, payload)"""
    ok = (F.octet_length(data) >= 5) & (F.hex(F.substring(data, 1, 1)) == "00")
    return F.when(ok, F.conv(F.hex(F.substring(data, 2, 4)), 16, 10).cast("int")), F.when(ok, F.substring(data, 6, 1 << 30))


class JsonCodec:
    """JSON payloads checked against a registered schema both ways."""

    def __init__(self, registry: SchemaRegistry, subject: str):
        self.registry, self.subject = registry, subject

    def encode(self, df: DataFrame, name: str = "value") -> DataFrame:
        n, schema = self.registry.latest(self.subject)
        missing = [f.name for f in schema if not f.nullable and f.name not in df.columns]
        if missing:
            raise ValueError(f"required columns are missing: {missing}")
        body = F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]))
        return df.withColumn(name, frame(body, n))

    def decode(self, df: DataFrame, column: str = "value", name: str = "decoded") -> tuple[DataFrame, DataFrame]:
        """(good, bad): framed JSON that has the schema's identifier, parses and has what is required."""
        n, schema = self.registry.latest(self.subject)
        sid, payload = unframe(F.col(column))
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        out = df.withColumn("_sid", sid).withColumn(name, F.from_json(F.decode(payload, "UTF-8"), loose))
        ok = (F.col("_sid") == n) & F.col(name).isNotNull()
        for f in schema:
            if not f.nullable:
                ok &= F.col(f"{name}.{f.name}").isNotNull()
        out = out.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        return out.where("_ok").drop("_ok", "_sid"), out.where("NOT _ok").drop("_ok", "_sid", name)


def avro_decode(column: str, schema_json: str) -> Column:
    """Needs Spark's avro module on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(unframe(F.col(column))[1], schema_json)


def avro_encode(value: Column, schema_id: int, schema_json: str) -> Column:
    from pyspark.sql.avro.functions import to_avro

    return frame(to_avro(value, schema_json), schema_id)


def protobuf_decode(column: str, message: str, descriptor: str) -> Column:
    """Needs Spark's protobuf module on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return from_protobuf(unframe(F.col(column))[1], message, descFilePath=descriptor)
