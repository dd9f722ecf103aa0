"""Application settings: YAML or JSON, environment overrides, checks, versions."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from millrace.operators.windows import micros


class ConfigError(ValueError):
    pass


@dataclass
class EngineConfig:
    parallelism: int = 8
    watermark_delay: str = "5 seconds"
    checkpoint_interval: str = "30 seconds"
    max_files_per_trigger: int = 1000


@dataclass
class KafkaConfig:
    brokers: list[str] = field(default_factory=lambda: ["localhost:9092"])
    topics: list[str] = field(default_factory=list)
    group: str = "millrace"
    offset_reset: str = "earliest"


@dataclass
class StateConfig:
    backend: str = "rocksdb"
    ttl: str | None = None
    checkpoint_dir: str = "/tmp/millrace/checkpoints"


@dataclass
class ErrorConfig:
    strategy: str = "retry_then_dead_letter"
    retries: int = 3
    dead_letter_path: str | None = None


@dataclass
class AppConfig:
    name: str = "millrace"
    engine: EngineConfig = field(default_factory=EngineConfig)
    kafka: KafkaConfig = field(default_factory=KafkaConfig)
    state: StateConfig = field(default_factory=StateConfig)
    errors: ErrorConfig = field(default_factory=ErrorConfig)

    def check(self) -> None:
        bad = []
        if self.engine.parallelism < 1:
            bad.append("engine.parallelism must be positive")
        if not self.name:
            bad.append("name is empty")
        for k in ("watermark_delay", "checkpoint_interval"):
            try:
                micros(getattr(self.engine, k))
            except ValueError as e:
                bad.append(f"engine.{k}: {e}")
        if self.state.backend not in ("memory", "rocksdb"):
            bad.append(f"state.backend: {self.state.backend!r} is unknown")
        if self.kafka.offset_reset not in ("earliest", "latest"):
            bad.append(f"kafka.offset_reset: {self.kafka.offset_reset!r} is unknown")
        if self.errors.strategy not in ("fail_fast", "retry", "dead_letter", "retry_then_dead_letter"):
            bad.append(f"errors.strategy: {self.errors.strategy!r} is unknown")
        if self.errors.retries < 0:
            bad.append("errors.retries is negative")
        if bad:
            raise ConfigError("; ".join(bad))

    def spark_conf(self) -> dict[str, str]:
        rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        memory = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
        return {
            "spark.sql.shuffle.partitions": str(self.engine.parallelism), "spark.checkpoint.dir": self.state.checkpoint_dir,
            "spark.sql.streaming.stateStore.providerClass": rocks if self.state.backend == "rocksdb" else memory,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        }


def _fill(obj, data: dict, at: str = "") -> None:
    known = {f.name for f in fields(obj)}
    for k, v in (data or {}).items():
        if k not in known:
            raise ConfigError(f"{at}{k} isn't a setting")
        cur = getattr(obj, k)
        _fill(cur, v, f"{at}{k}.") if is_dataclass(cur) else setattr(obj, k, v)


def _from_env(obj, env, prefix: str) -> None:
    for f in fields(obj):
        cur, key = getattr(obj, f.name), f"{prefix}_{f.name}".upper()
        if is_dataclass(cur):
            _from_env(cur, env, key)
        elif key in env:
            raw = env[key]
            value = raw.split(",") if isinstance(cur, list) else int(raw) if isinstance(cur, int) and not isinstance(cur, bool) else raw
            setattr(obj, f.name, value)


def load(path: str | None = None, env: dict | None = None) -> AppConfig:
    """The file's settings over the defaults, MILLRACE_* of the environment over both; checked."""
    cfg = AppConfig()
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
        _fill(cfg, data)
    _from_env(cfg, os.environ if env is None else env, "MILLRACE")
    cfg.check()
    return cfg


class ConfigHistory:
    """Versions of the settings, newest last."""

    def __init__(self, keep: int = 10):
        self.keep, self.versions = keep, []

    def add(self, cfg: AppConfig) -> int:
        self.versions.append(json.dumps(asdict(cfg)))
        self.versions = self.versions[-self.keep :]
        return len(self.versions)

    def rollback(self, steps: int = 1) -> AppConfig:
        cfg = AppConfig()
        _fill(cfg, json.loads(self.versions[-1 - steps]))
        return cfg
