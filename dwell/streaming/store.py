"""The label store as committed, append-only tables.

Every write goes to a fresh folder first; a small commit file that names the
folders, keyed by (stream, run, batch), makes it part of the store. A retried batch
finds its commit and does nothing, a failed one leaves folders that no commit
names, and a stream that starts over with a new checkpoint is a new run: its
batches never meet those of the old one, and the events it sends again are
recognised by their content id.

Reading merges: the current version names the compacted runs of each table and
the commits they cover; the reader unions these runs with the later commits and
takes the latest row per key. ``compact`` reads the later commits only, writes them as one
more run, merges runs when there are too many, and publishes the next version
file; readers see the old version or the new one, whole. Deleting an event is a
tombstone: its event, labels and overrides vanish from every view at once and from
the files when runs are merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dwell.operators import labels as L
from dwell.session import path_exists

SCHEMAS = {
    "events": "id long, device_id string, start_ts double, end_ts double, app string, title string, url string, content_hash string, created_at timestamp, stream_id string",
    "engine_classifications": "event_id long, engine_version string, category_id string, confidence double, rule_id string, meta_json string, created_at timestamp, seq long",
    "user_overrides": "event_id long, op string, category_id string, note string, created_at timestamp, seq long",
    "tombstones": "event_id long, created_at timestamp",
    "notices": "kind string, kind_ord int, event_id long, seq long",
    "suggestions": "keyword string, category string, productive boolean, confidence double, rationale string, ok boolean, attempt int, asked_at timestamp",
    "late": "device_id string, ts timestamp_ntz, seq long, app string, title string, url string, is_idle boolean",
}
KEYS = {"events": ["id"], "engine_classifications": ["event_id", "engine_version"], "user_overrides": ["event_id"], "tombstones": ["event_id"], "suggestions": ["keyword"]}
ORDER = {"engine_classifications": ["created_at", "seq"], "user_overrides": ["seq", "created_at"], "events": ["created_at"], "tombstones": ["created_at"], "suggestions": ["attempt", "asked_at"]}
MAX_RUNS = 4


class Classifier(Protocol):
    """An engine. ``classify`` takes events (id, app, title, url, ...) and returns
    (event_id, category_id, confidence, rule_id, meta_json), a row for each it can label."""

    version: str

    def classify(self, events: DataFrame) -> DataFrame: ...


@dataclass
class RulesEngine:
    """F7 ``rules-v1`` as an engine of the store."""

    ruleset: object
    version: str = "rules-v1"

    def classify(self, events: DataFrame) -> DataFrame:
        from dwell.functions.text import canonical_json
        from dwell.operators.classify import classify_v1

        out = classify_v1(events, self.ruleset)
        return out.select(F.col("id").alias("event_id"), "category_id", "confidence", "rule_id", canonical_json("meta").alias("meta_json"))


@dataclass
class Version:
    """What a version file holds: runs per table, the commits they cover, and the runs of streams seen."""

    number: int = 0
    runs: dict[str, list[str]] = field(default_factory=dict)
    covered: list[str] = field(default_factory=list)
    streams: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """A label store under ``root``, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ small files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, value: dict) -> None:
        """Create ``path`` with its whole content; fails if it is there already."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, path: str) -> dict:
        fs, p = self._fs(path)
        f = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _list(self, folder: str) -> list[str]:
        if not path_exists(self.spark, folder):
            return []
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    # ---------------------------------------------------------------- commits

    @staticmethod
    def _name(stream: str, run: str, batch: int) -> str:
        return f"{quote(stream, safe='')}~{quote(run, safe='')}~{batch:012d}.json"

    def commits(self) -> list[str]:
        return self._list(f"{self.root}/_commits")

    def is_committed(self, stream: str, run: str, batch: int) -> bool:
        return path_exists(self.spark, f"{self.root}/_commits/{self._name(stream, run, batch)}")

    def commit(self, stream: str, run: str, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write ``tables`` and commit them as (stream, run, batch); False if that is done already."""
        if self.is_committed(stream, run, batch):
            return False
        folders = {}
        for name, df in tables.items():
            folders[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folders[name])
        self._put(f"{self.root}/_commits/{self._name(stream, run, batch)}", {"stream": stream, "run": run, "batch": batch, "tables": folders})
        return True

    def last(self, stream: str, run: str, table: str, schema: str) -> DataFrame:
        """``table`` of the newest commit of a stream's run (its carry); empty before the first."""
        mine = [c for c in self.commits() if c.startswith(self._name(stream, run, 0).rsplit("~", 1)[0] + "~")]
        if not mine:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._get(f"{self.root}/_commits/{mine[-1]}")["tables"][table])

    def other_runs(self, stream: str, run: str) -> bool:
        """Whether the stream has ever committed under another checkpoint."""
        own = f"{quote(stream, safe='')}~"
        seen = {c.split("~")[1] for c in self.commits() if c.startswith(own)} | {quote(r, safe="") for r in self.version().streams.get(stream, [])}
        return bool(seen - {quote(run, safe="")})

    # ----------------------------------------------------------------- reading

    def version(self) -> Version:
        names = self._list(f"{self.root}/_versions")
        return Version(**self._get(f"{self.root}/_versions/{names[-1]}")) if names else Version()

    def _schema(self, table: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[table])

    def _of(self, folders: Iterable[str], table: str) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(*folders)

    def log(self, table: str) -> DataFrame:
        """All rows of a table: the version's runs and the commits after them."""
        v = self.version()
        later = [self._get(f"{self.root}/_commits/{c}") for c in self.commits() if c not in set(v.covered)]
        return self._of([*v.runs.get(table, []), *(c["tables"][table] for c in later if table in c["tables"])], table)

    def deleted(self) -> DataFrame:
        return self.log("tombstones").select("event_id").distinct()

    def events(self) -> DataFrame:
        return L.without_deleted(self.log("events"), self.deleted(), "id")

    def labels(self, engine_version: str | None = None) -> DataFrame:
        return L.without_deleted(L.latest_classification(self.log("engine_classifications"), engine_version), self.deleted())

    def overrides(self) -> DataFrame:
        return L.without_deleted(L.current_overrides(self.log("user_overrides")), self.deleted())

    def effective(self, engine_version: str) -> DataFrame:
        return L.effective_labels(self.log("events"), self.log("engine_classifications"), self.log("user_overrides"), engine_version, self.deleted())

    def suggestions(self) -> DataFrame:
        """The last answer for each keyword that was ever asked for; ``ok`` is false where asking failed."""
        return self._merged(self.log("suggestions"), "suggestions")

    def unlabelled(self, engine_version: str) -> DataFrame:
        """Events without a label of that engine: what a failed classification left to do."""
        return self.events().join(self.labels(engine_version).select(F.col("event_id").alias("id")), "id", "left_anti")

    # --------------------------------------------------------------- writing

    def _ops(self, rows: list[tuple], table: str, notices: bool) -> None:
        now = F.current_timestamp()
        df = self.spark.createDataFrame([(*r,) for r in rows], "event_id long, op string, category_id string, note string")
        run = uuid.uuid4().hex
        # later operations have greater numbers, also across writers: the store's clock, then the place in the call
        seq = F.unix_micros(now) * 1000 + F.monotonically_increasing_id() % 1000
        if table == "tombstones":
            self.commit("user", run, 0, {table: df.select("event_id", now.alias("created_at"))})
            return
        ops = self.spark.createDataFrame(df.withColumn("created_at", now).withColumn("seq", seq).collect(), self._schema(table))
        out = {table: ops}
        if notices:
            out["notices"] = ops.select(F.lit("override_updated").alias("kind"), F.lit(2).alias("kind_ord"), "event_id", "seq")
        self.commit("user", run, 0, out)

    def set_override(self, event_id: int, category_id: str, note: str | None = None) -> None:
        """W7 set, with its notice. Only for events that exist."""
        self._known(event_id)
        self._ops([(event_id, "set", category_id, note)], "user_overrides", True)

    def clear_override(self, event_id: int) -> None:
        """W7 clear, with its notice."""
        self._known(event_id)
        self._ops([(event_id, "clear", None, None)], "user_overrides", True)

    def _known(self, event_id: int) -> None:
        if not self.events().where(F.col("id") == event_id).limit(1).count():
            raise ValueError(f"no event {event_id}")

    def delete_events(self, ids: list[int]) -> None:
        """Delete events; their labels and overrides go with them, in every view."""
        self._ops([(i, "delete", None, None) for i in ids], "tombstones", False)

    def relabel(self, engine: Classifier, stream: str = "relabel") -> None:
        """Label what the engine has not labelled yet."""
        todo = self.unlabelled(engine.version)
        self.commit(stream, uuid.uuid4().hex, 0, {"engine_classifications": label_rows(engine, todo)})

    # -------------------------------------------------------------- compaction

    def _merged(self, df: DataFrame, table: str) -> DataFrame:
        """The latest row per key, with the columns that later merges order by."""
        if table not in KEYS:
            return df
        keys = KEYS[table]
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ORDER[table])).alias("l"))
        return g.select(*[c if c in keys else F.col(f"l.{c}").alias(c) for c in df.columns])

    def compact(self) -> int:
        """Cover the commits since the last version; returns the version's number.
        Reads those commits only, unless a table has more than MAX_RUNS runs."""
        v = self.version()
        new = [c for c in self.commits() if c not in set(v.covered)]
        if not new:
            return v.number
        read = [self._get(f"{self.root}/_commits/{c}") for c in new]
        runs = {t: list(r) for t, r in v.runs.items()}
        for table in SCHEMAS:
            folders = [c["tables"][table] for c in read if table in c["tables"]]
            if folders:
                path = f"{self.root}/{table}/{uuid.uuid4().hex}"
                self._merged(self._of(folders, table), table).write.parquet(path)
                runs.setdefault(table, []).append(path)
        gone = self._of(runs.get("tombstones", []), "tombstones").select("event_id").distinct()
        for table, parts in runs.items():
            if len(parts) > MAX_RUNS:
                path = f"{self.root}/{table}/{uuid.uuid4().hex}"
                whole = self._merged(self._of(parts, table), table)
                if table in ("events", "engine_classifications", "user_overrides"):
                    whole = L.without_deleted(whole, gone, "id" if table == "events" else "event_id")
                if table == "user_overrides":
                    whole = whole.where("op = 'set'")  # nothing older is left to be cleared
                whole.write.parquet(path)
                runs[table] = [path]
        streams = {s: set(r) for s, r in v.streams.items()}
        for c in read:
            streams.setdefault(c["stream"], set()).add(c["run"])
        nxt = Version(v.number + 1, runs, sorted({*v.covered, *new}), {s: sorted(r) for s, r in streams.items() if s != "user"})
        # created in one write and never overwritten: of two compactions at a time one fails here
        self._put(f"{self.root}/_versions/{nxt.number:012d}.json", nxt.__dict__)
        return nxt.number


def label_rows(engine: Classifier, events: DataFrame) -> DataFrame:
    """An engine's labels as rows of ``engine_classifications``."""
    return engine.classify(events).select(
        "event_id", F.lit(engine.version).alias("engine_version"), "category_id", "confidence", "rule_id", "meta_json",
        F.current_timestamp().alias("created_at"), F.col("event_id").alias("seq"),
    )
