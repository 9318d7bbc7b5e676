"""Projects, analyses and settings on disk: small metadata beside parquet tables."""

from __future__ import annotations

import contextlib
import fcntl
import json
import logging
import re
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shoalwatch.session import remove
from shoalwatch.sources.sinks import ExportPolicy

#: Rows above which a table is exported in chunks, and the chunk if none is remembered.
LARGE, CHUNK = 50_000, 50_000


class JsonFormatter(logging.Formatter):
    """One JSON object per log record."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out)


def slug(name: str) -> str:
    return re.sub(r"\W+", "_", name.lower()).strip("_") or "project"


#: What ids of analyses in the first layout begin with.
_V1 = "__v1__"


class Workspace:
    """A folder of projects; every change holds a lock across processes.

    Names, parameters and settings lie in ``root`` on the driver. Tables lie
    in ``tables``, a folder or address that driver and executors share; on
    one machine that can be ``root`` itself.
    """

    def __init__(self, root: str | Path, tables: str | None = None):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        self.tables = (tables or str(self.root)).rstrip("/")

    @contextlib.contextmanager
    def _state(self):
        with (self.root / ".lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            file = self.root / "workspace.json"
            state = json.loads(file.read_text()) if file.exists() else {"projects": {}, "analyses": {}, "settings": {}}
            yield state
            new = file.with_suffix(".new")
            new.write_text(json.dumps(state))
            new.replace(file)

    def _unique(self, taken, name: str) -> str:
        base = out = slug(name)
        k = 1
        while out in taken:
            out, k = f"{base}_{k}", k + 1
        return out

    def create_project(self, name: str, df: DataFrame) -> str:
        with self._state() as state:
            id = self._unique(state["projects"], name)
            state["projects"][id] = {"name": name, "created": time.time()}
        df.write.parquet(f"{self.tables}/{id}/input.parquet")
        return id

    def projects(self) -> list[dict[str, Any]]:
        with self._state() as state:
            return sorted(({"id": k, **v} for k, v in state["projects"].items()), key=lambda p: p["name"].lower())

    def rename_project(self, id: str, name: str) -> None:
        with self._state() as state:
            state["projects"][id]["name"] = name

    def delete_project(self, id: str) -> None:
        with self._state() as state:
            del state["projects"][id]
            state["analyses"] = {k: v for k, v in state["analyses"].items() if v["project"] != id}
        remove(SparkSession.active(), f"{self.tables}/{id}")

    def project_table(self, spark: SparkSession, id: str, n_rows: int | None = None) -> DataFrame:
        df = spark.read.parquet(f"{self.tables}/{id}/input.parquet")
        return df.limit(n_rows) if n_rows else df

    def create_analysis(self, project: str, analysis: str, params: dict[str, Any], name: str | None = None) -> str:
        """Saved as a draft until ``finish_analysis``."""
        with self._state() as state:
            id = self._unique(state["analyses"], f"{project}_{analysis}")
            state["analyses"][id] = {"project": project, "analysis": analysis, "params": params, "name": name or analysis, "draft": True, "created": time.time()}
            return id

    def save_tables(self, id: str, tables: dict[str, dict[str, DataFrame]]) -> None:
        for analysis, outputs in tables.items():
            for output, df in outputs.items():
                df.write.mode("overwrite").parquet(f"{self._folder(id)}/{analysis}/{output}.parquet")

    def load_table(self, spark: SparkSession, id: str, analysis: str, output: str) -> DataFrame:
        folder = self._folder(id) if id.startswith(_V1) else f"{self._folder(id)}/{analysis}"
        return spark.read.parquet(f"{folder}/{output}.parquet")

    def _folder(self, id: str) -> str:
        with self._state() as state:
            return f"{self.tables}/{state['analyses'].get(id, {}).get('folder', f'analyses/{id}')}"

    def discover_v1(self, spark: SparkSession) -> list[str]:
        """Analyses of the first layout, ``<project>/analyzers/<analysis>/<output>.parquet``; returns the new ones' ids.

        They are listed with the time of their folder and stay where they are.
        """
        new = []
        make = spark._jvm.org.apache.hadoop.fs.Path
        for project in self.projects():
            folder = make(f"{self.tables}/{project['id']}/analyzers")
            fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            found = [f for f in fs.listStatus(folder) if f.isDirectory()] if fs.exists(folder) else []
            with self._state() as state:
                for f in found:
                    name = f.getPath().getName()
                    id = f"{_V1}{project['id']}_{name}"
                    if id not in state["analyses"]:
                        state["analyses"][id] = {"project": project["id"], "analysis": name, "params": {}, "name": name, "draft": False, "created": f.getModificationTime() / 1000, "folder": f"{project['id']}/analyzers/{name}"}
                        new.append(id)
        return new

    def finish_analysis(self, id: str) -> None:
        with self._state() as state:
            state["analyses"][id]["draft"] = False

    def analyses(self, project: str, *, drafts: bool = False) -> list[dict[str, Any]]:
        with self._state() as state:
            return [{"id": k, **v} for k, v in state["analyses"].items() if v["project"] == project and (drafts or not v["draft"])]

    def delete_analysis(self, id: str) -> None:
        folder = self._folder(id)
        with self._state() as state:
            del state["analyses"][id]
        remove(SparkSession.active(), folder)

    def settings(self) -> dict[str, Any]:
        with self._state() as state:
            return dict(state["settings"])

    def update_settings(self, **values: Any) -> None:
        with self._state() as state:
            state["settings"] |= values

    def export_policy(self, rows: int, chunk_rows: int | None = None) -> ExportPolicy:
        """How to export a table: in chunks if it is large, of the size chosen last.

        ``chunk_rows`` is chosen now and remembered.
        """
        if chunk_rows is not None:
            policy = ExportPolicy(chunk_rows)
            self.update_settings(export_chunk=chunk_rows)
            return policy
        return ExportPolicy(self.settings().get("export_chunk", CHUNK) if rows > LARGE else None)

    def run(self, suite, project: str, analysis: str, df: DataFrame, params: dict[str, Any] | None = None) -> str:
        """Run and save an analysis; a draft that fails is deleted."""
        id = self.create_analysis(project, analysis, {k: str(v) for k, v in (params or {}).items()})
        try:
            self.save_tables(id, suite.run(analysis, df, params))
        except BaseException:
            self.delete_analysis(id)
            raise
        self.finish_analysis(id)
        return id
