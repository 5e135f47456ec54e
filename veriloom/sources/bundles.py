"""Folders of evaluation runs as Python data sources.

The driver only lists the bundles (one partition each); a bundle's directories are
walked, classified and read by the task that gets it.  What can't be read is a row with
a ``warning``, and the rest of its bundle is read all the same.  Folders may be of any
file system that pyarrow reaches by its URI.
"""

from __future__ import annotations

import json
import mimetypes
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veriloom.operators.integrity import positions

GRADED = (
    "place int, eval_id string, configuration string, run_number int, pass_rate double, passed bigint, failed bigint, total bigint, time_seconds double, tokens bigint, tool_calls bigint, errors bigint, "
    "expectations array<struct<text:string,passed:boolean,evidence:string>>, notes array<string>, file string, warning string"
)
REVIEWED = "id string, eval_id bigint, prompt string, outputs array<struct<name:string,kind:string,mime:string,text:string,data:binary>>, grading string, warning string"
#: How outputs are shown, and which names are none.
TEXT = (".txt", ".md", ".json", ".csv", ".py", ".js", ".ts", ".tsx", ".jsx", ".yaml", ".yml", ".xml", ".html", ".css", ".sh", ".rb", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".sql", ".r", ".toml")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")
NOT_OUTPUTS = ("transcript.md", "user_notes.md", "metrics.json")
NOT_WALKED = ("node_modules", ".git", "__pycache__", "skill", "inputs")
NO_PROMPT = "(No prompt found)"
MIMES = {
    ".svg": "image/svg+xml",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


class Folder(NamedTuple):
    """A directory of some file system."""

    files: object
    path: str

    @classmethod
    def at(cls, uri: str) -> "Folder":
        from pyarrow import fs

        return cls(*(fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)))

    def inside(self, name: str) -> "Folder":
        return Folder(self.files, f"{self.path}/{name}")

    def names(self, *, folders: bool) -> list[str]:
        """Names of what lies directly in it, sorted; of a missing one none."""
        from pyarrow import fs

        want = fs.FileType.Directory if folders else fs.FileType.File
        found = self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == want)

    def read(self, name: str) -> bytes | None:
        """A file's bytes; null if there is none."""
        from pyarrow import fs

        path = f"{self.path}/{name}"
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_file(path) as f:
            return f.read()

    def object(self, name: str) -> dict | None:
        """A JSON file's object; null if there is none.  Raises ``ValueError`` if it holds something else."""
        data = self.read(name)
        if data is None:
            return None
        found = json.loads(data)
        if not isinstance(found, dict):
            raise ValueError("not an object")
        return found

    def sound_object(self, name: str) -> dict | None:
        try:
            return self.object(name)
        except ValueError:
            return None


class Bundle(InputPartition):
    def __init__(self, uri: str, name: str, place: int) -> None:
        super().__init__(None)
        self.uri, self.name, self.place = uri, name, place


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")


def _number(name: str) -> int | None:
    digits = name.split("-")[1] if "-" in name else ""
    return int(digits) if digits.isdecimal() else None


def graded_run(run: Folder) -> dict:
    """The columns of one graded run from ``metrics`` on; raises ``ValueError`` for a file that is no JSON object."""
    grading = run.object("grading.json")
    if grading is None:
        raise FileNotFoundError
    part = lambda d, name: d.get(name) if isinstance(d.get(name), dict) else {}
    summary, metrics, notes = part(grading, "summary"), part(grading, "execution_metrics"), part(grading, "user_notes_summary")
    seconds, tokens = part(grading, "timing").get("total_duration_seconds", 0.0), None
    if not seconds and (timing := run.sound_object("timing.json")) is not None:
        seconds, tokens = timing.get("total_duration_seconds", 0.0), timing.get("total_tokens", 0)
    told = [e if isinstance(e, dict) else {} for e in grading.get("expectations") or []]
    lacking = sum("text" not in e or "passed" not in e for e in told)
    return {
        **{c: summary.get(c, 0) for c in ("pass_rate", "passed", "failed", "total")}, "time_seconds": seconds, "tokens": tokens or metrics.get("output_chars", 0),
        "tool_calls": metrics.get("total_tool_calls", 0), "errors": metrics.get("errors_encountered", 0),
        "expectations": [(e.get("text"), e.get("passed"), e.get("evidence")) for e in told],
        "notes": [str(n) for key in ("uncertainties", "needs_review", "workarounds") for n in notes.get(key) or []],
        "warning": f"{lacking} expectations without text or passed" if lacking else None,
    }


class GradedReader(_Reader):
    """Runs below ``eval-*`` directories, which lie in the root or in its ``runs``."""

    def partitions(self) -> list[Bundle]:
        top = Folder.at(self.root)
        where = f"{self.root}/runs" if "runs" in top.names(folders=True) else self.root
        names = [n for n in Folder.at(where).names(folders=True) if n.startswith("eval-")]
        return [Bundle(f"{where}/{n}", n, i) for i, n in enumerate(names)]

    def read(self, bundle: Bundle | None) -> Iterator[tuple]:
        if bundle is None:  # a root without bundles
            return
        names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", GRADED)]
        folder = Folder.at(bundle.uri)
        try:
            told = folder.object("eval_metadata.json")
            given = _number(bundle.name) if told is None else told.get("eval_id")
        except ValueError:
            given = None
        eval_id = str(bundle.place if given is None else given)
        for config in folder.names(folders=True):
            runs = folder.inside(config)
            for name in runs.names(folders=True):
                if not name.startswith("run-"):
                    continue
                file = f"{runs.path}/{name}/grading.json"
                row = {"place": bundle.place, "eval_id": eval_id, "configuration": config, "run_number": _number(name), "file": file}
                try:
                    row |= graded_run(runs.inside(name))
                    row |= {c: float(row[c] or 0) for c in ("pass_rate", "time_seconds")} | {c: int(row[c] or 0) for c in ("passed", "failed", "total", "tokens", "tool_calls", "errors")}
                except FileNotFoundError:
                    row["warning"] = f"grading.json not found in {runs.path}/{name}"
                except (ValueError, TypeError) as e:
                    row = {**{c: row[c] for c in ("place", "eval_id", "configuration", "run_number", "file")}, "warning": f"Invalid JSON in {file}: {e}"}
                yield tuple(row.get(c) for c in names)


def classified(name: str) -> tuple[str, str]:
    """(kind, MIME type) of an output by its name."""
    end = f".{name.rpartition('.')[2].lower()}" if "." in name[1:] else ""
    kind = "text" if end in TEXT else "image" if end in IMAGES else end[1:] if end in (".pdf", ".xlsx") else "binary"
    return kind, MIMES.get(end) or mimetypes.guess_type(name)[0] or "application/octet-stream"


class ReviewReader(_Reader):
    """Directories with ``outputs`` in them, wherever they lie below the root."""

    def partitions(self) -> list[Bundle]:
        names = Folder.at(self.root).names(folders=True)
        if "outputs" in names:
            return [Bundle(self.root, "", 0)]
        return [Bundle(self.root, n, i) for i, n in enumerate(names) if n not in NOT_WALKED]

    def read(self, bundle: Bundle | None) -> Iterator[tuple]:
        if bundle is None:
            return
        top = Folder.at(bundle.uri)
        todo = [bundle.name]
        while todo:
            place = todo.pop()
            folder = top.inside(place) if place else top
            below = folder.names(folders=True)
            if "outputs" in below:
                yield self._run(top, place)
            else:
                todo += [f"{place}/{n}" for n in reversed(below) if n not in NOT_WALKED]

    def _run(self, top: Folder, place: str) -> tuple:
        run = top.inside(place) if place else top
        above = Folder(run.files, run.path.rpartition("/")[0])
        prompt, eval_id, bad = "", None, []
        for folder in (run, above):
            try:
                told = folder.object("eval_metadata.json") or {}
            except ValueError:
                told = {}
                bad.append("eval_metadata.json")
            prompt, eval_id = str(told.get("prompt") or ""), told.get("eval_id", eval_id)
            if prompt:
                break
        for folder in (run, run.inside("outputs")):
            if not prompt and (text := folder.read("transcript.md")) is not None:
                found = re.search(r"## Eval Prompt\n\n([\s\S]*?)(?=\n##|$)", text.decode(errors="replace"))
                prompt = found.group(1).strip() if found else ""
        grading = None
        for folder in (run, above):
            try:
                grading = grading or folder.object("grading.json")
            except ValueError:
                bad.append("grading.json")
        outputs = []
        for name in run.inside("outputs").names(folders=False):
            if name not in NOT_OUTPUTS:
                kind, mime = classified(name)
                data = run.inside("outputs").read(name) or b""
                outputs.append((name, kind, mime, data.decode(errors="replace") if kind == "text" else None, None if kind == "text" else data))
        number = eval_id if isinstance(eval_id, int) else _number(f"-{eval_id}")
        return place.replace("/", "-") or ".", number, prompt or NO_PROMPT, outputs, json.dumps(grading) if grading else None, f"Invalid JSON in {', '.join(bad)}" if bad else None


class GradedRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graded_runs"

    def schema(self) -> str:
        return GRADED

    def reader(self, schema) -> DataSourceReader:
        return GradedReader(self.options["path"])


class ReviewRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_runs"

    def schema(self) -> str:
        return REVIEWED

    def reader(self, schema) -> DataSourceReader:
        return ReviewReader(self.options["path"])


def graded_runs(spark: SparkSession, root: str) -> DataFrame:
    """Graded runs with their bundle's ``place``; files that are missing or unreadable as rows with a ``warning``."""
    spark.dataSource.register(GradedRuns)
    return spark.read.format("graded_runs").load(root)


def review_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs with their outputs and ``pos``, their place by (eval id, null last, then id)."""
    spark.dataSource.register(ReviewRuns)
    rows = spark.read.format("review_runs").load(root)
    return positions(rows.withColumn("__last", F.col("eval_id").isNull()), ["__last", "eval_id", "id"]).drop("__last")


def eval_ids(runs: DataFrame) -> DataFrame:
    """The distinct ``eval_id`` of runs with their ``pos``, numbers before texts."""
    ids = runs.where("eval_id IS NOT NULL AND run_number IS NOT NULL AND passed IS NOT NULL").select("eval_id").distinct().withColumn("number", F.expr("try_cast(eval_id AS bigint)"))
    return positions(ids.withColumn("__text", F.col("number").isNull()), ["__text", "number", "eval_id"]).select("eval_id", "pos")


def first_two(runs: DataFrame) -> DataFrame:
    """One row: the signed differences of the means of the first two configurations, in the order in which bundles tell them.

    With one configuration its means, without any 0.  Means are rounded to four places before.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)
    seen = runs.groupBy("configuration").agg(F.min("place").alias("place"), *map(mean, ("pass_rate", "time_seconds", "tokens")))
    # Configurations are few: names of directories, told apart by people.
    ranked = positions(seen, ["place", "configuration"]).where("pos <= 2")
    difference = lambda c: F.coalesce(F.sum(F.when(F.col("pos") == 1, F.col(c)).otherwise(-F.col(c))), F.lit(0.0))
    return ranked.agg(*(F.format_string(f"%+.{n}f", difference(c)).alias(c) for c, n in (("pass_rate", 2), ("time_seconds", 1), ("tokens", 0))))
