"""Text files of sessions, one file a session in hashed folders, as a Spark data source: ``spark.read`` / ``df.write`` ``.format("session_files")``.

Written rows are ``bucket`` (folder), ``session_id`` (file name) and ``line``, sorted by bucket and session within a task; option ``kind``
is the file ending.  A task attempt writes below ``_temporary``; only the folders of attempts that the job commits are moved into place, and
what other attempts left is deleted on commit and on abort.  ``_SUCCESS`` is removed first and written last.

Read rows are cues or turns of ``srt``, ``vtt``, ``ass``, ``txt`` and ``rttm`` files: session_id, ordinal (from 1), start and end in
milliseconds (``txt`` has no end), speaker, text (null in ``rttm``).  What cannot be read as a cue comes as a row with only session_id, ordinal and
``corrupt``.  A folder of the top level is a partition; loose files are taken in groups.  Paths may have any scheme that
``pyarrow.fs`` opens.
"""
from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "session_id string, ordinal bigint, start bigint, end bigint, speaker string, text string, corrupt string"
ARROW = pa.schema([("session_id", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("speaker", pa.string()), ("text", pa.string()), ("corrupt", pa.string())])
#: Rows of a batch that a reader hands over, and loose files of one partition.
BATCH_ROWS, LOOSE_FILES = 4096, 64
FORMAT = "session_files"

Cue = tuple[int | None, int | None, str | None, str | None, str | None]  # start, end, speaker, text, corrupt


def open_root(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


# ---- writing ---------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    folders: list[str]


class SessionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options["kind"], overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        return self.write_attempt(iterator, f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex)

    def write_attempt(self, batches: Iterator[pa.RecordBatch], attempt: str) -> Written:
        disk, root = open_root(self.path)
        base = f"{root}/_temporary/{self.job}/{attempt}"
        last, out, folders = None, None, []
        try:
            for batch in batches:
                columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("bucket", "session_id", "line"))
                for bucket, session, line in zip(*columns, strict=True):
                    if session is None:
                        raise ValueError("a row has no session_id")
                    at = (bucket, session.encode())
                    if at != last:
                        if last is not None and at < last:
                            raise ValueError("rows are not sorted by bucket and session_id")
                        if out:
                            out.close()
                        if not folders or folders[-1] != f"bucket={bucket}":
                            folders.append(f"bucket={bucket}")
                            disk.create_dir(f"{base}/{folders[-1]}", recursive=True)
                        out, last = disk.open_output_stream(f"{base}/{folders[-1]}/{quote(session, safe=' ')}.{self.kind}"), at
                    out.write((line + "\n").encode())
        finally:
            if out:
                out.close()
        return Written(attempt, folders)

    def commit(self, messages: list[Written | None]) -> None:
        disk, root = open_root(self.path)
        disk.create_dir(root, recursive=True)
        if disk.get_file_info(f"{root}/_SUCCESS").type != fs.FileType.NotFound:
            disk.delete_file(f"{root}/_SUCCESS")
        if self.overwrite:
            for old in disk.get_file_info(fs.FileSelector(root)):
                if old.base_name != "_temporary":
                    (disk.delete_dir if old.is_file is False else disk.delete_file)(old.path)
        for message in messages:
            for folder in message.folders if message else ():
                made, target = f"{root}/_temporary/{self.job}/{message.attempt}/{folder}", f"{root}/{folder}"
                if disk.get_file_info(target).type == fs.FileType.NotFound:
                    disk.move(made, target)
                else:  # appended: a session's file replaces its earlier one
                    for f in disk.get_file_info(fs.FileSelector(made)):
                        disk.move(f.path, f"{target}/{f.base_name}")
        self.forget(disk, root)
        with disk.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        disk, root = open_root(self.path)
        self.forget(disk, root)

    def forget(self, disk: fs.FileSystem, root: str) -> None:
        """Delete what this job's attempts left, and the folder for that if no other job uses it."""
        held = f"{root}/_temporary"
        if disk.get_file_info(f"{held}/{self.job}").type != fs.FileType.NotFound:
            disk.delete_dir(f"{held}/{self.job}")
        if disk.get_file_info(held).type != fs.FileType.NotFound and not disk.get_file_info(fs.FileSelector(held)):
            disk.delete_dir(held)


# ---- reading ---------------------------------------------------------------------------------------------------------


def clock_ms(text: str) -> int:
    """Milliseconds of H:MM:SS with any decimals after a point or comma."""
    whole, _, part = text.strip().replace(",", ".").partition(".")
    h, m, s = (int(x) for x in whole.split(":"))
    return ((h * 60 + m) * 60 + s) * 1000 + int(part.ljust(3, "0")[:3] or 0)


def seconds_ms(text: str) -> int:
    """Milliseconds of a plain decimal number of seconds, without binary rounding."""
    whole, _, part = text.partition(".")
    return int(whole) * 1000 + int(part.ljust(3, "0")[:3] or 0)


def blocks(lines: Iterator[str]) -> Iterator[list[str]]:
    held: list[str] = []
    for line in lines:
        if line:
            held.append(line)
        elif held:
            yield held
            held = []
    if held:
        yield held


def cue_of(block: list[str], speaker_of: Callable[[str], tuple[str | None, str]]) -> Cue:
    """A numbered cue: name, times, text."""
    at = 0 if "-->" in block[0] else 1
    try:
        left, right = block[at].split("-->")
        start, end = clock_ms(left), clock_ms(right.split()[0])
        speaker, text = speaker_of("\n".join(block[at + 1 :]))
    except (ValueError, IndexError):
        return None, None, None, None, "\n".join(block)
    return start, end, speaker, text, None


def named(text: str) -> tuple[str | None, str]:
    speaker, mark, rest = text.partition(": ")
    return (speaker, rest) if mark else (None, text)


def voiced(text: str) -> tuple[str | None, str]:
    found = re.match(r"<v(?:\.[^ >]*)? ([^>]*)>", text)
    return (found[1], text[found.end() :].removesuffix("</v>")) if found else (None, text)


def srt_cues(lines: Iterator[str]) -> Iterator[Cue]:
    return (cue_of(b, named) for b in blocks(lines))


def vtt_cues(lines: Iterator[str]) -> Iterator[Cue]:
    for b in blocks(lines):
        if not b[0].lstrip("\ufeff").startswith("WEBVTT") and b[0].split(" ")[0] not in ("NOTE", "STYLE", "REGION"):
            yield cue_of(b, voiced)


ESCAPED = re.compile(r"\\([\\{}Nn])")


def ass_cues(lines: Iterator[str]) -> Iterator[Cue]:
    for line in lines:
        if line.startswith("Dialogue:"):
            parts = line[9:].split(",", 9)
            try:
                text = ESCAPED.sub(lambda m: "\n" if m[1] in "Nn" else m[1], parts[9])
                yield clock_ms(parts[1]), clock_ms(parts[2]), parts[3], text, None
            except (ValueError, IndexError):
                yield None, None, None, None, line


TXT_LINE = re.compile(r"\[(\d+:\d\d:\d\d)\] (.*?): (.*)", re.S)


def txt_cues(lines: Iterator[str]) -> Iterator[Cue]:
    """Lines ``[H:MM:SS] speaker: text`` up to the closing rule; lines below one belong to it, lines before the first are the head."""
    held: list[str] = []

    def cue() -> Iterator[Cue]:
        if held:
            found = TXT_LINE.fullmatch("\n".join(held))
            yield (clock_ms(found[1]), None, found[2], found[3], None) if found else (None, None, None, None, "\n".join(held))

    for line in lines:
        if line.startswith("[") or held and line == TXT_END:
            yield from cue()
            held = []
            if line == TXT_END:
                return
            held.append(line)
        elif held and line:
            held.append(line)
    yield from cue()


TXT_END = "-" * 60


def rttm_turns(lines: Iterator[str]) -> Iterator[Cue]:
    for line in lines:
        if not line.startswith("SPEAKER "):
            if line and not line.startswith(";;"):
                yield None, None, None, None, line
            continue
        parts = line.split(" ")
        try:
            start = seconds_ms(parts[3])
            yield start, start + seconds_ms(parts[4]), " ".join(parts[7:-2]), None, None
        except (ValueError, IndexError):
            yield None, None, None, None, line


READERS: dict[str, Callable[[Iterator[str]], Iterator[Cue]]] = {"srt": srt_cues, "vtt": vtt_cues, "ass": ass_cues, "txt": txt_cues, "rttm": rttm_turns}


class Folder(InputPartition):
    """A folder whose files one task reads, or the loose files of the top level."""

    def __init__(self, folder: str | None, files: list[str] | None = None):
        self.folder, self.files = folder, files


class SessionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]
        if self.kind not in READERS:
            raise ValueError(f"kind must be one of {', '.join(READERS)}")

    def partitions(self) -> list[Folder]:
        disk, root = open_root(self.path)
        folders, loose = [], []
        for x in disk.get_file_info(fs.FileSelector(root)):
            if not x.base_name.startswith(("_", ".")):
                (loose if x.is_file else folders).append(x.path)
        loose = sorted(f for f in loose if f.endswith("." + self.kind))
        return [Folder(f) for f in sorted(folders)] + [Folder(None, loose[i : i + LOOSE_FILES]) for i in range(0, len(loose), LOOSE_FILES)]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition where there are none
            return
        disk, _ = open_root(self.path)
        if partition.folder:
            found = disk.get_file_info(fs.FileSelector(partition.folder, recursive=True))
            names = sorted(x.path for x in found if x.is_file and x.base_name.endswith("." + self.kind))
        else:
            names = partition.files or []
        rows: list[tuple] = []
        for name in names:
            session = unquote(name.rsplit("/", 1)[-1][: -len(self.kind) - 1])
            with disk.open_input_stream(name) as stream, io.TextIOWrapper(stream, "utf-8", "replace", newline="\n") as text:
                for ordinal, cue in enumerate(READERS[self.kind](line.removesuffix("\n") for line in text), 1):
                    rows.append((session, ordinal, *cue))
                    if len(rows) == BATCH_ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class SessionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options)

    def writer(self, schema, overwrite: bool) -> SessionWriter:
        return SessionWriter(self.options, overwrite)


def read_session_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cues or turns of every file below ``path``."""
    spark.dataSource.register(SessionFiles)
    return spark.read.format(FORMAT).option("kind", kind).load(path)


def write_session_files(lines: DataFrame, path: str, kind: str, order: list[str], buckets: int = 64, mode: str = "overwrite") -> None:
    """``lines`` (session_id, line and the columns of ``order``) as one file a session.  A task has whole folders and streams sorted lines,
    so neither a long session nor a full folder is held."""
    lines.sparkSession.dataSource.register(SessionFiles)
    session = F.col("session_id").cast("string")
    rows = lines.select(F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int").alias("bucket"), session.alias("session_id"), *order, "line")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "session_id", *order)
    rows.select("bucket", "session_id", "line").write.format(FORMAT).option("kind", kind).mode(mode).save(path)
