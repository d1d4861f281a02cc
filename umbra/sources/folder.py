"""A Spark data source that writes files, and one JSON document, to a folder: all of it or nothing.

Tasks write below a folder of their own, `_umbra-<job>/<task attempt>`. Only when all tasks are through does the commit move what the
attempts that count have written to its place, and join their pieces of the JSON document in the order of the partitions; an attempt
that failed, or ran a second time, leaves nothing. An aborted job leaves the folder as it was; a task that is late finds no place to write to.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "path string, content binary, section string, value string"
NAME = "umbra_folder"
#: Bytes of the JSON document that the commit holds at a time.
PIECE = 1 << 20


def file_system(folder: str):
    """The file system of a folder and its path there."""
    import pyarrow.fs as fs

    return (fs.LocalFileSystem(), folder.removeprefix("file:")) if "://" not in folder.removeprefix("file:/") else fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    """Of one attempt: its partition, (temporary path, path) of its files, and (section, temporary path, values) of its pieces of the document."""

    partition: int
    files: list[tuple[str, str]] = field(default_factory=list)
    pieces: list[tuple[str, str, int]] = field(default_factory=list)


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.document = options["path"], options.get("document")
        # A section without a name makes the document an array; else it is an object of arrays, in this order.
        self.sections = options.get("sections", "").split(",")
        self.job = f"_umbra-{uuid.uuid4().hex}"
        system, base = file_system(self.folder)
        system.create_dir(posixpath.join(base, self.job), recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = file_system(self.folder)
        own = posixpath.join(base, self.job, f"{task.partitionId()}-{task.taskAttemptId()}")
        out, open_pieces = Written(task.partitionId()), {}
        system.create_dir(own, recursive=False)  # where the job has been aborted there is no place for a late task
        try:
            for batch in iterator:
                path, content, section, value = (batch.column(c) for c in ("path", "content", "section", "value"))
                for i in range(batch.num_rows):
                    if content[i].is_valid:
                        at = posixpath.join(own, f"file-{len(out.files)}")
                        with system.open_output_stream(at) as f:
                            f.write(content[i].as_buffer())
                        out.files.append((at, path[i].as_py()))
                    if value[i].is_valid:
                        name = section[i].as_py() or ""
                        if name not in open_pieces:
                            at = posixpath.join(own, f"piece-{len(open_pieces)}")
                            open_pieces[name] = [system.open_output_stream(at), at, 0]
                        stream, _, n = open_pieces[name]
                        stream.write((",\n" if n else "").encode() + value[i].as_py().encode())
                        open_pieces[name][2] += 1
        except BaseException:
            self._drop(own)
            raise
        finally:
            for stream, _, _ in open_pieces.values():
                stream.close()
        out.pieces = [(name, at, n) for name, (_, at, n) in open_pieces.items()]
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.folder)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for m in done:
            for at, path in m.files:
                target = posixpath.join(base, path)
                system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(at, target)
        if self.document:
            target = posixpath.join(base, self.document)
            whole = posixpath.join(base, self.job, "document")
            with system.open_output_stream(whole) as f:
                if self.sections != [""]:
                    f.write(b"{")
                for k, section in enumerate(self.sections):
                    f.write((f'{"," if k else ""}\n"{section}": ' if section else "").encode() + b"[")
                    some = False
                    for at in (at for m in done for name, at, _ in m.pieces if name == section):
                        f.write(b",\n" if some else b"\n")
                        some = True
                        with system.open_input_stream(at) as piece:
                            while data := piece.read(PIECE):
                                f.write(data)
                    f.write(b"\n]" if some else b"]")
                f.write(b"\n}\n" if self.sections != [""] else b"\n")
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(whole, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        self._drop(posixpath.join(file_system(self.folder)[1], self.job))

    def _drop(self, path: str) -> None:
        import pyarrow.fs as fs

        system, _ = file_system(self.folder)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options))


def write_folder(rows: DataFrame, folder: str, document: str | None = None, sections: tuple[str, ...] = ("",)) -> None:
    """Write rows of SCHEMA: each content to its path below folder, and the values (JSON texts), in the order of rows, to a document there.

    A path that is there already is overwritten; rows that share a path overwrite each other, so give them names of their own before
    (numbering.folder_names). Sections are written one after the other, each an array.
    """
    rows.sparkSession.dataSource.register(Folder)
    out = rows.write.format(NAME).mode("append").option("path", folder).option("sections", ",".join(sections))
    (out.option("document", document) if document else out).save()
