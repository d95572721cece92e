"""Writers of one file a partition, for formats that Spark's own writers do not know.

Tasks write into a folder of the job; the commit moves what succeeded into place and removes the folder. A task that fails,
or runs twice, thus leaves nothing behind, nor does a job that aborts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str
    rows: int
    beside: list[str]  # endings of files that belong to this one


class FolderWriter(DataSourceWriter):
    """Subclasses say in ``fill`` how a file is written, and their files' endings in ``ENDINGS``, the main one first."""

    ENDINGS: tuple[str, ...] = ()

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def fill(self, files, at: str, rows: Iterator) -> tuple[int, list[str]]:
        """Writes rows to a path of a file system: their number, and endings of the files written beside it."""
        raise TypeError("a subclass writes the file")

    def _top(self):
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(self.path)
        return files, top.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task, (files, top) = TaskContext.get(), self._top()
        name = f"part-{task.partitionId():05d}-{self.job}{self.ENDINGS[0]}"
        temporary = f"_writing-{self.job}/{task.taskAttemptId()}-{name}"
        files.create_dir(f"{top}/_writing-{self.job}", recursive=True)
        rows, beside = self.fill(files, f"{top}/{temporary}", iterator)
        return Written(temporary, name, rows, beside)

    def _files(self) -> list:
        from pyarrow import fs

        files, top = self._top()
        return [x for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.type == fs.FileType.File]

    def _clean(self) -> None:
        from pyarrow import fs

        files, top = self._top()
        if files.get_file_info(f"{top}/_writing-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/_writing-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        some = [m for m in done if m.rows] or done[:1]  # an empty frame is one file without rows
        files, top = self._top()
        for x in self._files() if self.overwrite else ():
            if x.path.endswith(self.ENDINGS):
                files.delete_file(x.path)
        for m in some:
            for ending in ["", *m.beside]:
                files.move(f"{top}/{m.temporary}{ending}", f"{top}/{m.name}{ending}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = self._top()
        for x in self._files():
            if self.job in x.base_name:
                files.delete_file(x.path)
        self._clean()
