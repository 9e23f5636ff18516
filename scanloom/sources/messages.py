"""A log of messages as a table, as a stream and as a sink: what detector and encoder publish, in the order of arrival.

A log is a folder of segments, `segment-<number>-<messages>.log`, each a sequence of messages behind their lengths (4 bytes,
big-endian), with a file beside it of where some of them begin; one without is walked.  Segments appear whole, by renaming, and are numbered without gaps, so a place in the log is a segment's number
and a message's place in it, the same for every reader and after every restart."""

from __future__ import annotations

import json
import re
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

_NAME = re.compile(r"segment-(\d+)-(\d+)\.log$")
#: A message's length before it, and its bytes.
_LENGTH, _LENGTH_BYTES = ">I", 4
#: One message in this many has its place noted beside the segment, so that a reader need not walk to it.
PLACED = 100
_PLACE, _PLACE_BYTES = ">Q", 8


def _folder(path: str):
    """(file system, folder) of a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(number, messages, file) of the segments from the first one up to a gap."""
    from pyarrow import fs

    files, base = _folder(path)
    found = sorted((int(m[1]), int(m[2]), f.path) for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if (m := _NAME.search(f.path)))
    return [s for i, s in enumerate(found) if s[0] == found[0][0] + i]


def _places(file: str) -> str:
    """The file beside a segment that says where every PLACED-th message begins: 8 bytes each, big-endian."""
    return file.removesuffix(".log") + ".places"


def _begin(files, file: str, skip: int) -> tuple[int, int]:
    """(message, byte) of the last known place up to the message at `skip`; the segment's start where none is known."""
    from pyarrow import fs

    at = skip // PLACED
    if at and files.get_file_info(_places(file)).type == fs.FileType.File:
        with files.open_input_file(_places(file)) as f:
            at = min(at, f.size() // _PLACE_BYTES - 1)
            if at > 0:
                return at * PLACED, struct.unpack(_PLACE, f.read_at(_PLACE_BYTES, at * _PLACE_BYTES))[0]
    return 0, 0


def read_messages(path: str, file: str, skip: int):
    """The messages of a segment from the one at `skip` on."""
    files, _ = _folder(path)
    k, at = _begin(files, file, skip)
    with files.open_input_file(file) as f:
        size = f.size()
        while at < size:
            (n,) = struct.unpack(_LENGTH, f.read_at(_LENGTH_BYTES, at))
            if k >= skip:
                yield f.read_at(n, at + _LENGTH_BYTES)
            at, k = at + _LENGTH_BYTES + n, k + 1


def _delete_places(files, file: str) -> None:
    from pyarrow import fs

    if files.get_file_info(_places(file)).type == fs.FileType.File:
        files.delete_file(_places(file))


def _is_header(message: bytes) -> bool:
    """Whether a message announces a frame: JSON with the key `frame`."""
    if not message.startswith(b"{"):
        return False
    try:
        return "frame" in json.loads(message)
    except ValueError:
        return False


@dataclass
class Piece(InputPartition):
    """Messages first to last (exclusive) of a segment, and the segments behind it, into which a frame may reach."""

    number: int
    first: int
    last: int
    file: str
    later: tuple[str, ...] = ()


class MessageLog(DataSource):
    """`scan_messages`: rows of a log.

    Options: path; kind "detector" (segment, message, header, description, payload: a header and the two messages behind
    it, whatever lies between frames is passed over, frames that lack one of the three too) or "encoder" (segment,
    message, value: each message); messages_per_task (10,000).

    As a stream: max_messages bounds a micro-batch; `state`, a file, then keeps how far batches were handed out, so that a
    restarted query goes on behind them.  Without it a micro-batch takes what is there.  delete_read "true" deletes
    segments once their batch is committed.

    As a sink (append): rows of one column, parts (array of binary), each part a message.  A task writes a segment that
    the commit puts at the end of the log, in the order of the tasks; tasks that fail leave nothing behind.  A log has one
    writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "scan_messages"

    def schema(self) -> str:
        return "segment bigint, message bigint, value string" if self.options.get("kind", "detector") == "encoder" else "segment bigint, message bigint, header string, description string, payload binary"

    def reader(self, schema):
        return _LogReader(dict(self.options))

    def streamReader(self, schema):
        return _LogStream(dict(self.options))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a log can only be appended to")
        return _LogWriter(dict(self.options))


class _Log:
    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.frames = options.get("kind", "detector") != "encoder"
        self.per_task = int(options.get("messages_per_task", 10_000))

    def end(self) -> tuple[int, int]:
        """The place behind the last message that may be read: a frame's header only when its two messages are there."""
        found = segments(self.path)
        keep = 2 if self.frames else 0
        for number, n, _ in reversed(found):
            if n > keep:
                return number, n - keep
            keep -= n
        return (found[0][0], 0) if found else (0, 0)

    def between(self, start: tuple[int, int], end: tuple[int, int]) -> list[Piece]:
        found = segments(self.path)
        if start < end and (not found or found[0][0] > start[0]):
            raise RuntimeError("the log no longer has the messages from its start on")
        out = []
        for i, (number, n, file) in enumerate(found):
            first = start[1] if number == start[0] else 0
            last = end[1] if number == end[0] else n
            if start[0] <= number <= end[0]:
                # two messages reach over a border; segments can be as short as one message
                later = tuple(f for _, _, f in found[i + 1 : i + 3])
                out += [Piece(number, a, min(a + self.per_task, last), file, later) for a in range(first, last, self.per_task)]
        return out

    def rows(self, piece: Piece | None):
        if piece is None:  # an empty log has no pieces; Spark then reads once with none
            return

        def behind():
            yield from read_messages(self.path, piece.file, piece.first)
            for file in piece.later:
                yield from read_messages(self.path, file, 0)

        ahead, source = [], behind()
        for k in range(piece.first, piece.last):
            while len(ahead) < (3 if self.frames else 1) and (m := next(source, None)) is not None:
                ahead.append(m)
            message = ahead.pop(0)
            if not self.frames:
                yield piece.number, k, message.decode()
            elif len(ahead) >= 2 and _is_header(message) and not _is_header(ahead[0]) and not _is_header(ahead[1]):
                yield piece.number, k, message.decode(), ahead[0].decode(), ahead[1]


class _LogReader(_Log, DataSourceReader):
    def partitions(self):
        found = segments(self.path)
        return self.between((found[0][0], 0), self.end()) if found else []

    def read(self, piece):
        yield from self.rows(piece)


class _LogStream(_Log, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options["max_messages"]) if "max_messages" in options else None
        if self.most is not None and "state" not in options:
            raise ValueError("max_messages needs the option `state`")
        #: Up to where batches were handed out, and whether Spark has planned the last of them; None before the first look.
        self.given: tuple[int, int] | None = None
        self.planned, self.looked = True, False

    def initialOffset(self) -> dict:
        found = segments(self.path)
        return {"segment": found[0][0] if found else 0, "message": 0}

    def latestOffset(self) -> dict:
        """Without a bound, the end of the log.  With one, each call goes on from what was handed out last.  After a restart
        that is handed out again if no batch was planned up to there: Spark may not have noted it."""
        end = self.end()
        if self.most is not None:
            first, self.looked = not self.looked, True
            if first and self.given is None:
                self._recall()
            if self.given is None or self.planned or not first:
                begin = self.given or (self.initialOffset()["segment"], 0)
                ahead = self._ahead(begin, end)
                if ahead != self.given:
                    self._note(ahead, False)
            end = self.given
        return {"segment": end[0], "message": end[1]}

    def _recall(self) -> None:
        from pyarrow import fs

        files, at = _folder(self.options["state"])
        if files.get_file_info(at).type != fs.FileType.NotFound:
            with files.open_input_stream(at) as f:
                given, self.planned = json.loads(f.read())
            self.given = tuple(given)

    def _note(self, given: tuple[int, int], planned: bool) -> None:
        files, at = _folder(self.options["state"])
        self.given, self.planned, tmp = given, planned, f"{at}.{uuid.uuid4().hex}"
        with files.open_output_stream(tmp) as f:
            f.write(json.dumps([given, planned]).encode())
        files.move(tmp, at)

    def _ahead(self, begin: tuple[int, int], end: tuple[int, int]) -> tuple[int, int]:
        left, at = self.most, begin
        for number, n, _ in segments(self.path):
            if number < at[0]:
                continue
            if number > at[0]:
                at = (number, 0)
            take = min(left, n - at[1])
            left, at = left - take, (number, at[1] + take)
            if not left:
                break
        return max(begin, min(at, end))

    def partitions(self, start: dict, end: dict):
        to = (end["segment"], end["message"])
        if self.most is not None and (self.given is None or to >= self.given):
            self._note(to, True)
        return self.between((start["segment"], start["message"]), to)

    def read(self, piece):
        yield from self.rows(piece)

    def commit(self, end: dict) -> None:
        """What lies before `end` is in the query's checkpoint now."""
        if self.options.get("delete_read", "false") == "true":
            files, _ = _folder(self.path)
            for number, _, file in segments(self.path):
                if number < end["segment"]:
                    files.delete_file(file)
                    _delete_places(files, file)

    def stop(self) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    file: str
    messages: int


class _LogWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        files, base = _folder(self.path)
        files.create_dir(base)

    def write(self, rows):
        files, base = _folder(self.path)
        file, n, at, places = f"{base}/_writing-{uuid.uuid4().hex}", 0, 0, []
        try:
            with files.open_output_stream(file) as f:
                for row in rows:
                    for part in row[0]:
                        if n % PLACED == 0:
                            places.append(struct.pack(_PLACE, at))
                        f.write(struct.pack(_LENGTH, len(part)) + bytes(part))
                        n, at = n + 1, at + _LENGTH_BYTES + len(part)
            if len(places) > 1:
                with files.open_output_stream(_places(file)) as f:
                    f.write(b"".join(places))
        except BaseException:
            files.delete_file(file)
            _delete_places(files, file)
            raise
        return _Written(file, n)

    def commit(self, messages):
        from pyarrow import fs

        files, base = _folder(self.path)
        have = segments(self.path)
        number = have[-1][0] + 1 if have else 0
        for m in messages:
            if m is not None and m.messages:
                name = f"{base}/segment-{number:010d}-{m.messages}.log"
                if files.get_file_info(_places(m.file)).type == fs.FileType.File:
                    files.move(_places(m.file), _places(name))  # first, so that a segment has its places when it appears
                files.move(m.file, name)
                number += 1
            elif m is not None:
                files.delete_file(m.file)

    def abort(self, messages):
        files, _ = _folder(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.file)
                _delete_places(files, m.file)
