"""Artwork listings: folders, ZIP members and the inventory of both."""

from __future__ import annotations

import io
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.constants import ARTWORK_TYPES
from attestra.functions.text import base_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MEMBERS = "source string, member string, size bigint, content binary, error string"


def file_type(name: Column) -> Column:
    """Extension without its dot, lower case; a leading-dot name has none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def is_supported(name: Column) -> Column:
    return file_type(name).isin(*ARTWORK_TYPES)


def list_artwork(spark: SparkSession, folder: str, limit: int | None = None,
                 with_content: bool = False) -> DataFrame:
    """Supported files directly in a folder, in case-insensitive name order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = base_name(F.col("path"))
    columns = ["path", name.alias("file_name"), F.col("length").alias("size")]
    picked = files.select(*columns, *(["content"] if with_content else [])).where(
        is_supported(F.col("file_name")))
    ordered = picked.orderBy(F.lower("file_name"), "file_name")
    return ordered if limit is None else ordered.limit(max(0, int(limit)))


def is_safe_member(member: Column) -> Column:
    """Relative member path that stays inside the archive and names a visible file."""
    name = F.element_at(F.split(member, "/"), -1)
    return (
        (member != "") & ~F.endswith(member, F.lit("/")) & ~F.startswith(member, F.lit("/"))
        & ~member.rlike(r"(^|/)\.\.(/|$)") & ~member.rlike(r"^(\./+)*__MACOSX(/|$)")
        & ~F.startswith(name, F.lit(".")) & (name != ""))


def _wanted(member: str) -> bool:
    """``is_safe_member`` and ``is_supported`` before a member is read."""
    parts = member.split("/")
    first = next((p for p in parts if p != "."), "")
    return bool(parts[-1]) and member[0] != "/" and ".." not in parts and first != "__MACOSX" and (
        parts[-1][0] != "." and parts[-1].rpartition(".")[2].lower() in ARTWORK_TYPES)


#: Rows that go to Spark at once, and the bytes at which fewer go.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows as frames: a frame costs as much as unpacking hundreds of small members."""
    kinds = dict(c.split() for c in schema.split(", "))
    whole = {name: {"bigint": "Int64", "int": "Int32"}[kind] for name, kind in kinds.items() if kind.endswith("int")}
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=list(kinds)).astype(whole)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=list(kinds)).astype(whole)


def expand_archives(archives: DataFrame, with_content: bool = True) -> DataFrame:
    """The supported file members of ZIP archives given as (path, content) rows.

    Only wanted members are unpacked, one at a time. An archive that cannot be opened and a
    member that cannot be read give a row with ``error`` and no content; the members beside
    them stay. One value holds an archive or a member, so either must stay below 2 GB.
    """

    def row(path, *values):
        return (path.rsplit("/", 1)[-1], *values)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError) as failure:
                    yield row(path, None, None, None, f"Archive could not be read: {failure}")
                    continue
                with archive:
                    for info in archive.infolist():  # one member in memory at a time
                        data, error = None, None
                        if info.is_dir() or not _wanted(info.filename):
                            continue
                        if with_content:
                            try:
                                data = archive.read(info)
                            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError,
                                    NotImplementedError) as failure:
                                error = f"Member could not be read: {failure}"
                        yield row(path, info.filename, info.file_size, data, error)

    raw = archives.select("path", "content").mapInPandas(lambda batches: _frames(members(batches), _MEMBERS), _MEMBERS)
    return raw.withColumn("file_name", F.element_at(F.split("member", "/"), -1))


#: Bytes of a member that one row holds.
CHUNK_BYTES = 1 << 20

_LISTED = "path string, source string, member string, size bigint, packed binary, method int, crc bigint, error string"
_CHUNKS = "path string, source string, member string, size bigint, chunk bigint, content binary, error string"


def _packed(content: bytes, info: zipfile.ZipInfo) -> bytes:
    """A member's stored bytes: behind its own header, whose name and extra field may differ in length."""
    at = info.header_offset
    header = content[at:at + 30]
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("Bad magic number for file header")
    begin = at + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
    if begin + info.compress_size > len(content):
        raise zipfile.BadZipFile("Member is cut off")
    return content[begin:begin + info.compress_size]


def list_members(archives: DataFrame) -> DataFrame:
    """One row per wanted member of (path, content) archives, from their central directories.

    ``packed`` holds the member's stored bytes only; nothing is unpacked here. An archive that
    cannot be opened gives one row with ``error``.
    """
    def row(path, *values):
        return (path, path.rsplit("/", 1)[-1], *values)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except (zipfile.BadZipFile, TypeError) as failure:
                    yield row(path, None, None, None, None, None, f"Archive could not be read: {failure}")
                    continue
                for info in infos:
                    if info.is_dir() or not _wanted(info.filename):
                        continue
                    data, error = None, None
                    try:
                        if info.flag_bits & 1:
                            raise zipfile.BadZipFile("Member is encrypted")
                        data = _packed(content, info)
                    except zipfile.BadZipFile as failure:
                        error = f"Member could not be read: {failure}"
                    yield row(path, info.filename, info.file_size, data, info.compress_type, info.CRC, error)

    return archives.select("path", "content").mapInPandas(lambda batches: _frames(listed(batches), _LISTED), _LISTED)


def member_chunks(members: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The contents of listed members as rows of at most ``chunk_bytes``, numbered from 0.

    Members are dealt over all tasks, so an archive's members are unpacked side by side, and a
    member of any size is unpacked a chunk at a time. An empty member has one empty chunk. A member
    whose bytes are broken has the chunks before the fault and then one with ``error``.
    """
    def unpacked(data: bytes, method: int, crc: int, size: int) -> Iterator[bytes]:
        if method == zipfile.ZIP_STORED:
            pieces = (data[at:at + chunk_bytes] for at in range(0, len(data), chunk_bytes))
        elif method == zipfile.ZIP_DEFLATED:
            def inflate():
                machine, rest = zlib.decompressobj(-15), data
                while not machine.eof:
                    piece = machine.decompress(rest, chunk_bytes)
                    if not piece and not machine.unconsumed_tail:
                        break
                    rest = machine.unconsumed_tail
                    yield piece
            pieces = inflate()
        else:
            raise NotImplementedError(f"compression method {method}")
        held, seen, total = b"", 0, 0
        for piece in pieces:
            seen, total = zlib.crc32(piece, seen), total + len(piece)
            held += piece
            while len(held) > chunk_bytes:
                yield held[:chunk_bytes]
                held = held[chunk_bytes:]
        if seen != crc or total != size:
            raise zipfile.BadZipFile("Bad CRC-32")
        yield held

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, source, member, size, data, method, crc, error in batch.itertuples(index=False):
                head, at = (path, source, member, None if pd.isna(size) else int(size)), 0
                if error is not None:
                    yield (*head, 0, None, error)
                    continue
                try:
                    for content in unpacked(data, int(method), int(crc), int(size)):
                        yield (*head, at, content, None)
                        at += 1
                except (zipfile.BadZipFile, zlib.error, NotImplementedError) as failure:
                    yield (*head, at, None, f"Member could not be read: {failure}")

    return members.repartition("path", "member").mapInPandas(
        lambda batches: _frames(chunks(batches), _CHUNKS), _CHUNKS)


def inventory(files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Source, file name, size in KB, type and input type of single files and ZIP members."""
    def rows(df, source, kind):
        return df.select(
            source.alias("Source"), F.col("file_name").alias("File Name"),
            F.round(F.col("size") / 1024.0, 2).alias("Size KB"),
            file_type(F.col("file_name")).alias("Type"), F.lit(kind).alias("Input Type"))

    listed = rows(files, F.col("file_name"), "Uploaded File")
    if members is None:
        return listed
    read = members.where(F.col("error").isNull()) if "error" in members.columns else members
    return listed.unionByName(rows(read, F.col("source"), "ZIP Member"))
