"""Standard MIDI files as a table of notes, and notes as MIDI files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "path string, track string, program int, is_drum boolean, pitch int, velocity int, start_us bigint, end_us bigint, error string"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def parse(data: bytes) -> list[tuple[str, int, bool, int, int, int, int]]:
    """(track name, program, is_drum, pitch, velocity, start_us, end_us) of every note; times by the file's tempo map."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("SMPTE time is not supported")
    at, tempos, raw = 8 + size, [(0, 500_000)], []
    for number in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("a track is missing")
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, tick, status, name, programs, open_notes = at + 8, 0, 0, "", {}, {}
        while at < end:
            delta, at = _number(data, at)
            tick += delta
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind = data[at]
                length, at = _number(data, at + 1)
                body, at = data[at : at + length], at + length
                if kind == 0x03:
                    name = body.decode("utf-8", "replace")
                elif kind == 0x51:
                    tempos.append((tick, int.from_bytes(body, "big")))
                continue
            if status in (0xF0, 0xF7):
                length, at = _number(data, at)
                at += length
                continue
            kind, channel = status & 0xF0, status & 0x0F
            if kind in (0xC0, 0xD0):
                if kind == 0xC0:
                    programs[channel] = data[at]
                at += 1
                continue
            a, b = data[at], data[at + 1]
            at += 2
            if kind == 0x90 and b:
                open_notes.setdefault((channel, a), []).append((tick, b))
            elif kind in (0x80, 0x90) and open_notes.get((channel, a)):
                start, velocity = open_notes[channel, a].pop(0)
                raw.append((name or f"track {number}", programs.get(channel, 0), channel == 9, a, velocity, start, tick))
        at = end
    tempos.sort()

    def micros(tick: int) -> int:
        total = 0
        for (t, tempo), (nxt, _) in zip(tempos, [*tempos[1:], (tick, 0)]):
            if t >= tick:
                break
            total += (min(nxt, tick) - t) * tempo
        return round(total / division)

    return [(n, p, d, pitch, v, micros(s), micros(e)) for n, p, d, pitch, v, s, e in raw]


def _size(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def encode(tracks: list[tuple[str, int, bool, list[tuple[int, int, int, int]]]], division: int = 480) -> bytes:
    """A file at 120 beats a minute from (name, program, is_drum, [(pitch, velocity, start_us, end_us)]); offs come before ons."""
    chunks = []
    for k, (name, program, is_drum, notes) in enumerate(tracks):
        channel = 9 if is_drum else k % 9
        events = [(round(s * division * 2 / 1_000_000), 1, bytes([0x90 | channel, p, v])) for p, v, s, _ in notes] + [(round(e * division * 2 / 1_000_000), 0, bytes([0x80 | channel, p, 0])) for p, _, _, e in notes]
        title = name.encode()
        body, last = b"\x00\xff\x03" + _size(len(title)) + title + bytes([0, 0xC0 | channel, program]), 0
        for tick, _, message in sorted(events):
            body += _size(max(0, tick - last)) + message
            last = max(last, tick)
        body += b"\x00\xff\x2f\x00"
        chunks.append(b"MTrk" + struct.pack(">I", len(body)) + body)
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(chunks), division) + b"".join(chunks)


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                out += [(path, *note, None) for note in parse(content)]
            except (ValueError, IndexError, struct.error) as e:  # one broken file is a row, not a failed job
                out.append((path, None, None, None, None, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NOTES.split(", ")]).astype({"program": "Int32", "pitch": "Int32", "velocity": "Int32", "start_us": "Int64", "end_us": "Int64"})


def read_midi(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all files under a folder; a file that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(_parse_rows, NOTES)


def named_tracks(notes: DataFrame, name: str = "other") -> DataFrame:
    """Notes of tracks of one name, in any case and with blanks around it, drums left out."""
    return notes.where((F.lower(F.trim("track")) == name) & ~F.col("is_drum"))


def midi_files(notes: DataFrame, group: str = "song") -> DataFrame:
    """(group, content): one encoded file a group from (group, track, program, is_drum, pitch, velocity, start_us, end_us)."""
    packed = notes.groupBy(group, "track").agg(F.first("program").alias("program"), F.first("is_drum").alias("is_drum"), F.array_sort(F.collect_list(F.struct("start_us", "end_us", "pitch", "velocity"))).alias("n"))
    files = packed.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("track", "program", "is_drum", "n"))).alias("tracks"))

    @F.pandas_udf("binary")
    def content(tracks: pd.Series) -> pd.Series:
        return tracks.map(lambda ts: encode([(t["track"], int(t["program"] or 0), bool(t["is_drum"]), [(int(x["pitch"]), int(x["velocity"]), int(x["start_us"]), int(x["end_us"])) for x in t["n"]]) for t in ts]))

    return files.select(group, content("tracks").alias("content"))
