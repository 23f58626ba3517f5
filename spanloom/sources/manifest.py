"""Manifests of songs in YAML, as typed rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The rows' schema. The first four fields are required, the others may be absent.
REQUIRED = ("artist", "title", "youtube_id", "youtube_url")
SCHEMA = (
    "manifest_index int, artist string, title string, youtube_id string, youtube_url string, clip_id string, clip_tags array<string>, audio_start_sec double, "
    "clip_duration_sec double, lyrics_file string, preferred_lyrics_provider string, lrc_duration_tolerance_sec int"
)


def rows_of(raw: Any, folder: str = "") -> list[tuple]:
    """The rows of a manifest that has been read; ValueError says where one is wrong."""
    if not isinstance(raw, dict) or not isinstance(raw.get("songs", []), list):
        raise ValueError("a manifest is a mapping with a list of songs")

    def text(v: Any) -> str | None:
        return None if v is None or not str(v).strip() else str(v).strip()

    def number(v: Any, kind: type, otherwise=None):
        return otherwise if v is None else kind(v)

    out = []
    for k, song in enumerate(raw.get("songs", [])):
        if not isinstance(song, dict):
            raise ValueError(f"songs[{k}] is no mapping")
        if missing := [c for c in REQUIRED if c not in song]:
            raise ValueError(f"songs[{k}] lacks {', '.join(missing)}")
        tags = song.get("clip_tags") or []
        file = text(song.get("lyrics_file"))
        out.append(
            (
                k + 1, *(str(song[c]) for c in REQUIRED), text(song.get("clip_id")), [t for t in map(text, tags if isinstance(tags, list) else [tags]) if t], number(song.get("audio_start_sec"), float, 0.0),
                number(song.get("clip_duration_sec"), float), f"{folder}/{file}" if file and folder and not file.startswith("/") else file, text(song.get("preferred_lyrics_provider")), number(song.get("lrc_duration_tolerance_sec"), int),
            )
        )
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The songs of one manifest, a small file. Paths in it count from its folder."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(rows_of(yaml.safe_load(text[0]) if text else None, path.rpartition("/")[0]), SCHEMA)
