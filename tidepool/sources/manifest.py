"""Session manifests: load and validate on the driver, then frames of segments, gaps and channels."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


def load_session(path: str, verify_sources: bool = True) -> dict:
    """The manifest as a dictionary; every fault is an error that names it."""
    with open(path, encoding="utf-8") as f:
        session = json.load(f)
    need(session.get("schema_version") == 1, "schema_version must be 1")
    need(bool(IDENTIFIER.fullmatch(str(session.get("session_id", "")))), "bad session_id")
    seen = set()
    for probe in session["probes"]:
        name = str(probe.get("probe_id", ""))
        need(bool(IDENTIFIER.fullmatch(name)) and name not in seen, "bad or doubled probe_id")
        seen.add(name)
        need(probe["sample_rate_hz"] > 0 and probe["gain_uv_per_count"] > 0, "rate and gain must be positive")
        g = probe["geometry"]
        channels = len(g["x_um"])
        need(channels > 0 and len(g["y_um"]) == len(g["shank"]) == channels, "geometry columns differ in length")
        need(all(0 <= c < channels for c in probe.get("bad_channels", [])), "bad channel out of range")
        segments = probe["segments"]
        need(bool(segments) and segments == sorted(segments, key=lambda s: s["start_sample"]) and segments[0]["start_sample"] == 0, "segments must be sorted and start at 0")
        gaps = {(x["start_sample"], x["stop_sample"]) for x in probe.get("gaps", [])}
        need(all(x.get("reason") for x in probe.get("gaps", [])), "a gap needs a reason")
        found = set()
        for a, b in zip(segments, segments[1:], strict=False):
            end = a["start_sample"] + a["n_samples"]
            need(end <= b["start_sample"], "segments overlap")
            if end < b["start_sample"]:
                found.add((end, b["start_sample"]))
        need(found == gaps, "gaps and declarations differ")
        for s in segments:
            if verify_sources:
                full = os.path.join(os.path.dirname(path), s["path"])
                need(os.path.getsize(full) == s["n_samples"] * channels * 2, f"{s['path']} has another size")
    return session


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def segments(spark: SparkSession, session: dict) -> DataFrame:
    rows = [(p["probe_id"], s["path"], s["start_sample"], s["start_sample"] + s["n_samples"], s.get("day_id")) for p in session["probes"] for s in p["segments"]]
    return spark.createDataFrame(rows, "probe string, path string, start long, stop long, day string")
