"""Acquisition metadata in XML: channel groups, exclusions, rate; and probes made from it."""

from __future__ import annotations

import hashlib
import math
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 4 << 20


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _number(root: ET.Element, place: str, kind, default: str | None = None):
    try:
        return kind(root.findtext(place, default))
    except (TypeError, ValueError):
        raise ValueError(f"{place} is missing or no number") from None


def _groups(root: ET.Element, place: str, count: int) -> tuple[list[list[int]], set[int]]:
    """Channels by group, and those to skip."""
    out, seen, skipped = [], set(), set()
    for group in root.findall(place):
        channels = []
        for item in [*group.findall("channel"), *group.findall("channels/channel")]:
            text, skip = (item.text or "").strip(), item.get("skip", "0").lower()
            need(text.isdigit() and int(text) < count and int(text) not in seen, "channels must be whole numbers in range, each in one group")
            need(skip in ("0", "1", "false", "true"), "bad skip flag")
            seen.add(int(text))
            channels.append(int(text))
            if skip in ("1", "true"):
                skipped.add(int(text))
        need(bool(channels), "empty channel group")
        out.append(channels)
    return out, skipped


def read_xml(payload: bytes, gain: float | None = None) -> dict:
    """Metadata of a 16-bit recording. Documents that declare types or entities are refused unparsed."""
    need(len(payload) <= MOST_BYTES, "the XML is over 4 MiB")
    need(not any(x in payload.upper() for x in (b"<!DOCTYPE", b"<!ENTITY")), "document types and entities are not read")
    try:
        root = ET.fromstring(payload)
    except ET.ParseError as e:
        raise ValueError(f"bad XML: {e}") from None
    need(root.tag == "parameters", "expected a parameters document")
    count, rate = _number(root, "acquisitionSystem/nChannels", int), _number(root, "acquisitionSystem/samplingRate", float)
    need(1 <= count <= 1_000_000 and math.isfinite(rate) and rate > 0, "bad channel count or rate")
    need(_number(root, "acquisitionSystem/nBits", int) == 16 and _number(root, "acquisitionSystem/offset", float, "0") == 0, "only signed 16 bits without offset")
    anatomy, skip_a = _groups(root, "anatomicalDescription/channelGroups/group", count)
    sorting, skip_s = _groups(root, "spikeDetection/channelGroups/group", count)
    groups = sorting or anatomy
    need(bool(groups), "no channel groups")
    bad = skip_a | skip_s | (set(range(count)) - {c for g in groups for c in g})
    need(len(bad) < count, "every channel is excluded")
    need(gain is None or (math.isfinite(gain) and gain > 0), "the gain must be positive")
    return {"channels": count, "rate": rate, "gain": gain, "groups": groups, "anatomy": anatomy, "bad": sorted(bad), "sha256": hashlib.sha256(payload).hexdigest()}


def configure_probe(meta: dict, channels: list[int], x: list[float], y: list[float]) -> list[tuple[int, float, float, int]]:
    """(channel, x, y, shank) of a known probe: groups from the metadata, excluded channels left out."""
    need(len(channels) == len(x) == len(y) > 0 and len(set(channels)) == len(channels), "channels must be unique, with a place each")
    need(all(0 <= c < meta["channels"] for c in channels) and all(map(math.isfinite, [*x, *y])), "channels must be known and places finite")
    group = {c: i for i, g in enumerate(meta["groups"]) for c in g}
    rows = [(c, float(a), float(b), group[c]) for c, a, b in zip(channels, x, y, strict=True) if c not in set(meta["bad"])]
    need(bool(rows), "no contact is left")
    return rows


def generate_probe(meta: dict) -> list[tuple[int, float, float, int]]:
    """Staggered columns, 200 apart by group, 20 to either side, 20 down by slot; excluded slots keep their place."""
    place = {c: (200.0 * (i + 1) + (20 if slot % 2 else -20), -20.0 * (slot + 1), i) for i, g in enumerate(meta["anatomy"] or meta["groups"]) for slot, c in enumerate(g)}
    wanted = sorted(set(range(meta["channels"])) - set(meta["bad"]))
    need(all(c in place for c in wanted), "channels are missing from the anatomical groups")
    return [(c, *place[c]) for c in wanted]


def probe_frame(spark: SparkSession, rows: list[tuple[int, float, float, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "channel long, x double, y double, shank int")
