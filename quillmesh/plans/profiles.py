"""Run settings: profiles read from YAML and checked, routing by domain, years, runtime files.

These are decisions of the driver, taken once per run; rows are never touched here.
"""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import text_of

# Sources by domain, and the arXiv categories of a domain.
DOMAIN_SOURCES = {
    "cs": ("openalex", "arxiv"), "engineering": ("openalex", "crossref"), "biomedicine": ("pubmed", "openalex", "crossref"), "biology": ("pubmed", "openalex"), "physics": ("arxiv", "openalex", "crossref"),
    "chemistry": ("openalex", "crossref", "pubmed"), "social": ("openalex", "crossref"), "humanities": ("crossref",), "general": ("openalex", "crossref", "pubmed"),
}
ARXIV_CATEGORIES = {
    "cs": ("cs.LG", "cs.AI", "cs.CL", "cs.CV"), "physics": ("cond-mat.mtrl-sci", "physics.app-ph", "physics.chem-ph"), "chemistry": ("cond-mat.mtrl-sci", "physics.chem-ph"), "biology": ("q-bio",), "engineering": ("cond-mat.mtrl-sci",),
}
# Texts that end a run whose profile says so.
STOP_TEXTS = {
    "captcha": r"\b(?:captcha|recaptcha|hcaptcha)\b",
    "login_required": r"\b(?:login required|sign in to access|log in to access|institutional login|institutional sign in|access through your institution)\b",
}


def sources_for(domain: str = "general", named: str = "") -> tuple[str, ...]:
    """The sources of a run: those named, comma-separated, else those of the domain, else the general ones."""
    chosen = tuple(s.strip().lower() for s in named.split(",") if s.strip())
    return chosen or DOMAIN_SOURCES.get(domain, DOMAIN_SOURCES["general"])


def routed(hits: DataFrame, domain: str = "general", named: str = "", category: str | None = None) -> DataFrame:
    """Rows of the sources a run asks; arXiv rows only of the domain's categories where ``category`` names that column.

    A category also holds those below it ("q-bio" holds "q-bio.GN"); a domain without categories takes all.
    """
    kept = hits.filter(F.lower("source").isin(*sources_for(domain, named)))
    wanted = ARXIV_CATEGORIES.get(domain)
    if category is None or not wanted:
        return kept
    c = text_of(category)
    fits = F.greatest(*[(c == w) | c.startswith(f"{w}.") for w in wanted], F.lit(False))
    return kept.filter((F.lower("source") != "arxiv") | fits)


def year_from(explicit: int = 0, all_years: bool = False, recent: int = 0, now: int = 0) -> int:
    """First year of a search, 0 for any: an explicit one, none for all years, else the last ``recent`` years up to ``now``."""
    if explicit or all_years:
        return explicit
    return now - recent + 1 if recent > 0 else 0


def stop_reason(text, stop_on) -> Column:
    """'' or why a page ends a run, by the first of the profile's stop conditions whose text it shows."""
    shown, out = F.lower(text_of(text)), None
    for name, pattern in STOP_TEXTS.items():
        if name in stop_on:
            out = (F if out is None else out).when(shown.rlike(pattern), f"Profile stop_on {name} triggered.")
    return F.lit("") if out is None else out.otherwise("")


# --- profiles -------------------------------------------------------------------------------------


def _scalar(raw: str):
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    return {"null": None, "~": None, "true": True, "false": False}.get(raw.lower(), int(raw) if re.fullmatch(r"[+-]?\d+", raw) else raw)


def parse_profile(text: str) -> dict:
    """A mapping of mappings, lists and scalars in indented YAML; other YAML raises a ValueError."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, indent: int) -> tuple[object, int]:
        items: list = []
        fields: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if line.startswith("- "):
                items.append(_scalar(line[2:].strip()))
                at += 1
                continue
            name, colon, value = line.partition(":")
            if not colon or items:
                raise ValueError(f"profile line not understood: {line}")
            at += 1
            if value.strip():
                fields[name.strip()] = _scalar(value.strip())
            elif at < len(lines) and lines[at][0] > indent:
                fields[name.strip()], at = block(at, lines[at][0])
            else:
                fields[name.strip()] = {}
        if at < len(lines) and lines[at][0] > indent or items and fields:
            raise ValueError(f"profile line not understood: {lines[min(at, len(lines) - 1)][1]}")
        return items or fields, at

    if not lines:
        return {}
    found, end = block(0, lines[0][0])
    if end < len(lines) or not isinstance(found, dict):
        raise ValueError("a profile must be one mapping")
    return found


def read_profile(spark: SparkSession, path: str) -> dict:
    """Profile of a file on any file system Spark reads; its name is the file's unless it gives one."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {"profile_name": PurePath(path).stem} | parse_profile(text)


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]


def profile_faults(profile: dict, metadata_sources, open_access_sources, required_stops, forbidden) -> list[str]:
    """What a profile asks for that a run must not do, empty when it may be used.

    The allowed sources, the stop conditions it must keep if it names any, and the security switches
    that must stay off are given by the caller.
    """
    part = lambda d, k: d.get(k) or {}
    network, retrieval, downloads, security = (part(profile, k) for k in ("network", "retrieval", "downloads", "security"))
    faults = []

    def say(wrong, what: str):
        if wrong:
            faults.append(what)

    say(network.get("mode") not in (None, "system"), "network.mode must be system")
    say(network.get("proxy") not in (None, ""), "network.proxy is not accepted")
    for name, allowed in (("metadata_sources", metadata_sources), ("open_access_sources", open_access_sources)):
        unknown = sorted(set(_list(retrieval.get(name))) - set(allowed))
        say(unknown, f"retrieval.{name}: unsupported {unknown}")
    for publisher, settings in part(retrieval, "publisher_access").items():
        if isinstance(settings, dict) and settings.get("enabled"):
            say(settings.get("mode") != "browser_assisted", f"{publisher}: mode must be browser_assisted")
            say(int(settings.get("max_concurrency") or 1) > 1, f"{publisher}: max_concurrency must be at most 1")
            say(int(settings.get("minimum_interval_seconds") or 0) < 10, f"{publisher}: minimum_interval_seconds must be at least 10")
    stops = set(_list(retrieval.get("stop_on")))
    say(stops and set(required_stops) - stops, f"retrieval.stop_on lacks {sorted(set(required_stops) - stops)}")
    folder = PurePath(str(downloads.get("directory") or "").replace("\\", "/"))
    say(folder.is_absolute() or ".." in folder.parts, "downloads.directory must lie in the run's folder")
    say(downloads.get("overwrite") is True, "downloads.overwrite must be false")
    for name in forbidden:
        say(security.get(name) is True, f"security.{name} must be false")
    return faults


# --- files of earlier runs ------------------------------------------------------------------------


def first_readable(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Rows of the first of several JSON files that exists, none when no one does."""
    for path in paths:
        try:
            return spark.read.schema(schema).json(path, multiLine=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def output_path(lines: DataFrame, value: str = "value", order: str = "number") -> DataFrame:
    """(path): what the first line "Output: path" of a log names, by line number; no row when no line does."""
    found = F.regexp_extract(F.col(value), r"^\s*Output:\s*(.+?)\s*$", 1)
    return lines.select(F.col(order), found.alias("path")).filter("path <> ''").groupBy().agg(F.min_by("path", order).alias("path")).filter("path is not null")


def paged(items: DataFrame, page: int = 100, most: int = 500, order: str = "pos") -> DataFrame:
    """The first ``most`` items with their page number, as a paged scan of a service would give them."""
    from pyspark.sql import Window

    first = items.orderBy(order).limit(most)
    return first.withColumn("page", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / page).cast("int"))
