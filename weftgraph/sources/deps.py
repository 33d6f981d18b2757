"""Declared packages of a repository, from the manifests at its root; each format is read by a parser of its own."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dependency_name, url_requirement
from ..shipping import ship

Found = Iterator[tuple[str, bool]]
MANIFEST = r"^(Gemfile|go\.mod|Pipfile|pom\.xml|pyproject\.toml|Cargo\.toml|package\.json|composer\.json|requirements[^/]*\.txt|requirements/[^/]*\.txt)$"
#: Where a table of packages stands in JSON and TOML manifests; ``*`` is any key.
JSON_TABLES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "require", "require-dev")
TOML_TABLES = (
    "project.dependencies", "project.optional-dependencies.*", "dependency-groups.*", "tool.poetry.dependencies", "tool.poetry.dev-dependencies", "tool.poetry.group.*.dependencies",
    "tool.uv.sources", "dependencies", "dev-dependencies", "build-dependencies", "packages", "dev-packages",
)
NAME_PARTS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.")


def leading_name(requirement: str) -> str:
    """The package name a requirement starts with; empty if it starts with no letter."""
    n = 0
    while n < len(requirement) and requirement[n] in NAME_PARTS:
        n += 1
    return requirement[:n] if n and requirement[0].isalpha() else ""


def is_address(requirement: str) -> bool:
    """``git+ssh://...``, ``https://...`` and the like, or a version control prefix."""
    scheme, found, _ = requirement.partition("://")
    return bool(found) and bool(scheme) and all(c.isalnum() or c in "+.-" for c in scheme) or requirement.split("+")[0] in ("git", "hg", "svn", "bzr") and "+" in requirement


def at_path(made, steps: list[str]) -> Iterator:
    """Values a dotted place names in nested tables."""
    if not steps:
        yield made
    elif isinstance(made, dict):
        for key in made if steps[0] == "*" else [steps[0]] if steps[0] in made else []:
            yield from at_path(made[key], steps[1:])


def packages_of(made, places: tuple[str, ...]) -> Found:
    for place in places:
        for table in at_path(made, place.split(".")):
            if isinstance(table, dict):
                yield from ((name, False) for name in table if name != "python")
            elif isinstance(table, list):
                yield from ((name, False) for x in table if isinstance(x, str) and (name := leading_name(x.strip())))


def from_json(text: str) -> Found:
    yield from packages_of(json.loads(text), JSON_TABLES)


def from_toml(text: str) -> Found:
    yield from packages_of(tomllib.loads(text), TOML_TABLES)


def from_requirements(text: str) -> Found:
    for line in map(str.strip, text.splitlines()):
        if is_address(line):
            yield line, True
        elif name := leading_name(line):
            yield name, False


def from_gemfile(text: str) -> Found:
    """``gem`` with a quoted first argument."""
    for line in map(str.strip, text.splitlines()):
        word, _, rest = line.replace("(", " ", 1).partition(" ")
        rest = rest.strip()
        if word == "gem" and rest[:1] in ("'", '"') and rest[0] in rest[1:]:
            yield rest[1:].split(rest[0])[0], False


def from_go(text: str) -> Found:
    """Modules of ``require`` lines and blocks."""
    inside = False
    for line in (x.split("//")[0].split() for x in text.splitlines()):
        if line[:1] == [")"]:
            inside = False
        elif line[:2] == ["require", "("]:
            inside = True
        elif len(line) >= (2 if inside else 3) and (inside or line[0] == "require"):
            yield line[0 if inside else 1], False


def from_maven(text: str) -> Found:
    """Artifacts of dependencies, and of no project or plugin."""
    for node in ElementTree.fromstring(text).iter():
        if node.tag.rpartition("}")[2] == "dependency":
            yield from ((x.text.strip(), False) for x in node if x.tag.rpartition("}")[2] == "artifactId" and x.text)


READERS: dict[str, Callable[[str], Found]] = {"Gemfile": from_gemfile, "go.mod": from_go, "pom.xml": from_maven, "Pipfile": from_toml, ".toml": from_toml, ".json": from_json, ".txt": from_requirements}


def packages(path: str, text: str) -> list[tuple[str, bool]]:
    """(name, whether it is an address) of one manifest; none if it does not parse."""
    name = path.rsplit("/", 1)[-1]
    read = READERS.get(name) or READERS["." + name.rsplit(".", 1)[-1]]
    try:
        return list(read(text))
    except (ValueError, ElementTree.ParseError):
        return []


def declared(files: DataFrame) -> DataFrame:
    """files(repo, path, content) -> distinct (repo, dependency), one spelling per package."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(repo, *p) for repo, path, content in frame.itertuples(index=False) for p in packages(path, bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["repo", "name", "url"])

    raw = files.filter(F.col("path").rlike(MANIFEST)).select("repo", "path", "content").mapInPandas(run, "repo string, name string, url boolean")
    return raw.select("repo", dependency_name(F.when(F.col("url"), url_requirement("name")).otherwise(F.col("name"))).alias("dependency")).filter("dependency <> ''").distinct()


def languages(files: DataFrame) -> DataFrame:
    """Observed languages per repository: two files at least, and twenty or a twentieth of all; most first."""
    suffixes = {"py": "python", "rb": "ruby", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "rs": "rust", "kt": "kotlin", "php": "php", "cs": "csharp"}
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.element_at(F.create_map(*(F.lit(x) for kv in suffixes.items() for x in kv)), ext)
    counts = files.select("repo", lang.alias("lang")).filter("lang is not null").groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("repo").agg(F.sum("n").alias("_t"))
    kept = counts.join(total, "repo").filter((F.col("n") >= 2) & ((F.col("n") >= 20) | (F.col("n") >= 0.05 * F.col("_t"))))
    return kept.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "lang"))), lambda x: x["lang"]).alias("languages"))
