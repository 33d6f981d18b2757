"""What a repository says about itself: its manifest, its services, its main language, its README."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import read_files

NAMES = r"^weftgraph\.(ya?ml|json)$"
SPECS = "repo string, kind string, name string, root string, language string, error string"
README = "repo string, path string, opening string"
STOP = re.compile(r"^#+\s*(install|getting started|usage|development|contribut|license|licence|setup|test|deploy|requirement|quick ?start|table of contents)", re.IGNORECASE)


def specs_of(repo: str, made) -> list[dict]:
    """Services and libraries of one manifest; a missing or repeated name is an error. Guidance only: none; nothing declared: the repository itself."""
    if not isinstance(made, dict):
        return [{"repo": repo, "error": "not a mapping"}]
    out, seen = [], set()
    for kind, many in (("service", made.get("services")), ("library", made.get("libraries"))):
        for entry in many or []:
            name = (entry or {}).get("name") if isinstance(entry, dict) else None
            if not name or name in seen:
                return [{"repo": repo, "error": f"{kind}: {'repeated name ' + name if name else 'missing name'}"}]
            seen.add(name)
            path = (entry.get("path") or "").strip("/")
            out.append({"repo": repo, "kind": kind, "name": f"{repo}/{path}" if kind == "library" and path else name, "root": path, "language": entry.get("language") or "auto"})
    if not out and not made.get("guidance"):
        out.append({"repo": repo, "kind": "service", "name": made.get("name") or repo, "root": "", "language": "auto"})
    return out


def read_specs(files: DataFrame) -> DataFrame:
    """files(repo, path, content) -> one row per declared service or library; repositories without a manifest stand for themselves."""
    def read(repo: str, path: str, content: bytes) -> list[dict]:
        text = content.decode("utf-8", "replace")
        try:
            if path.endswith(".json"):
                made = json.loads(text)
            else:
                import yaml

                made = yaml.safe_load(text)
        except Exception:  # noqa: BLE001  parsers raise many kinds
            return [{"repo": repo, "error": "does not parse"}]
        return specs_of(repo, made)

    manifests = files.filter(F.col("path").rlike(NAMES))
    found = read_files(manifests, SPECS, read)
    rest = files.select("repo").distinct().join(manifests.select("repo").distinct(), "repo", "left_anti")
    plain = rest.select("repo", F.lit("service").alias("kind"), F.col("repo").alias("name"), F.lit("").alias("root"), F.lit("auto").alias("language"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(plain)


def guidance_roots(files: DataFrame) -> DataFrame:
    """(repo, root): folders of written rules that a manifest declares; the repository itself is the empty root."""
    def read(repo: str, path: str, content: bytes) -> list[dict]:
        try:
            import yaml

            made = yaml.safe_load(content.decode("utf-8", "replace"))
        except Exception:  # noqa: BLE001
            return []
        said = made.get("guidance") if isinstance(made, dict) else None
        said = said.get("paths") if isinstance(said, dict) else said
        return [{"repo": repo, "root": "" if p in (".", "") else p.strip("/")} for p in ([said] if isinstance(said, str) else said or []) if isinstance(p, str)]

    return read_files(files.filter(F.col("path").rlike(NAMES)), "repo string, root string", read).distinct()


#: Manifests that may describe their repository, the first that does counts.
DESCRIBED = ("package.json", "composer.json", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml", "pom.xml", "build.gradle")


def description_of(name: str, text: str) -> str:
    """The one-line description a manifest gives; empty if none or if it does not parse."""
    import ast
    import configparser
    import tomllib
    from xml.etree import ElementTree

    found: object = ""
    try:
        if name.endswith(".json"):
            made = json.loads(text)
            found = made.get("description") if isinstance(made, dict) else ""
        elif name.endswith(".toml"):
            made = tomllib.loads(text)
            found = next((t["description"] for t in (made.get("project"), (made.get("tool") or {}).get("poetry"), made.get("package")) if isinstance(t, dict) and t.get("description")), "")
        elif name == "setup.py":
            found = next((k.value.value for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) for k in n.keywords if k.arg == "description" and isinstance(k.value, ast.Constant)), "")
        elif name == "setup.cfg":
            parser = configparser.ConfigParser()
            parser.read_string(text)
            found = parser.get("metadata", "description", fallback="")
        elif name == "pom.xml":
            found = next((x.text for x in ElementTree.fromstring(text) if x.tag.rpartition("}")[2] == "description"), "")
        else:  # Gradle and gem specifications: a quoted value behind the word
            found = next((m[2] for m in (re.search(rf"\b{word}\b\s*=?\s*(['\"])(.+?)\1", text) for word in ("summary", "description")) if m), "")
    except (ValueError, SyntaxError, configparser.Error, ElementTree.ParseError):
        return ""
    return " ".join(str(found or "").split())[:400]


def descriptions(files: DataFrame) -> DataFrame:
    """(repo, path, description) of the first manifest at a repository's root that has one; a gem's specification comes last."""
    rank = F.array_position(F.array(*map(F.lit, DESCRIBED)), F.col("path"))
    wanted = files.filter((rank > 0) | F.col("path").rlike(r"^[^/]+\.gemspec$"))
    rows = read_files(wanted, "repo string, path string, description string", lambda repo, path, content: [{"repo": repo, "path": path, "description": description_of(path, content.decode("utf-8", "replace"))}])
    place = F.struct(F.when(rank > 0, rank).otherwise(len(DESCRIBED) + 1), "path")
    return rows.filter("description <> ''").groupBy("repo").agg(F.min_by(F.struct("path", "description"), place).alias("d")).select("repo", "d.path", "d.description")


def declared_purpose(files: DataFrame) -> DataFrame:
    """(repo, lines, hash_input): what a repository claims about itself, with where it says so; the claim may be out of date.

    The hash input changes with the claim and with nothing else.
    """
    said = descriptions(files).select("repo", F.col("path").alias("_from"), "description")
    prose = read_openings(files).groupBy("repo").agg(F.min_by(F.struct("path", "opening"), "path").alias("o")).select("repo", F.col("o.path").alias("_readme"), "o.opening").filter("opening <> ''")
    both = said.join(prose, "repo", "full_outer")
    head = F.concat(F.lit("Declared purpose, written by hand in "), F.concat_ws(", ", "_from", "_readme"), F.lit(". It may be out of date: what is observed below goes before it."))
    body = F.filter(F.array("description", "opening"), lambda x: F.coalesce(x, F.lit("")) != "")
    return both.select("repo", F.concat(F.array(head), F.transform(body, lambda x: F.concat(F.lit("  "), x))).alias("lines"), F.concat(F.coalesce("description", F.lit("")), F.lit("\n"), F.coalesce("opening", F.lit(""))).alias("hash_input"))


def declared_hosts(files: DataFrame) -> DataFrame:
    """slug, pos, pattern, target of a manifest's ``hosts`` in the order they stand there."""
    def read(repo: str, path: str, content: bytes) -> list[dict]:
        try:
            import yaml

            hosts = (yaml.safe_load(content.decode("utf-8", "replace")) or {}).get("hosts") or {}
        except Exception:  # noqa: BLE001
            return []
        return [{"slug": repo, "pos": i, "pattern": str(k), "target": str(v)} for i, (k, v) in enumerate(hosts.items())]

    return read_files(files.filter(F.col("path").rlike(NAMES)), "slug string, pos int, pattern string, target string", read)


def primary_language(files: DataFrame) -> DataFrame:
    """Ruby by its Gemfile or routes, TypeScript by its settings or a package with .ts files, else Python."""
    has = lambda pattern: F.max(F.col("path").rlike(pattern))
    marks = files.groupBy("repo").agg(has(r"^(Gemfile|config/routes\.rb)$").alias("rb"), has(r"^tsconfig\.json$").alias("ts"), has(r"^package\.json$").alias("pkg"), has(r"\.tsx?$").alias("tsx"))
    return marks.select("repo", F.when(F.col("rb"), "ruby").when(F.col("ts") | (F.col("pkg") & F.col("tsx")), "typescript").otherwise("python").alias("language"))


def opening(text: str, limit: int = 1500) -> str:
    """A README up to its first how-to heading, without badges, HTML, code and link targets, cut at a sentence."""
    kept = []
    for line in re.sub(r"```.*?```", "", text, flags=re.DOTALL).splitlines():
        if STOP.match(line.strip()):
            break
        line = re.sub(r"<[^>]+>", "", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", line))
        line = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line).strip()
        if line and not line.startswith(("[![", "#")):
            kept.append(line)
    body = " ".join(kept)
    if len(body) <= limit:
        return body
    cut = max(body.rfind(e, 0, limit) for e in (". ", "! ", "? "))
    return body[: cut + 1] if cut > limit // 3 else body[:limit]


def read_openings(files: DataFrame) -> DataFrame:
    return read_files(files.filter(F.lower("path").rlike(r"^readme(\.(md|rst|txt))?$")), README, lambda repo, path, content: [{"repo": repo, "path": path, "opening": opening(content.decode("utf-8", "replace"))}])
