"""Scalar functions as Column builders: no Python runs on the query path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses that name no peer, hosts of third parties, endings of address keys.
LOOPBACK = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
THIRD_PARTY = (
    r"(?i)(amazonaws\.com|googleapis\.com|google\.com|stripe\.com|twilio\.com|sentry\.io|"
    r"datadoghq\.com|slack\.com|github\.com|facebook\.com|cloudfront\.net|akamai)"
)
ADDRESS_WORDS = ("HOST", "HOSTNAME", "URL", "URI", "ENDPOINT", "BASE_URL", "BASE_URI", "ADDR", "ADDRESS", "SERVER")
ADDRESS_KEY = rf"(?i)_?({'|'.join(ADDRESS_WORDS)})$"
TEMPLATE = r"^(\{[^}]*\}|<[^>]*>|:[A-Za-z_].*)$"
#: Confidence labels from weakest to strongest.
CONFIDENCE = {"config": 0, "direction-unknown": 0, "ambiguous": 1, "high": 2, "static": 2, "corroborated": 3}
#: Endings of plurals and what they stand for in the singular; the longest counts.
SINGULAR = {"shes": "sh", "ches": "ch", "zes": "z", "xes": "x", "ses": "s", "ies": "y", "ss": "ss", "s": ""}
RULE_RANK = {"mandatory": 0, "recommended": 1, "contextual": 2}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ranked(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def normalize_path(path: Column | str) -> Column:
    """Parameters (``<x>``, ``{x}``, ``:x``) become ``{}``, trailing slashes go, nothing becomes ``/``."""
    named = F.regexp_replace(F.coalesce(_c(path), F.lit("")), r"<[^<>/]+>|\{[^{}/]+\}|:(?=[A-Za-z_])\w+", "{}")
    bare = F.rtrim(named, F.lit("/"))
    return F.when(bare == "", "/").otherwise(bare)


def path_pattern(path: Column | str) -> Column:
    """Segments of a path; a template segment is null."""
    segments = F.filter(F.split(F.coalesce(_c(path), F.lit("/")), "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(~s.rlike(TEMPLATE), s))


def pattern_matches(consumer: Column, provider: Column) -> Column:
    """Each provider segment is a template or equals the consumer's; a consumer template needs a provider template."""
    return F.forall(F.zip_with(provider, consumer, lambda p, c: p.isNull() | p.eqNullSafe(c)), lambda x: x)


def strip_env_prefix(channel: Column | str) -> Column:
    c = _c(channel)
    rest = F.when(F.instr(c, "-") > 0, F.substr(c, F.instr(c, "-") + 1))
    return F.when(F.instr(rest, "-") > 0, rest).otherwise(c)


def slugish(s: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(s), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_tokens(s: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_c(s), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def path_slug(path: Column | str) -> Column:
    p = F.regexp_replace(_c(path), r"[<{]([A-Za-z_][A-Za-z0-9_]*)(:[^>}]*)?[>}]", "$1")
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", "$1")
    p = F.lower(F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(p == "", "root").otherwise(p)


def bare_host(value: Column | str) -> Column:
    """Host of an address: scheme, user, port, path and query away, lower case."""
    given = F.trim(F.coalesce(_c(value), F.lit("")))
    place = F.when(given.rlike(r"(?i)^[a-z][\w+.\-]*://"), F.substring_index(F.substr(given, F.instr(given, "://") + 3), "/", 1)).otherwise(F.substring_index(given, "/", 1))
    return F.lower(F.trim(F.substring_index(F.substring_index(F.substring_index(place, "?", 1), "@", -1), ":", 1)))


def bare_port(value: Column | str) -> Column:
    """Two to five digits behind a colon that end the host part of an address; else empty."""
    return F.regexp_extract(F.trim(F.coalesce(_c(value), F.lit(""))), r":([0-9]{2,5})(?=[/?#]|$)", 1)


#: What an opaque token is made of, its least length, and the padding that may end it.
TOKEN_LETTERS, TOKEN_LENGTH, TOKEN_PADDING = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 2


def _without_users(text: Column) -> Column:
    """Behind each ``scheme://`` what stands before an @, unless a slash or a blank comes first."""
    def cut(piece: Column, i: Column) -> Column:
        user = F.regexp_extract(piece, r"^[^/@\s]*", 0)
        named = F.get(F.split(text, "://"), i - 1).rlike(r"[A-Za-z][A-Za-z0-9+.\-]*$")
        return F.when((i > 0) & named & (F.substr(piece, F.length(user) + 1, F.lit(1)) == "@"), F.substr(piece, F.length(user) + 2)).otherwise(piece)

    return F.when(F.contains(text, F.lit("://")) & F.contains(text, F.lit("@")), F.array_join(F.transform(F.split(text, "://"), cut), "://")).otherwise(text)


def _opaque(token: Column) -> Column:
    core = F.rtrim(token, F.lit("="))
    return (F.length(core) >= TOKEN_LENGTH) & (F.length(token) - F.length(core) <= TOKEN_PADDING) & (F.translate(core, TOKEN_LETTERS, "") == "")


def redact(value: Column | str) -> Column:
    """Without credentials; a value that is one opaque token is withheld."""
    clean = _without_users(_c(value))
    return F.when(_opaque(F.trim(clean)), "[redacted]").otherwise(clean)


def redact_tokens(text: Column | str) -> Column:
    """The whole text without credentials and opaque tokens; tokens end at blanks and quotes, which stay."""
    tokens = F.regexp_extract_all(_without_users(_c(text)), F.lit(r"[ \t\n\r\f\"'`]+|[^ \t\n\r\f\"'`]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda w: F.when(_opaque(w), "[redacted]").otherwise(w)), "")


def url_to_path(url: Column | str) -> Column:
    u = _c(url)
    full, rest = u.rlike("^https?://"), F.regexp_replace(u, "^https?://", "")
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    tail = F.regexp_extract(rest, "^[^/]*/(.*)$", 1)
    return F.struct(F.when(full, F.concat(F.lit("/"), tail)).otherwise(u).alias("path"), F.when(full & (host != ""), host).alias("host"))


def route_path(literal: Column | str) -> Column:
    """With a leading slash; a dotted name, which points at code, is no path."""
    x = _c(literal)
    steps = F.split(x, r"\.")
    dotted = (F.size(steps) > 1) & F.forall(steps, lambda s: s.rlike(r"^[A-Za-z_]\w*$"))
    return F.when(~dotted, F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)))


def join_path(prefix: Column | str, path: Column | str) -> Column:
    p = F.coalesce(_c(prefix), F.lit(""))
    return F.when(p == "", _c(path)).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), _c(path)))


def reversion(prefix: Column | str, override: Column | str) -> Column:
    """A route's own version replaces the version segment its prefix starts with."""
    p, o = _c(prefix), _c(override)
    first = F.when(p.startswith("/"), F.get(F.split(p, "/"), F.lit(1)))
    versioned = first.startswith("v") & F.substr(first, F.lit(2)).rlike(r"^[\w.]+$")
    rest = F.when(F.coalesce(versioned, F.lit(False)), F.substr(p, F.length(first) + 2)).otherwise(p)
    return F.when(F.coalesce(o, F.lit("")) == "", p).otherwise(F.concat(o, rest))


def parse_evidence(evidence: Column | str) -> Column:
    e = F.trim(_c(evidence))
    form = r"^([^:]+?)(?::(\d+)(?:-(\d+))?)?$"
    lo, hi = (F.when(F.regexp_extract(e, form, k) != "", F.regexp_extract(e, form, k).cast("int")) for k in (2, 3))
    return F.when(e.rlike(form), F.struct(F.regexp_extract(e, form, 1).alias("path"), lo.alias("lo"), F.coalesce(hi, lo).alias("hi")))


def snippet(text: Column | str, start: Column, end: Column, pad: int = 2) -> Column:
    lines = F.split(_c(text), "\n")
    low = F.greatest(start - pad, F.lit(1))
    return F.array_join(F.slice(lines, low, F.greatest(F.least(end + pad, F.size(lines)) - low + 1, F.lit(0))), "\n")


def source_span(text: Column | str, start: Column, end: Column, context: int = 0, most: int = 200) -> Column:
    """Lines of a symbol with ``context`` lines around, cut at ``most``; whether it was cut."""
    context, most = min(max(context, 0), 50), min(max(most, 1), 500)
    lines = F.split(_c(text), "\n")
    low = F.greatest(start - context, F.lit(1))
    want = F.greatest(F.least(end + context, F.size(lines)) - low + 1, F.lit(0))
    return F.struct(low.alias("line_start"), F.array_join(F.slice(lines, low, F.least(want, F.lit(most))), "\n").alias("text"), (want > most).alias("truncated"))


def dependency_name(name: Column | str) -> Column:
    n = F.lower(F.trim(_c(name)))
    return F.when(n.startswith("@"), n).otherwise(F.regexp_replace(F.regexp_replace(n, "^.*/", ""), "_", "-"))


def url_requirement(line: Column | str) -> Column:
    """Package an address stands for: what ``egg=`` says in its fragment, else its last segment without version and archive ending."""
    x = _c(line)
    egg = F.regexp_extract(x, r"[#&]egg=([\w.\-]+)", 1)
    address = F.rtrim(F.trim(F.substring_index(F.substring_index(x, "#", 1), ";", 1)), F.lit("/"))
    last = F.substring_index(F.substring_index(address, "/", -1), "@", 1)
    return F.when(egg != "", egg).otherwise(F.regexp_replace(last, r"\.(git|zip|tar\.gz|tgz|whl)$", ""))


def singular_of(name: str) -> str:
    """``singular`` for one Python string."""
    for n in range(max(map(len, SINGULAR)), 0, -1):
        if len(name) > n and name[-n:] in SINGULAR:
            return name[:-n] + SINGULAR[name[-n:]]
    return name


def singular(name: Column | str) -> Column:
    n, out = _c(name), _c(name)
    for end in sorted(SINGULAR, key=len):  # the last test is the first to hold
        cut = F.concat(F.substr(n, F.lit(1), F.length(n) - len(end)), F.lit(SINGULAR[end]))
        out = F.when(n.endswith(end) & (F.length(n) > len(end)), cut).otherwise(out)
    return out


def first_sentence(text: Column | str, limit: int = 200) -> Column:
    first = F.trim(F.element_at(F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"(?<=[.!?])\s+", 2), 1))
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.regexp_replace(F.substring(first, 1, limit), r" [^ ]*$", ""), F.lit("…")))


def whole_sentences(text: Column | str, limit: int) -> Column:
    """Cut behind the last sentence that ends inside ``limit``, unless that leaves a third or less."""
    t = F.trim(_c(text))
    window = F.substring(t, 1, limit)
    cut = F.length(F.regexp_extract(window, r"(?s)^(.*[.!?])(?:\s)", 1))
    return F.when(F.length(t) <= limit, t).when(cut > limit // 3, F.trim(F.substr(window, F.lit(1), cut))).otherwise(F.trim(window))


def embed_text(*parts: Column, limit: int = 1500) -> Column:
    kept = F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != "")
    return F.substring(F.array_join(kept, " "), 1, limit)


def content_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, length)


def file_hash(content: Column | str) -> Column:
    return F.substring(F.sha1(_c(content).cast("binary")), 1, 12)


def entity_norm(s: Column | str) -> Column:
    x = F.lower(F.trim(_c(s).cast("string")))
    x = F.regexp_replace(x, "^(service:|interface:)", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[\s_]+", "-"), r"[^a-z0-9/{}:.\-]", "")
    return F.regexp_replace(x, "^[-/]+|[-/]+$", "")


def match_keys(s: Column | str, entity: Column) -> Column:
    """A symbol also answers to its last dotted segment."""
    n = entity_norm(s)
    return F.when((entity == "symbol") & n.contains("."), F.array_distinct(F.array(n, F.element_at(F.split(n, r"\."), -1)))).otherwise(F.array(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def build_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def days_left(expires: Column, now: Column) -> Column:
    """Days begun until ``expires``, by the microsecond; none if that is past."""
    day = 86_400_000_000
    left = F.unix_micros(expires) - F.unix_micros(now)
    return F.greatest(F.call_function("div", left, F.lit(day)) + F.when(left % day > 0, 1).otherwise(0), F.lit(0)).cast("int")


def valid_alias(alias: Column | str) -> Column:
    return _c(alias).rlike(r"^[a-z0-9][a-z0-9._-]{0,62}\z")


def json_count(payload: Column | str, field: str) -> Column:
    return F.coalesce(F.get_json_object(_c(payload), f"$.{field}").cast("long"), F.lit(0))


def model_json(text: Column | str) -> Column:
    """The JSON object in a model's answer: from the first brace to the last, null if it does not parse."""
    found = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.try_parse_json(found))


def distinct_sorted(values: Column, limit: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))
    return out if limit is None else F.slice(out, 1, limit)
