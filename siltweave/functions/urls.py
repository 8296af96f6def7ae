"""Titles, URLs and paths as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url) -> Column:
    """The host of an http(s) URL, '' if there is none."""
    return F.regexp_extract(_c(url), r"^https?://([^/?#]+)", 1)


def path(url) -> Column:
    """The path of an http(s) URL without query and fragment."""
    return F.regexp_extract(_c(url), r"^https?://[^/?#]+([^?#]*)", 1)


def title_directory(title, ns, special: dict[int, str] | None = None) -> Column:
    """The directory a title is filed under: category pages (namespace 14) get one of their own, ``special`` namespaces a fixed one."""
    bare = F.translate(F.regexp_replace(_c(title), "^Category:", ""), " :/", "___")
    out = F.when(_c(ns) == 14, bare)
    for space, directory in (special or {}).items():
        out = out.when(_c(ns) == space, F.lit(directory))
    return out.otherwise(F.lit(""))


def title_file(title, ns, special: dict[int, str] | None = None) -> Column:
    """The file name of a title; a special namespace's prefix is dropped."""
    slug = F.translate(_c(title), " :/", "___")
    out = F.when(_c(ns) == 14, F.lit("index.md"))
    for space, directory in (special or {}).items():
        out = out.when(_c(ns) == space, F.concat(F.regexp_replace(slug, f"^{directory}_", ""), F.lit(".md")))
    return out.otherwise(F.concat(slug, F.lit(".md")))


def cache_key(title) -> Column:
    """A title as a cache key: blanks to underscores, runs collapsed, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.translate(_c(title), " ", "_"), "_+", "_"), "^_|_$", "")


def cache_slug(url) -> Column:
    """The path of a URL with everything but letters, digits, '/', '-' folded to single underscores."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(url), "^/+", ""), "[^A-Za-z0-9/_-]+", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.when(s == "", F.lit("index")).otherwise(s)


def markdown_path(url) -> Column:
    """The Markdown file a URL is written to."""
    p = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), r"\.html?$", "")
    p = F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9/_-]+", "-"), "-+", "-")
    p = F.regexp_replace(p, "^-|-$", "")
    return F.concat(F.when(p == "", F.lit("index")).otherwise(p), F.lit(".md"))


def flat_path(url) -> Column:
    """The path of a URL in one segment."""
    p = F.translate(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "_")
    return F.when(p == "", F.lit("index")).otherwise(p)


def slugify(text, length: int = 80, default: str = "target") -> Column:
    """Lower case, scheme dropped, other signs to single hyphens, at most ``length`` characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "^https?://", ""), "[^a-z0-9]+", "-")
    s = F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(length))
    return F.when(s == "", F.lit(default)).otherwise(s)


def normalize_href(href, domain) -> Column:
    """An href as an absolute URL where it can be one.

    Empty and script hrefs are null, protocol-relative ones get https, fragments stay, and without a
    domain absolute paths stay too.
    """
    h, d = F.trim(_c(href)), _c(domain)
    base = F.concat(F.lit("https://"), d)
    return (
        F.when(h.isNull() | (h == "") | F.lower(h).startswith("javascript:"), F.lit(None).cast("string"))
        .when(h.startswith("#"), h)
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(d.isNull() | (d == ""), h)
        .when(h.startswith("about:/"), F.concat(base, F.substr(h, F.lit(7))))
        .when(h.startswith("/"), F.concat(base, h))
        .otherwise(h)
    )


def relative_path(source_dir, target_dir, file) -> Column:
    """The path from a directory to a file in another one, by their longest common prefix."""
    s = F.filter(F.split(F.coalesce(_c(source_dir), F.lit("")), "/"), lambda x: x != "")
    t = F.filter(F.split(F.coalesce(_c(target_dir), F.lit("")), "/"), lambda x: x != "")
    same = F.aggregate(F.zip_with(s, t, lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + (acc["on"] & x).cast("int")).alias("n"), (acc["on"] & x).alias("on")))["n"]
    ups = F.repeat(F.lit("../"), F.size(s) - same)
    down = F.array_join(F.slice(t, same + 1, F.size(t)), "/")
    return F.concat(ups, F.when(down == "", F.lit("")).otherwise(F.concat(down, F.lit("/"))), _c(file))


def joined(directory, file) -> Column:
    """A file's path below a directory; '' is the top."""
    d = _c(directory)
    return F.concat(F.when(d == "", F.lit("")).otherwise(F.concat(d, F.lit("/"))), _c(file))


def normalized(path) -> Column:
    """A path without '.' and, as far as they can be followed, '..' steps."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done, x):
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, x))

    return F.array_join(F.aggregate(parts, none, step), "/")


def encode_parens(url) -> Column:
    return F.replace(F.replace(_c(url), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def percent_decode(text) -> Column:
    """Percent decoding that leaves '+' alone; null where the escapes are broken."""
    return F.try_url_decode(F.replace(_c(text), F.lit("+"), F.lit("%2B")))


def set_query(url, name: str, value) -> Column:
    """A URL with its query parameter set, whether or not it had it."""
    u, v = _c(url), _c(value).cast("string")
    bare = F.regexp_extract(u, "^([^#]*)", 1)
    given = F.concat(F.lit(rf"([?&]{name}=)[^&#]*"))
    replaced = F.regexp_replace(bare, given, F.concat(F.lit("$1"), v))
    joined = F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{name}="), v)
    return F.when(bare.rlike(rf"[?&]{name}="), replaced).otherwise(joined)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** crosses '/', * does not."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        else:
            out, k = out + ("\\" + pattern[k] if pattern[k] in r".^$+?()[]{}|\\" else pattern[k]), k + 1
    return f"^{out}$"


def parameter_regex(pattern: str) -> str:
    """A path with :parameters as an anchored regular expression."""
    import re

    return "^" + re.sub(r"\\?:[A-Za-z_]\w*", "[^/?#]+", re.escape(pattern).replace("/", "/")) + "$"
