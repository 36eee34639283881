"""URL normalisation: every rule is a function of a column, ``normalize`` chains them by name.

Rules act on the parts of ``scheme://authority path ?query #fragment``; what has no scheme passes through those that
need one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.values import let

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(url: Column) -> list[Column]:
    """Scheme with ``://``, authority, path, query with ``?``, fragment with ``#``; all empty without a scheme."""
    return [F.regexp_extract(url, PARTS, i) for i in range(1, 6)]


def host(url: Column) -> Column:
    """Lower-cased host without user and port, empty without a scheme."""
    return F.lower(F.regexp_replace(F.regexp_replace(parts(url)[1], "^.*@", ""), ":[0-9]*$", ""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_replace(parts(url)[0], "://$", ""))


def port(url: Column) -> Column:
    """The port, by default the scheme's; null if there is none."""
    given = F.regexp_extract(parts(url)[1], ":([0-9]+)$", 1)
    return F.when(given != "", given.try_cast("int")).when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)


def _with(url: Column, **change: Callable[[Column], Column]) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    joined = lambda p: F.concat(*[change.get(n, lambda c: c)(p[i]) for i, n in enumerate(names)])
    return let(url, lambda u: F.when(u.rlike(PARTS), let(F.array(*parts(u)), joined)).otherwise(u))


def _escapes(url: Column, change: Callable[[Column], Column]) -> Column:
    def joined(u: Column) -> Column:
        found = F.regexp_extract_all(u, F.lit("%[0-9A-Fa-f]{2}"), F.lit(0))
        around = F.split(u, "%[0-9A-Fa-f]{2}", -1)
        return let(found, lambda f: F.array_join(F.transform(around, lambda g, i: F.concat(g, F.coalesce(change(F.get(f, i)), F.lit("")))), ""))

    return let(url, joined)


def _parameters(url: Column, change: Callable[[Column], Column]) -> Column:
    def query(q: Column) -> Column:
        kept = F.array_join(change(F.split(F.substring(q, 2, 1 << 30), "&", -1)), "&")
        return F.when((q == "") | (q == "?"), q).otherwise(let(kept, lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k))))

    return _with(url, query=query)


def lower_case_scheme_host(url: Column) -> Column:
    user = lambda a: F.regexp_extract(a, "^(.*@)?", 0)
    return _with(url, scheme=F.lower, authority=lambda a: F.concat(user(a), F.lower(F.regexp_replace(a, "^.*@", ""))))


def upper_case_escape_sequence(url: Column) -> Column:
    return _escapes(url, F.upper)


def decode_unreserved_characters(url: Column) -> Column:
    return _escapes(url, lambda e: F.when(F.upper(e).rlike("^%(?:4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|3[0-9]|2D|2E|5F|7E)$"), F.char(F.conv(F.substring(e, 2, 2), 16, 10).cast("int"))).otherwise(e))


def encode_non_uri_characters(url: Column) -> Column:
    one = lambda c: F.when(c.rlike(r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)), one), "")


def encode_spaces(url: Column) -> Column:
    return F.replace(url, F.lit(" "), F.lit("%20"))


def remove_default_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^(?i)(http://[^/?#:]+):80([/?#]|$)", "$1$2"), r"^(?i)(https://[^/?#:]+):443([/?#]|$)", "$1$2")


def remove_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def remove_trailing_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#[^/#]*$", "")


def remove_trailing_hash(url: Column) -> Column:
    return F.regexp_replace(url, "#$", "")


def remove_trailing_question_mark(url: Column) -> Column:
    return F.regexp_replace(url, r"\?$", "")


def remove_query_string(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)\?.*$", "")


def remove_empty_parameters(url: Column) -> Column:
    return _parameters(url, lambda ps: F.filter(ps, lambda p: (p != "") & ~p.endswith("=") & p.contains("=")))


def sort_query_parameters(url: Column) -> Column:
    return _parameters(url, F.array_sort)


def remove_session_ids(url: Column) -> Column:
    path = F.regexp_replace(url, r"(?i);jsessionid=[^?#/]*", "")
    query = F.regexp_replace(path, r"(?i)([?&])(?:phpsessid|aspsessionid[a-z0-9]*|jsessionid|sid)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(query, r"([?&])&+", "$1"), r"[?&]+(#|$)", "$1"), r"\?&", "?")


def remove_dot_segments(url: Column) -> Column:
    """RFC 3986, 5.2.4, on the path."""

    def path(p: Column) -> Column:
        segments = F.split(p, "/", -1)
        kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, s)))
        folder = p.rlike(r"(?:^|/)\.\.?$")
        return F.when(p == "", p).otherwise(let(F.array_join(kept, "/"), lambda j: F.when(folder, F.concat(F.regexp_replace(j, "/$", ""), F.lit("/"))).when(j == "", "/").otherwise(j)))

    return _with(url, path=path)


def remove_duplicate_slashes(url: Column) -> Column:
    return _with(url, path=lambda p: F.regexp_replace(p, "/{2,}", "/"))


def remove_directory_index(url: Column) -> Column:
    return _with(url, path=lambda p: F.regexp_replace(p, r"/(?:index|default)\.(?:html?|php|jsp|asp|aspx)$", "/"))


def add_directory_trailing_slash(url: Column) -> Column:
    return _with(url, path=lambda p: F.when(p.rlike(r"/[^/.]+$"), F.concat(p, F.lit("/"))).otherwise(p))


def add_domain_trailing_slash(url: Column) -> Column:
    return _with(url, path=lambda p: F.when(p == "", "/").otherwise(p))


def remove_trailing_slash(url: Column) -> Column:
    return _with(url, path=lambda p: F.regexp_replace(p, "/$", ""))


def add_www(url: Column) -> Column:
    return _with(url, authority=lambda a: F.when(a.startswith("www.") | (a == ""), a).otherwise(F.concat(F.lit("www."), a)))


def remove_www(url: Column) -> Column:
    return _with(url, authority=lambda a: F.regexp_replace(a, r"^www\.", ""))


def secure_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i)http://", "https://")


def unsecure_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i)https://", "http://")


def lower_case(url: Column) -> Column:
    return F.lower(url)


def lower_case_path(url: Column) -> Column:
    return _with(url, path=F.lower)


def lower_case_query(url: Column) -> Column:
    return _with(url, query=F.lower)


def lower_case_query_parameter_names(url: Column) -> Column:
    name = lambda p: F.regexp_extract(p, "(?s)^([^=]*)(.*)$", 1)
    return _parameters(url, lambda ps: F.transform(ps, lambda p: F.concat(F.lower(name(p)), F.regexp_extract(p, "(?s)^([^=]*)(.*)$", 2))))


def lower_case_query_parameter_values(url: Column) -> Column:
    return _parameters(url, lambda ps: F.transform(ps, lambda p: F.concat(F.regexp_extract(p, "(?s)^([^=]*)(.*)$", 1), F.lower(F.regexp_extract(p, "(?s)^([^=]*)(.*)$", 2)))))


def replacing(pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda url: F.regexp_replace(url, pattern, replacement)


RULES: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        lower_case_scheme_host, upper_case_escape_sequence, decode_unreserved_characters, encode_non_uri_characters, encode_spaces, remove_default_port, remove_fragment, remove_trailing_fragment,
        remove_trailing_hash, remove_trailing_question_mark, remove_query_string, remove_empty_parameters, sort_query_parameters, remove_session_ids, remove_dot_segments, remove_duplicate_slashes,
        remove_directory_index, add_directory_trailing_slash, add_domain_trailing_slash, remove_trailing_slash, add_www, remove_www, secure_scheme, unsecure_scheme, lower_case, lower_case_path,
        lower_case_query, lower_case_query_parameter_names, lower_case_query_parameter_values,
    )
}


def normalize(url: Column, rules: list[str | Callable[[Column], Column]]) -> Column:
    """``rules`` in their order: names of RULES or functions such as replacing() gives."""
    return reduce(lambda u, r: (RULES[r] if isinstance(r, str) else r)(u), rules, url)


def absolute(base: Column, href: Column) -> Column:
    """A link made absolute by the url of its page; dot segments are resolved. Null for empty links and other schemes than http(s)."""
    def joined(b: Column, h: Column) -> Column:
        scheme_, authority, path, query, _ = parts(b)
        root = F.concat(scheme_, authority)
        folder = F.regexp_replace(path, "[^/]*$", "")
        return (
            F.when(h.rlike("^(?i)https?://"), h)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(h.startswith("//"), F.concat(F.regexp_replace(scheme_, "//$", ""), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h.startswith("?"), F.concat(root, F.when(path == "", "/").otherwise(path), h))
            .when(h.startswith("#"), F.concat(root, path, query, h))
            .when(h != "", F.concat(root, F.when(folder == "", "/").otherwise(folder), h))
        )

    return remove_dot_segments(let(F.struct(base.alias("b"), href.alias("h")), lambda x: joined(x["b"], x["h"])))
