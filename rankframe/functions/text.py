"""Column expressions for text cleaning, parsing and tokenising (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe import schemas as S

# The whitespace set of Python's str.strip()/str.split() (str.isspace), as a Java regex class.
PY_SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
ASCII_TOKEN = "[a-z0-9]+"
WORD_TOKEN = "[\\p{L}\\p{N}_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of the full Unicode set."""
    c = _c(c)
    return F.regexp_replace(F.regexp_replace(c, f"^{PY_SPACE}+", ""), f"{PY_SPACE}+\\z", "")


def clean_text(c) -> Column:
    """Stripped text; NULL stays NULL."""
    return strip(c)


@functools.lru_cache(maxsize=1)
def decimal_digit_table() -> tuple[str, str]:
    """Every non-ASCII Unicode decimal digit (category Nd) and its ASCII digit, built by rule from
    the Unicode database; used to read digit runs the way Python's ``int`` does."""
    src, dst = [], []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if cp > 127 and unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.digit(ch)))
    return "".join(src), "".join(dst)


def parse_duration(c) -> Column:
    """The first run of decimal digits (any script, as Python's ``\\d``) as INT; none -> NULL."""
    src, dst = decimal_digit_table()
    run = F.nullif(F.regexp_extract(_c(c), "(\\p{Nd}+)", 1), F.lit(""))
    return F.translate(run, src, dst).try_cast("int")


def code_map() -> Column:
    return F.create_map(*[x for kv in S.TEST_TYPE_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def map_test_types(arr) -> Column:
    """P3/P4 on an ARRAY<STRING> of codes: known codes mapped to names, unknown codes kept; NULL -> []."""
    m = code_map()
    return F.transform(F.coalesce(_c(arr), F.array().cast("array<string>")),
                       lambda x: F.coalesce(F.try_element_at(m, x), x))


def parse_test_types(c) -> Column:
    """P3/P7 on the stored text form ``['K', 'P']``: parse, then map; junk or NULL -> []."""
    parsed = F.from_json(_c(c), "array<string>", {"allowSingleQuotes": "true"})
    return map_test_types(parsed)


def parse_list_field(c) -> Column:
    """P5: split on comma, strip each part, drop empty parts; NULL -> []."""
    parts = F.transform(F.split(_c(c), ","), lambda x: strip(x))
    return F.coalesce(F.filter(parts, lambda x: x != F.lit("")), F.array().cast("array<string>"))


def yes_no_to_bool(c) -> Column:
    """Case-blind 'yes' -> true, other text -> false, NULL -> NULL."""
    return F.lower(_c(c)) == F.lit("yes")


def bool_to_yes_no(c) -> Column:
    """True -> 'Yes', false or NULL -> 'No'."""
    return F.when(_c(c), F.lit("Yes")).otherwise(F.lit("No"))


def nan_safe_int(c) -> Column:
    """A float that may be NaN (pandas' missing value) -> INT, NaN or NULL -> NULL."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c).try_cast("int")


def url_slug(c) -> Column:
    """The part after the last 'view/', trailing slashes removed, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(_c(c), "view/", -1), "/+\\z", ""))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; one that ends in them ends in a slash."""
    segments = F.split(path, "/")
    walked = F.aggregate(segments, F.lit(""), lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*\\z", ""))
                         .when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s)))
    # the text before the first slash is a segment of its own: drop the slash put before it
    walked = F.when(path.startswith("/"), F.regexp_replace(walked, "^//", "/")).otherwise(walked)
    return F.concat(walked, F.when(F.element_at(segments, -1).isin(".", "..") & ~walked.endswith("/"), F.lit("/")).otherwise(F.lit("")))


def resolve_url(href, base) -> Column:
    """A link resolved against a base URL (text or column) as a browser does.

    With a scheme: as is; NULL or '': the base; ``//host``: the base's scheme; ``#x`` and ``?x``: the
    base up to its own; a path, from the root or from the base's folder, has its dots resolved.
    """
    h, b = F.coalesce(_c(href), F.lit("")), F.lit(base) if isinstance(base, str) else base
    scheme = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)
    origin = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(b, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(h, "^([^?#]*)", 1), F.regexp_extract(h, "^[^?#]*(.*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*\\z", ""))
    # empty segments inside a joined path go, those of a path from the root stay
    joined = F.concat(F.regexp_replace(folder, "/+", "/"), F.regexp_replace(own, "/+", "/"))
    return (F.when(h == "", b)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, "^([^#]*)", 1), h))
            .when(h.startswith("?"), F.concat(origin, path, h))
            .when(h.startswith("/"), F.concat(origin, _without_dots(own), rest))
            .otherwise(F.concat(origin, _without_dots(joined), rest)))


def tokenize_ascii(c) -> Column:
    """Lower-case, every char outside [a-z0-9] and whitespace becomes a separator, split.

    That is exactly the maximal runs of [a-z0-9] in the lower-cased text.  NULL -> [].
    """
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(ASCII_TOKEN), 0)


def tokenize_words(c) -> Column:
    """Lower-case, maximal runs of Unicode word characters (letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(WORD_TOKEN), 0)


def _part(c) -> Column:
    return F.nullif(c, F.lit(""))


def embedding_text(name, description, test_types, job_levels) -> Column:
    """P10: name, description, types, levels joined by one space; empty or missing parts dropped."""
    return F.concat_ws(" ", _part(_c(name)), _part(_c(description)),
                       _part(F.array_join(F.coalesce(_c(test_types), F.array().cast("array<string>")), " ")),
                       _part(F.array_join(F.coalesce(_c(job_levels), F.array().cast("array<string>")), " ")))


def bm25_text(fields: str, name="assessment_name", description="description", test_types="test_types",
              skills=None, duration="duration_minutes") -> Column:
    """The text indexed for BM25, three field sets.

    ``full``: name, description, types, skills, "<n> minutes" (phrase omitted when NULL);
    ``name_desc``: name and description; ``name_desc_types``: name, description, types.
    Only tokens matter downstream, so separators are single spaces and empty parts are dropped.
    """
    parts = [_part(_c(name)), _part(_c(description))]
    if fields in ("full", "name_desc_types"):
        parts.append(_part(F.array_join(F.coalesce(_c(test_types), F.array().cast("array<string>")), " ")))
    if fields == "full":
        if skills is not None:
            parts.append(_part(F.array_join(F.coalesce(_c(skills), F.array().cast("array<string>")), " ")))
        parts.append(F.when(_c(duration).isNotNull(),
                            F.concat(_c(duration).cast("string"), F.lit(" minutes"))))
    elif fields not in ("name_desc", "name_desc_types"):
        raise ValueError(f"unknown field set {fields!r}")
    return F.concat_ws(" ", *parts)
