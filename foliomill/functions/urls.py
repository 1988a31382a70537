"""URL columns: parts, resolving links, skip rules, output slugs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions.text import quoted

URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def netloc(url: Column) -> Column:
    """Host with port and user-info, as written."""
    return F.regexp_extract(url, URL_PATTERN, 2)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL_PATTERN, 3), r";[^/]*\z", "")


def is_web_url(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def has_skipped_extension(url: Column) -> Column:
    endings = "|".join(e.removeprefix(".") for e in fv.SKIP_EXTENSIONS)
    return F.lower(path(url)).rlike(rf"\.(?:{endings})\z")


def has_ignored_pattern(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(f"(?:{p})" for p in fv.IGNORE_URL_PATTERNS))


def is_skippable(url: Column) -> Column:
    return has_skipped_extension(url) | has_ignored_pattern(url)


def contains_any(url: Column, needles: Sequence[str]) -> Column:
    """Plain, case-sensitive substring test against run options (a handful of literals)."""
    return reduce(lambda a, b: a | b, [F.contains(url, F.lit(n)) for n in needles], F.lit(False))


def same_domain(url: Column, base: Column) -> Column:
    return netloc(url) == netloc(base)


def site_slug(url: Column) -> Column:
    """Output name of a site: host and path, everything unusual as single underscores."""
    name = F.concat(netloc(url), F.translate(path(url), "/", "_"))
    name = F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    name = F.regexp_replace(name, "_+", "_")
    return F.when(name == "", F.lit(fv.DEFAULT_SLUG)).otherwise(name)


def resolve(rows: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add ``out``: the absolute form of link ``href`` on page ``base``, without fragment.

    Computed in named steps, so that each piece is evaluated once.  Map-only.
    """
    pattern = quoted(URL_PATTERN)
    steps = rows.selectExpr(
        "*",
        f"substring_index(regexp_replace(btrim({href}, {quoted(fv.WHITE_SPACE)}), '[\\t\\r\\n]', ''), '#', 1) as _ref",
        f"lower(regexp_extract({base}, {pattern}, 1)) as _scheme",
        f"regexp_extract({base}, {pattern}, 2) as _netloc",
        f"regexp_extract({base}, {pattern}, 3) as _base_path",
    )
    steps = steps.selectExpr(
        "*",
        "lower(regexp_extract(_ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as _own",
        "concat(_scheme, '://', _netloc) as _root",
        "coalesce(nullif(regexp_extract(_base_path, '^.*/', 0), ''), '/') as _folder",
    )
    steps = steps.selectExpr("*", "if(_own = '', _ref, substring(_ref, length(_own) + 2)) as _rest")
    steps = steps.selectExpr("*", "substring_index(_rest, '?', 1) as _rest_path")
    steps = steps.selectExpr("*", "if(startswith(_rest_path, '/'), _rest_path, concat(_folder, _rest_path)) as _path")
    # "." and empty middle segments go, ".." takes its predecessor along.
    folded = """aggregate(split(_path, '/'), '', (path, name) -> case
        when name = '..' then regexp_replace(path, '/[^/]*$', '') when name in ('.', '') then path else concat(path, '/', name) end)"""
    return steps.selectExpr(
        *rows.columns,
        f"""case
          when _own not in ('', _scheme) then _ref
          when startswith(_rest, '//') then concat(_scheme, ':', _rest)
          when _rest = '' then substring_index({base}, '#', 1)
          when startswith(_rest, '?') then concat(_root, _base_path, _rest)
          else concat(
            _root,
            if(_path rlike '//|/[.][.]?(?:/|$)', concat({folded}, if(_path rlike '/[.]{{0,2}}$', '/', '')), _path),
            substring(_rest, length(_rest_path) + 1))
          end as {out}""",
    )
