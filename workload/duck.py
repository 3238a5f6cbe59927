"""Fragments of DuckDB SQL for the reference queries."""

from __future__ import annotations

from lurelake import params as P


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def lst(values) -> str:
    return f"[{quoted(values)}]"


def norm(u: str) -> str:
    return (f"CASE WHEN trim(coalesce({u},'')) = '' THEN '' WHEN regexp_matches(trim({u}), "
            f"'^https?://', 'i') THEN trim({u}) ELSE 'http://' || trim({u}) END")


def undo(u: str) -> str:
    return (f"replace(replace(replace(replace({u}, '[.]', '.'), '(.)', '.'), 'hxxps://', "
            "'https://'), 'hxxp://', 'http://')")


def refang(u: str) -> str:
    v = undo(f"trim({u})")
    return (f"CASE WHEN starts_with({v}, 'http://') OR starts_with({v}, 'https://') THEN {v} "
            f"ELSE 'http://' || {v} END")


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(split_part(regexp_replace({netloc(u)}, '^.*@', ''), ':', 1))"


def path(u: str) -> str:
    raw = (f"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)")
    return f"regexp_replace({raw}, ';[^/]*$', '')"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def address_host(v: str) -> str:
    x = f"lower(trim(coalesce({v}, '')))"
    x = undo(x)
    x = f"list_extract(string_split({x}, '@'), -1)"
    x = f"regexp_replace({x}, '^[a-z][a-z0-9+.-]*://|^//', '')"
    return f"rtrim(regexp_extract({x}, '^[^/?#:>\\s,;\"]*', 0), '.')"


def registered(h: str) -> str:
    """Registered domain of a host through a brute-force list of suffix candidates."""
    return (
        f"coalesce((SELECT max_by(CASE WHEN length(h2) > length(s) + 1 AND "
        f"list_extract(string_split(left(h2, length(h2) - length(s) - 1), '.'), -1) <> '' "
        f"THEN list_extract(string_split(left(h2, length(h2) - length(s) - 1), '.'), -1) "
        f"|| '.' || s ELSE '' END, length(s)) FROM (SELECT {h} AS h2), suffixes "
        f"WHERE h2 = s OR ends_with(h2, '.' || s)), '')"
    )


SUFFIXES = "suffixes AS (SELECT unnest(" + lst(P.PUBLIC_SUFFIXES) + ") AS s)"


def contains_count(text: str, words) -> str:
    return f"len(list_filter({lst(words)}, lambda w: contains({text}, w)))"


def count_of(text: str, ch: str) -> str:
    return f"(length({text}) - length(replace({text}, '{ch}', '')))"


def entropy(t: str) -> str:
    return (f"CASE WHEN length({t}) = 0 THEN 0.0 ELSE round(list_sum(list_transform("
            f"list_distinct(string_split({t}, '')), lambda c: -((length({t}) - length(replace("
            f"{t}, c, ''))) / length({t})) * log2((length({t}) - length(replace({t}, c, ''))) "
            f"/ length({t})))), 6) END")


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
