"""Labels, links and texts of shown results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the result page trims it.
PAGE_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
HOST = "github.com"


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, "/"), lambda p: p != "")


def _no_git(name: Column) -> Column:
    return F.regexp_replace(name, r"\.git\z", "")


def _part(parts: Column, at: Column | int) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(at) if isinstance(at, int) else at), F.lit(""))


def is_local(repository: Column) -> Column:
    hosted = (
        F.contains(repository, F.lit("://"))
        | F.contains(repository, F.lit(HOST))
        | F.contains(repository, F.lit(".git"))
    )
    return F.coalesce((repository != "") & ~hosted, F.lit(False))


def repo_label(repository: Column) -> Column:
    """Short name: owner and repository, or the last two parts."""
    bare = _no_git(F.regexp_replace(repository, "^https?://", ""))
    raw = F.split(bare, "/")
    host_at = F.array_position(raw, HOST).cast("int")
    after_host = F.contains(bare, F.lit(HOST + "/")) & (host_at > 0) & (F.size(raw) > host_at + 1)
    parts = _parts(bare)
    return (
        F.when(F.coalesce(repository, F.lit("")) == "", "")
        .when(
            after_host,
            F.concat(_part(raw, host_at + 1), F.lit("/"), _part(raw, host_at + 2)),
        )
        .when(F.size(parts) >= 2, F.concat(_part(parts, -2), F.lit("/"), _part(parts, -1)))
        .otherwise(bare)
    )


def _owner_repo(repository: Column) -> Column:
    """Owner and repository of a link, null if it names none."""
    cleaned = F.trim(repository, F.lit(PAGE_SPACE))
    hosted = cleaned.rlike("^https?://") | F.contains(cleaned, F.lit(HOST))
    parts = _parts(F.regexp_replace(cleaned, "^https?://", ""))
    owner_at = F.array_position(parts, HOST).cast("int") + 1
    owner = _part(parts, owner_at)
    name = _no_git(_part(parts, owner_at + 1))
    plain = _parts(repository)
    joined = F.when((owner != "") & (name != ""), F.concat(owner, F.lit("/"), name))
    return (
        F.when(hosted, joined)
        .when(
            F.size(plain) >= 2,
            F.concat(_part(plain, 1), F.lit("/"), _no_git(_part(plain, 2))),
        )
        .otherwise(_no_git(repository))
    )


def source_url(
    path: Column,
    line_start: Column,
    line_end: Column,
    repository: Column,
    ref: Column,
    link_base: str | None = None,
) -> Column:
    """Link to the lines of a hosted file; null if the repository names no host path.

    ``link_base`` replaces host, repository and branch for another hosting site.
    """
    trimmed = F.trim(path, F.lit(PAGE_SPACE))
    from_url = F.regexp_extract(trimmed, r"(?is)https?://.*\z", 0)
    rewritten = F.when(from_url != "", from_url).otherwise(
        F.regexp_replace(trimmed, r"^git@github\.com:", f"https://{HOST}/")
    )
    # Only the first .git goes, hence the split at most once.
    pieces = F.split(rewritten, r"\.git(?=/|\z)", 2)
    target = F.array_join(pieces, "")
    lines = F.when(
        F.coalesce(line_start, F.lit(0)) > 0,
        F.concat(
            F.lit("#L"), line_start.cast("string"),
            F.when(
                F.coalesce(line_end, F.lit(0)) != 0,
                F.concat(F.lit("-L"), line_end.cast("string")),
            ).otherwise(""),
        ),
    ).otherwise("")
    branch = F.coalesce(F.nullif(ref, F.lit("")), F.lit("main"))
    if link_base:
        has_scheme = link_base.startswith(("http://", "https://"))
        base = F.lit(link_base if has_scheme else f"https://{link_base}")
    else:
        owner_repo = _owner_repo(F.nullif(repository, F.lit("")))
        base = F.concat(F.lit(f"https://{HOST}/"), owner_repo, F.lit("/blob/"), branch)
    return F.when(target.rlike("^https?://"), F.concat(target, lines)).otherwise(
        F.concat(
            F.regexp_replace(base, r"/+\z", ""), F.lit("/"),
            F.regexp_replace(target, "^/+", ""), lines,
        )
    )


def display_text(summary: Column, preview: Column) -> Column:
    told = F.coalesce(F.trim(summary, F.lit(PAGE_SPACE)), F.lit("")) != ""
    return F.when(told, summary).otherwise(preview)
