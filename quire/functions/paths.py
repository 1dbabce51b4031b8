"""Path rules: which files a root scan keeps (S1/S2), slug (P5) and type.

Roots are configuration (a short list), so each rule is a CASE expression
generated from the list; the per-file work stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import SKIP_DIR_NAMES, SKIP_FILE_NAMES


def _strip_trailing_slashes(root: str) -> str:
    return re.sub(r"/+$", "", root) or root


def is_file_root(root: str) -> bool:
    return root.endswith(".md")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def walk_regex(dir_roots: list[str]) -> str:
    """One Java regex that accepts a path found by walking any directory root.

    Below the root, no directory may start with '.' or be a skipped name; the
    file must end in lowercase '.md' and not be a skipped name (any case).
    """
    bases = [_strip_trailing_slashes(r) for r in dir_roots]
    alts = "|".join(_java_quote(b if b != "/" else "") for b in bases)
    skip_dirs = "|".join(re.escape(d) for d in SKIP_DIR_NAMES)
    skip_files = "|".join(re.escape(f[:-3]) for f in SKIP_FILE_NAMES)
    return (
        rf"^(?:{alts})/(?!(?:[^/]*/)*(?:\.[^/]*|{skip_dirs})/)(?:[^/]*/)*"
        rf"(?!(?i:{skip_files})\.md$)[^/]*\.md$"
    )


def scan_keeps(path: Column, roots: list[str]) -> Column:
    """S1+S2: the file is found by walking the roots in order.

    A root that is itself an '.md' file is taken as is, without the skip-list
    test; a directory root keeps what the walk keeps below it.
    """
    file_roots = [r for r in roots if is_file_root(r)]
    dir_roots = list(roots)
    cond = path.rlike(walk_regex(dir_roots)) if dir_roots else F.lit(False)
    if file_roots:
        cond = path.isin(file_roots) | cond
    return cond


def _slug_prefix(root: str) -> str:
    normed = re.sub(r"/+$", "", root)
    segments = [s for s in normed.split("/") if s]
    prefix = re.sub(r"\.md$", "", segments[-1], flags=re.I) if segments else ""
    if prefix == "skills" and len(segments) > 1:
        prefix = segments[-2] + "/" + prefix
    return prefix


def _root_index(path: Column, roots: list[str]) -> Column:
    """1-based index of the first root the path starts with, else null."""
    expr = F.when(path.startswith(roots[0]), F.lit(1))
    for i, root in enumerate(roots[1:], start=2):
        expr = expr.when(path.startswith(root), F.lit(i))
    return expr


def derive_slug(path: Column, roots: list[str]) -> Column:
    """P5: slug from the first root the path starts with (no separator test).

    The root's constants are looked up by index, so the generated code does
    not grow with the number of roots.
    """
    fallback = F.regexp_replace(base_name(path), r"(?i)\.md$", "")
    if not roots:
        return fallback
    bases = [_strip_trailing_slashes(r) for r in roots]
    lasts = [([s for s in b.split("/") if s] or [""])[-1] for b in bases]
    idx = _root_index(path, roots)
    # Look up with a non-null index: generated code may evaluate the lookup
    # for rows without a root (idx null -> slot value 0, an ANSI error).
    # Those rows take the fallback below anyway.
    safe_idx = F.coalesce(idx, F.lit(1))

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), safe_idx)

    base = pick(bases)
    inside = pick([b + "/" if b != "/" else "/" for b in bases])
    outside_from = pick([len(b) - len(last) + 1 for b, last in zip(bases, lasts)])
    prefix = pick([_slug_prefix(r) for r in roots])
    big = F.lit(1 << 30)
    # Node's path.relative(root, path) for a path that starts with root.
    rel0 = (
        F.when(path.startswith(inside), F.substring(path, F.length(inside) + 1, big))
        .when(path == base, F.lit(""))
        .otherwise(F.concat(F.lit("../"), F.substring(path, outside_from, big)))
    )
    rel = F.when(rel0 == "", base_name(path)).otherwise(rel0)
    has_dir = rel.contains("/")
    stripped = F.regexp_replace(F.regexp_replace(rel, r"(?i)\.md$", ""), r"(?i)/SKILL$", "")
    prefixed = F.when(
        ~has_dir & (prefix != "") & (stripped != prefix), F.concat(prefix, F.lit("/"), stripped)
    ).otherwise(stripped)
    return F.when(idx.isNull() | (prefixed == ""), fallback).otherwise(prefixed)


def instruction_roots(roots: list[str]) -> list[str]:
    """Explicit '.md' roots outside skill folders are instructions."""
    return [r for r in roots if r.endswith(".md") and "/skills/" not in r and "/editorial-skills/" not in r]


def infer_type(path: Column, fm_type: Column, roots: list[str]) -> Column:
    """Front-matter type lowercased, else the first path rule that hits."""
    low = F.lower(path)
    explicit = instruction_roots(roots)
    return (
        F.when(fm_type.isNotNull(), F.lower(fm_type))
        .when(low.contains("/references/"), "reference")
        .when(low.contains("/example/"), "reference")
        .when(low.endswith("skill.md"), "skill")
        .when(low.contains("/skills/"), "skill")
        .when(path.isin(explicit) if explicit else F.lit(False), "instruction")
        .when(low.contains("instruction"), "instruction")
        .when(low.contains("agent"), "agent")
        .when(low.contains("prompt"), "prompt")
        .when(low.contains("workflow"), "workflow")
        .otherwise("reference")
    )


def found_under(path: Column, roots: list[str]) -> Column:
    """The first root whose walk finds the path (S2 attribution)."""
    expr = None
    for root in roots:
        hit = (path == F.lit(root)) if is_file_root(root) else path.rlike(walk_regex([root]))
        expr = F.when(hit, F.lit(root)) if expr is None else expr.when(hit, F.lit(root))
    return expr
