"""P5 against a plain-Python statement of the slug rule on random paths."""

import posixpath
import random
import re

from pyspark.sql import functions as F

from quire.functions import paths

SEGMENTS = ["a", "b", "skills", "notes", "x.md", "SKILL.md", "Skill.MD", "c.md", "skills-old", "kb"]


def _strip_md(s):
    return re.sub(r"\.md$", "", s, flags=re.I)


def python_slug(fp, roots):
    for r in roots:
        if fp.startswith(r):
            rel = "" if fp.rstrip("/") == r.rstrip("/") else posixpath.relpath(fp, r)
            if not rel or rel == ".":
                rel = fp.split("/")[-1]
            has_dir = "/" in rel
            rel = re.sub(r"/SKILL$", "", _strip_md(rel), flags=re.I)
            if not has_dir:
                segs = [x for x in re.sub(r"/+$", "", r).split("/") if x]
                prefix = _strip_md(segs[-1] if segs else "")
                if prefix == "skills" and len(segs) > 1:
                    prefix = segs[-2] + "/" + prefix
                if prefix and rel != prefix:
                    rel = prefix + "/" + rel
            return rel or _strip_md(fp.split("/")[-1])
    return _strip_md(fp.split("/")[-1])


def _path(rng, depth):
    return "/" + "/".join(rng.choice(SEGMENTS) for _ in range(depth))


def test_slug_matches_python_rule(spark):
    rng = random.Random(7)
    for _ in range(5):
        roots = [_path(rng, rng.randint(1, 3)) + rng.choice(["", "", "/"]) for _ in range(rng.randint(1, 3))]
        files = sorted({_path(rng, rng.randint(1, 5)) for _ in range(200)}
                       | {r.rstrip("/") + "/" + _path(rng, rng.randint(1, 3)).lstrip("/") for r in roots})
        df = spark.createDataFrame([(f,) for f in files], "file_path string")
        got = {r.file_path: r.slug for r in
               df.select("file_path", paths.derive_slug(F.col("file_path"), roots).alias("slug")).collect()}
        want = {f: python_slug(f, roots) for f in files}
        bad = {f: (got[f], want[f]) for f in files if got[f] != want[f]}
        assert not bad, (roots, list(bad.items())[:5])
