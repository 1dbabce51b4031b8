"""S1/S2 scan rules, P4 type inference and P5 slug derivation."""

from pyspark.sql import functions as F

from support import files_df
from quire.functions import paths


def slugs(spark, roots, file_paths):
    df = files_df(spark, [(p, "") for p in file_paths])
    out = df.select("file_path", paths.derive_slug(F.col("file_path"), roots).alias("slug")).collect()
    return {r.file_path: r.slug for r in out}


def test_slug_quirks(spark):
    got = slugs(spark, ["/kb/skills", "/kb/notes", "/kb/rules.md"], [
        "/kb/skills/s1/SKILL.md",
        "/kb/skills/SKILL.md",
        "/kb/skills-old/x.md",
        "/kb/notes/n1.md",
        "/kb/notes/a/b.MD",
        "/kb/rules.md",
        "/elsewhere/free.md",
    ])
    assert got["/kb/skills/s1/SKILL.md"] == "s1"
    assert got["/kb/skills/SKILL.md"] == "kb/skills/SKILL"  # strip runs before the prefix
    assert got["/kb/skills-old/x.md"] == "../skills-old/x"  # no separator boundary
    assert got["/kb/notes/n1.md"] == "notes/n1"
    assert got["/kb/notes/a/b.MD"] == "a/b"
    assert got["/kb/rules.md"] == "rules"
    assert got["/elsewhere/free.md"] == "free"


def test_scan_rules(spark):
    roots = ["/kb", "/x/README.md"]
    candidates = [
        "/kb/a.md", "/kb/.hidden/b.md", "/kb/node_modules/c.md", "/kb/d/README.md", "/kb/d/License.md",
        "/kb/e.MD", "/kb/_f.md", "/kb/.g.md", "/x/README.md", "/y/z.md", "/kb/deep/er/h.md",
    ]
    df = files_df(spark, [(p, "") for p in candidates])
    kept = {r.file_path for r in df.where(paths.scan_keeps(F.col("file_path"), roots)).collect()}
    assert kept == {"/kb/a.md", "/kb/_f.md", "/kb/.g.md", "/x/README.md", "/kb/deep/er/h.md"}


def test_type_rules(spark):
    roots = ["/kb", "/kb/house.md", "/kb/skills/extra.md"]
    rows = [
        ("/kb/skills/s/references/r.md", "reference"),
        ("/kb/example/e.md", "reference"),
        ("/kb/x/Skill.md", "skill"),
        ("/kb/skills/s/notes.md", "skill"),
        ("/kb/house.md", "instruction"),
        ("/kb/my-agents/a.md", "agent"),
        ("/kb/prompts/p.md", "prompt"),
        ("/kb/workflows/w.md", "workflow"),
        ("/kb/other/o.md", "reference"),
    ]
    df = files_df(spark, [(p, "") for p, _ in rows])
    out = df.select("file_path", paths.infer_type(F.col("file_path"), F.lit(None).cast("string"), roots).alias("t"))
    got = {r.file_path: r.t for r in out.collect()}
    assert got == dict(rows)


def test_read_markdown_tree(spark, tmp_path):
    from quire.sources.markdown import read_markdown

    root = tmp_path / "kb"
    (root / "skills" / "s1").mkdir(parents=True)
    (root / "skills" / "s1" / "SKILL.md").write_text("---\ntitle: S\n---\nbody")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.md").write_text("x")
    (root / "README.md").write_text("r")
    (root / "a b.md").write_text("space")
    (root / "n.txt").write_text("no")
    got = {r.file_path: r.content for r in read_markdown(spark, [str(root), str(tmp_path / "missing")]).collect()}
    assert got == {str(root / "skills" / "s1" / "SKILL.md"): "---\ntitle: S\n---\nbody", str(root / "a b.md"): "space"}


def test_index_a_real_tree_then_edit_it(spark, tmp_path):
    from quire.plans import index_run
    from quire.sources import snapshot
    from quire.sources.markdown import read_markdown

    root = tmp_path / "kb"
    (root / "skills" / "s1").mkdir(parents=True)
    (root / "skills" / "s1" / "SKILL.md").write_text("---\ntitle: S1\ndependencies: [s2]\n---\none")
    (root / "agents").mkdir()
    (root / "agents" / "helper.md").write_text("---\nstatus: draft\n---\nhelps")
    roots = [str(root / "skills"), str(root / "agents")]
    base = index_run.scratch_base(spark, "t-tree")
    _, s1 = index_run.run_index(read_markdown(spark, roots), roots, base, now=1)
    assert s1.first().added == 2
    (root / "agents" / "helper.md").write_text("---\nstatus: stable\n---\nhelps more")
    (root / "skills" / "s1" / "SKILL.md").unlink()
    (root / "agents" / "new.md").write_text("new")
    path, s2 = index_run.run_index(read_markdown(spark, roots), roots, base, now=2)
    r = s2.first()
    assert (r.added, r.updated, r.removed, r.total) == (1, 1, 1, 2)
    rows = {x.slug: x for x in snapshot.read_version(spark, path).collect()}
    assert set(rows) == {"agents/helper", "agents/new"}
    assert rows["agents/helper"].status == "stable" and rows["agents/helper"].created_at == 1
    assert rows["agents/helper"].updated_at == 2 and rows["agents/helper"].type == "agent"


def test_walk_keeps_hidden_files_and_underscore_names(spark, tmp_path):
    from quire.plans import index_run
    from quire.sources.markdown import read_markdown

    root = tmp_path / "kb"
    for name in ("a.md", "_b.md", ".c.md", "_drafts/d.md", "sub/deep/e.md", ".git/x.md", "node_modules/y.md",
                 "sub/node_modules/z.md", "sub/CHANGELOG.md", "100%25.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    roots = [str(root)]
    found = {r.file_path.removeprefix(f"{root}/"): r.content for r in read_markdown(spark, roots).collect()}
    want = ["a.md", "_b.md", ".c.md", "_drafts/d.md", "sub/deep/e.md", "100%25.md"]
    assert found == {n: n for n in want}
    base, slugs = index_run.scratch_base(spark, "t-hidden"), index_run.scratch_base(spark, "t-slugs")
    index_run.run_index(read_markdown(spark, roots), roots, base, now=1, slugs_path=slugs)
    _, again = index_run.run_index(read_markdown(spark, roots), roots, base, now=2, slugs_path=slugs)
    assert (again.first().removed, again.first().total) == (0, 6)
    assert sorted(r.action for r in spark.read.parquet(slugs).collect()) == ["added"] * 6


def test_a_store_is_walked_by_tasks_and_keeps_every_name(spark, tmp_path):
    from quire.sources.markdown import read_markdown, read_store

    root = tmp_path / "kb with space"
    names = ["a.md", "_b.md", ".c.md", "_drafts/d.md", "sub/deep/100% é.md", ".git/x.md", "node_modules/y.md", "sub/README.md", "z.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    (root / "bin.md").write_bytes(b"ok \xff")
    uri = f"file://{root}"
    got = {r.file_path.removeprefix(uri + "/"): r.content for r in read_store(spark, [uri + "/", f"{uri}/sub/deep/100% é.md"]).collect()}
    want = {n: f"text of {n}" for n in names[:5]} | {"bin.md": "ok \ufffd"}
    assert got == want
    mounted = {r.file_path.removeprefix(f"{root}/"): r.content for r in read_markdown(spark, [str(root)]).collect()}
    assert mounted == want
