"""P1-P3 edge cases: the split regex, the YAML dialect and tag normalisation."""

import json

from support import files_df
from quire.functions.frontmatter import parse_yaml_block
from quire.operators.parse import parse_files

ROOTS = ["/kb"]


def parse_rows(spark, rows):
    df = parse_files(files_df(spark, rows), ROOTS, now=0, with_embedding=False)
    return {r.file_path: r for r in df.collect()}


def test_yaml_keeps_dates_and_yes_no_as_strings():
    ok, fm, *_ = parse_yaml_block("timestamp: 2024-01-01\nflag: yes\non: off\nn: 3\nx: 1.5\nz: null\nb: true")
    assert ok
    assert json.loads(fm) == {"timestamp": "2024-01-01", "flag": "yes", "on": "off", "n": 3, "x": 1.5,
                              "z": None, "b": True}


def test_duplicate_keys_and_invalid_yaml_are_rejected():
    assert parse_yaml_block("a: 1\na: 2")[0] is False
    assert parse_yaml_block("a: [1, 2")[0] is False


def test_scalar_and_empty_front_matter():
    ok, fm, title, *_ = parse_yaml_block("just a string")
    assert ok and json.loads(fm) == "just a string" and title is None
    ok, fm, *_ = parse_yaml_block("")
    assert ok and fm == "{}"


def test_split_edge_cases(spark):
    rows = [
        ("/kb/lf.md", "---\ntitle: A\n---\nbody"),
        ("/kb/crlf.md", "---\r\ntitle: A\r\n---\r\nbody"),
        ("/kb/bad.md", "---\ntitle: [x\n---\nbody"),
        ("/kb/dup.md", "---\na: 1\na: 2\n---\nbody"),
        ("/kb/empty.md", "---\n---\nbody"),
        ("/kb/foo.md", "---\ntitle: F\n---foo\nrest"),
        ("/kb/blank.md", "---\n\n---\nbody"),
    ]
    got = parse_rows(spark, rows)
    assert got["/kb/lf.md"].title == "A" and got["/kb/lf.md"].body == "body"
    # CRLF never matches: whole content is the body.
    assert got["/kb/crlf.md"].body == rows[1][1] and got["/kb/crlf.md"].frontmatter == "{}"
    assert got["/kb/bad.md"].body == rows[2][1] and got["/kb/bad.md"].frontmatter == "{}"
    assert got["/kb/dup.md"].body == rows[3][1]
    # '---\n---' has no newline before the closing fence: no match.
    assert got["/kb/empty.md"].body == rows[4][1]
    # The closing fence need not end its line.
    assert got["/kb/foo.md"].title == "F" and got["/kb/foo.md"].body == "foo\nrest"
    assert got["/kb/blank.md"].body == "body" and got["/kb/blank.md"].frontmatter == "{}"


def test_tags_forms(spark):
    rows = [
        ("/kb/a.md", "---\ntags: [x, y]\n---\n"),
        ("/kb/b.md", "---\ntags: ' x , , y '\n---\n"),
        ("/kb/c.md", "---\ntags: 5\n---\n"),
        ("/kb/d.md", "---\ntags: [1, 2]\n---\n"),
        ("/kb/e.md", "no front matter"),
        ("/kb/f.md", "---\ntags: '   '\n---\n"),
    ]
    got = parse_rows(spark, rows)
    assert got["/kb/a.md"].tags == ["x", "y"]
    assert got["/kb/b.md"].tags == ["x", "y"]
    assert got["/kb/c.md"].tags == []
    assert got["/kb/d.md"].tags == ["1", "2"]
    assert got["/kb/e.md"].tags == []
    assert got["/kb/f.md"].tags == []


def test_metadata_truthiness_and_status(spark):
    rows = [
        ("/kb/skills/x/SKILL.md", "---\ntitle: ''\nname: N\nstatus: bogus\n---\nb"),
        ("/kb/references/r.md", "---\nstatus: bogus\n---\nb"),
        ("/kb/references/q.md", "b"),
        ("/kb/t.md", "---\ntype: Template\n---\nb"),
        ("/kb/k.md", "---\ntype: Knowledge\ndescription: 0\n---\nb"),
    ]
    got = parse_rows(spark, rows)
    assert got["/kb/skills/x/SKILL.md"].title == "N"
    assert got["/kb/skills/x/SKILL.md"].status == "stable"  # validated: bogus -> default
    assert got["/kb/references/r.md"].status == "bogus"  # empty list: kept
    assert got["/kb/references/q.md"].status is None  # no default for references
    assert got["/kb/t.md"].type == "template" and got["/kb/t.md"].status == "stable"
    assert got["/kb/k.md"].type == "knowledge" and got["/kb/k.md"].description == ""


def test_string_dependencies_mean_no_edges(spark):
    from quire.operators import graph

    rows = [("/kb/a.md", "---\ndependencies: b\n---\n"), ("/kb/b.md", "---\ntitle: B\n---\n")]
    df = parse_files(files_df(spark, rows), ROOTS, now=0, with_embedding=False)
    assert graph.edges(df).count() == 0
