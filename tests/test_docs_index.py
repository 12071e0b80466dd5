"""The documentation index over Markdown files found by a glob."""

from pyspark.sql import functions as F

from sparkloom.operators import docs_index as D

GUIDE = """[← Back to README](../README.md) · more

# The *Guide*

**What this covers:** how to [start](start.md) with `X_Y`
and go on.

## Set `a_b*c*` up
- one | [two](start.md#first-step) and ![pic](images/a.png "t")
> [!NOTE] said _so_ <b>here</b>
~~~ py
# no heading
```
[no](gone.md)
~~~
## Set `a_b*c*` up
See [gone](gone.md), [self](#set-a_bc-up-1), [bad](#nowhere), [web](https://a.org/x.md), [src](../src/a/../b.ts#L3) `[code](gone.md)`
### Deep_er __bold__ \\*star\\* ###
```
open to the end
## not there"""
START = "# Start\n\n---\n| a | b |\n\nfirst words\nof it.\n\n## First step\n"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_index_over_files(spark, tmp_path):
    for name, text in (("guide", GUIDE), ("start", START), ("empty", "")):
        (tmp_path / f"{name}.md").write_text(text)
    (tmp_path / "other.txt").write_text("# none")
    files = D.files(spark, f"{tmp_path}/*.md")
    assert sorted(r.slug for r in files.collect()) in (["empty", "guide", "start"], ["guide", "start"])
    entries = rows(D.search_entries(files).where("slug = 'guide'").select("place", "id", "heading", "depth", "text"), "place")
    assert entries == [
        (0, "", "", 1, "What this covers: how to start with X_Y and go on."),
        (1, "set-a_bc-up", "Set a_b*c* up", 2, "one two and pic said so here"),
        (2, "set-a_bc-up-1", "Set a_b*c* up", 2, "See gone, self, bad, web, src [code](gone.md)".replace("[code](gone.md)", "code")),
        (3, "deep_er-bold-star", "Deep_er bold \\star\\", 3, ""),
    ]
    assert rows(D.cards(files).where("slug <> 'empty'"), "slug") == [("guide", "The Guide", "How to start with XY and go on."), ("start", "Start", "First words of it.")]
    assert rows(D.dangling(files), "line", "href") == [("guide", 17, "#nowhere"), ("guide", 17, "gone.md")]
    assert {r.href for r in D.links(files).collect()} == {"../README.md", "start.md", "start.md#first-step", "images/a.png", "gone.md", "#set-a_bc-up-1", "#nowhere", "https://a.org/x.md", "../src/a/../b.ts#L3"}


def test_links_are_resolved(spark):
    wanted = {
        "x.md#frag": ("doc", "x", "frag"), "#frag": ("anchor", "", "frag"), "images/a.png": ("image", "a.png", ""), "../README.md": ("repo", "README.md", ""), "./a/../x.md": ("doc", "x", ""), "../../../up": ("repo", "up", ""),
        "//cdn/x": ("external", "//cdn/x", ""), "mailto:a@b": ("external", "mailto:a@b", ""), "sub/x.md": ("repo", "docs/sub/x.md", ""), "": ("external", "", ""),
    }
    got = spark.createDataFrame([(h,) for h in wanted], "href string").select("href", D.resolved(F.col("href")).alias("to")).collect()
    assert {r.href: tuple(r.to) for r in got} == wanted


def test_odd_files(spark):
    files = spark.createDataFrame([("a", None), ("b", "```\nnever closed\n# x"), ("c", "~~~\n```\n~~~\n# c")], "slug string, text string")
    assert rows(D.headings(D.prose(files)).select("slug", "text"), "slug") == [("c", "c")]
    assert rows(D.cards(files), "slug") == [("a", "a", ""), ("b", "b", ""), ("c", "c", "")] and D.search_entries(files).count() == 0 and D.dangling(files.limit(0)).count() == 0
