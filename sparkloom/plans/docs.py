"""The documentation index over Markdown texts that are made of the parts: each is a page with a title, a lead, sections, a fenced block and a link to the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs_index as D
from .catalog import read


def pages(spark, d):
    """slug and text; docs_index.files() reads such rows from files that a glob finds."""
    key, size = F.col("p_partkey"), F.col("p_size") % 3
    text = F.concat(
        F.lit("[← Back to README](../README.md)\n# "), "p_name", F.lit(" `x_y`\n\n**What this covers:** the *"), "p_type", F.lit("* kind, see [next](part-"), key + 1, F.lit(".md#size-"), size, F.lit(")\n\n## Brand _"), "p_brand",
        F.lit("_\n```\n# not here\n[x](y.md)\n~~~\n```\n### Size "), size, F.lit("\n- item "), "p_size", F.lit("\n## Brand _"), "p_brand", F.lit("_\nlast | `a_b` "),
    )
    return read(spark, d, "part").select(F.concat(F.lit("part-"), key.cast("string")).alias("slug"), text.alias("text"))


def docs_entries(spark, d):
    return D.search_entries(pages(spark, d))


def docs_cards(spark, d):
    return D.cards(pages(spark, d))


def docs_links(spark, d):
    return D.links(pages(spark, d)).select("slug", "line", "href", D.resolved(F.col("href")).alias("to")).select("slug", "line", "href", "to.kind", "to.target", "to.fragment")


def dangling_links(spark, d):
    return D.dangling(pages(spark, d))


_BRAND = "lower(regexp_replace('Brand ' || p_brand, '[^A-Za-z0-9_\\- ]', '', 'g'))"

ORACLE_SQL = {
    "docs_entries": f"""
WITH p AS (SELECT *, 'part-' || p_partkey AS slug, replace({_BRAND}, ' ', '-') AS b FROM part)
SELECT slug, 0::INTEGER AS place, '' AS id, '' AS heading, 1::INTEGER AS depth, 'What this covers: the ' || p_type || ' kind, see next' AS text FROM p
UNION ALL SELECT slug, 1, b, 'Brand ' || p_brand, 2, '' FROM p UNION ALL SELECT slug, 2, 'size-' || p_size % 3, 'Size ' || p_size % 3, 3, 'item ' || p_size FROM p UNION ALL SELECT slug, 3, b || '-1', 'Brand ' || p_brand, 2, 'last a_b' FROM p""",
    "docs_cards": "SELECT 'part-' || p_partkey AS slug, p_name || ' x_y' AS title, 'The ' || p_type || ' kind, see next' AS summary FROM part",
    "docs_links": """
SELECT 'part-' || p_partkey AS slug, 1::INTEGER AS line, '../README.md' AS href, 'repo' AS kind, 'README.md' AS target, '' AS fragment FROM part
UNION ALL SELECT 'part-' || p_partkey, 4, 'part-' || p_partkey + 1 || '.md#size-' || p_size % 3, 'doc', 'part-' || p_partkey + 1, 'size-' || p_size % 3 FROM part""",
    "dangling_links": """
SELECT 'part-' || p.p_partkey AS slug, 4::INTEGER AS line, 'part-' || p.p_partkey + 1 || '.md#size-' || p.p_size % 3 AS href FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1 WHERE n.p_size IS NULL OR n.p_size % 3 <> p.p_size % 3""",
}

QUERIES = {f.__name__: f for f in (docs_entries, docs_cards, docs_links, dangling_links)}
